"""The numbered operators against brute force, and their edge cases."""

import json
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from concord.llm import byte_dedup, decontaminate, language_id, near_duplicates, packing, quality_model, quality_rules, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, key string, hash long, row string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n=120):
    rng = np.random.default_rng(seed)
    out = []
    for i, k in enumerate(rng.integers(0, len(WORDS), n)):
        w = WORDS[k] + WORDS[rng.integers(0, len(WORDS))]
        out.append((w.capitalize() if i % 12 == 0 else w) + (".\n" if i % 12 == 11 else " "))
    return "".join(out)


LONG = " ".join(prose(s, 400) for s in range(8))
TEXTS = [
    (1, prose(1)), (2, prose(1)), (3, prose(1).replace("alpha", "Alpha", 1)), (4, prose(2) + prose(3)), (5, prose(3) + prose(4)), (6, None), (7, ""), (8, "  \t\n "),
    (9, "Short one."), (10, "spam spam spam " * 40), (11, LONG), (12, LONG), (13, "Été à Nîmes, übergröße! ½ x² — “q” don't <|endoftext|> ok\x0bnext"),
    (1, prose(1)), (None, prose(9)), (14, "ab" * 500), (15, prose(5) + 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + prose(6)), (16, prose(7)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i and i % 2 else "fr", f"src{(i or 0) % 2}", len(t or ""), "x", "y", 1, "z") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def fold(doc_id, n):
    return zlib.crc32(str(doc_id if doc_id is not None else "").encode()) % n


def test_packing_round_trip(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(docs, path, block_tokens=3000).collect()
    tok = Tokenizer.from_file(path)
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in TEXTS}
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    want = Counter()
    for i, _ in TEXTS:
        want[i] += len(ids[i])
    have, room = Counter(), {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        have[r.doc_id] += r.length
        assert room.get(r.sequence_id, 0) == r.offset
        room[r.sequence_id] = r.offset + r.length
    assert have == want
    assert all(n == 4096 or n & (n - 1) == 0 for n in room.values())
    assert packing.pack(empty, path).count() == 0


def test_packing_prefers_the_cheapest_sequence():
    pieces = packing.assign([10, 6, 4, 4, 3, 3, 2], 16, 1.0, 1.0)
    used = Counter()
    for _, _, n, s, _ in pieces:
        used[s] += n
    assert used == {0: 16, 1: 16}
    assert {p[0] for p in pieces} == set(range(7))


def test_language_id(spark, empty):
    rng = np.random.default_rng(0)
    say = lambda a: " ".join("".join(rng.choice(list(a), 6)) for _ in range(60))
    rows = [(i, say("abcdefg") if i % 2 else say("uvwxyzé"), "en" if i % 2 else "fr", "s", 1, "", "", 1, "") for i in range(120)]
    rows += [(900, None, "en", "s", 0, "", "", 1, ""), (901, "12 34 !!", "en", "s", 0, "", "", 1, ""), (902, "", None, "s", 0, "", "", 1, ""), (None, say("abcdefg"), None, "s", 0, "", "", 1, ""), (903, "abc", None, "s", 0, "", "", 1, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = language_id.predict(df, language_id.fit(df)).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {900: "und", 901: "und", 902: "und"}
    lang = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 900}
    held = [r for r in got if r.held_out and r.doc_id in lang]
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)
    assert language_id.predict(empty, language_id.fit(empty)).count() == 0
    assert {r.lang_pred for r in language_id.predict(df.where("doc_id < 3"), language_id.fit(empty)).collect()} == {"und"}


def test_tabulated_filters_equal_the_convolution():
    w = language_id.train(["abc def " * 40, "xyz uvw " * 40], ["a", "b"], steps=20)
    pair, last = language_id.tables(w)
    x = np.random.default_rng(0).integers(0, 64, (5, language_id.WINDOW)).astype(np.uint8)
    emb = w["E"][x]
    pooled = []
    for k in language_id.WIDTHS:
        col = np.concatenate([emb[:, i : language_id.WINDOW - k + 1 + i] for i in range(k)], axis=2)
        pooled.append((col @ w[f"W{k}"] + w[f"b{k}"]).max(axis=1))
    z = np.maximum(np.concatenate(pooled, axis=1), 0) @ w["V"] + w["c"]
    want = z - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)) - z.max(1, keepdims=True)
    assert np.allclose(language_id.log_probs(x, w, pair, last), want, atol=1e-3)


def fingerprint(text):
    w = low(text).encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", w)
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("pairs_up_to", [64, 1])
def test_near_duplicates(spark, docs, empty, monkeypatch, pairs_up_to):
    monkeypatch.setattr(near_duplicates, "PAIRS_UP_TO", pairs_up_to)
    got = near_duplicates.near_duplicates(docs).collect()
    assert Counter((r.doc_id, int(r.fingerprint, 16)) for r in got) == Counter((i, fingerprint(t)) for i, t in TEXTS)
    by = {}
    for i, t in TEXTS:
        if i is not None:
            by.setdefault(fingerprint(t), set()).add(i)
    group = {f: {f} for f in by}
    for a in by:
        for b in by:
            if a < b and (a ^ b).bit_count() <= 2 and group[a] is not group[b]:
                group[a] |= group[b]
                for f in group[b]:
                    group[f] = group[a]
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == min(min(by[f]) for f in group[int(r.fingerprint, 16)])
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_segments_follow_the_number_of_fingerprints():
    assert [near_duplicates.segments_for(n) for n in (0, 1 << 24, (1 << 24) + 1, 1 << 28, 1 << 40)] == [8, 8, 16, 16, 32]


@pytest.mark.parametrize("segments", [8, 16, 32])
def test_pigeonring_links_all_within_two_bits(spark, segments):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 1 << 62, 20)]
    fps = set(base)
    for b in base:
        for _ in range(15):
            i, j = rng.integers(0, 64, 2)
            fps.add(b ^ (1 << int(i)) ^ (1 << int(j)))
    fps = sorted(fps)
    signed = [(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)]
    edges = near_duplicates.links(spark.createDataFrame(signed, "rep long, fp long"), segments)
    root = {r.node: r.root for r in near_duplicates.components(edges).collect()}
    for x in range(len(fps)):
        for y in range(x):
            if (fps[x] ^ fps[y]).bit_count() <= 2:
                assert root[x] == root[y]


ITEMS = [
    (1, "A train leaves at 9 with 120 passengers and travels 300 km before it stops near Springfield for a short rest"),
    (2, "Counting sheep is not a good way to measure how tired the shepherd has become tonight"), (3, None), (4, ""), (5, "tiny item"),
]


def test_decontamination(spark, empty):
    noise = prose(20)
    texts = [
        (1, f"{noise} {ITEMS[0][1]}. {noise}"), (2, f"{noise} A train leaves at 7 with 85 passengers and travels 450 miles before it stops near Shelbyville for a short rest. {noise}"),
        (3, noise), (4, ITEMS[1][1].upper() + "!"), (5, None), (6, "a tiny item here"), (7, "Counting sheep is not a good way"), (8, f"{ITEMS[1][1]}"), (8, f"{ITEMS[1][1]}"),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", 1, "", "", 1, "") for i, t in texts], SCHEMA)
    items = spark.createDataFrame([(i, t, 5) for i, t in ITEMS], "item_id long, text string, hash int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(df, items).collect()}
    assert got >= {(1, 1), (2, 1), (8, 2), (6, 5)}
    assert not {i for i, _ in got} & {3, 5, 7}
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(df, items.limit(0)).count() == 0


def test_slots_must_be_consistent(spark):
    item = "Sum 5 apples then add 5 pears and multiply by 5 before taking 5 away from the total of all fruit"
    good, bad = item.replace("5", "8"), "Sum 1 apples then add 2 pears and multiply by 3 before taking 4 away from the total of all fruit"
    df = spark.createDataFrame([(1, good), (2, bad)], "doc_id long, text string")
    got = decontaminate.contamination(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [r.doc_id for r in got.collect()] == [1]


def test_quality_rules_base(spark, docs, empty):
    for r in quality_rules.quality_rules(docs).collect():
        t = next(t for i, t in TEXTS if i == r.doc_id) or ""
        w = split(t)
        tri = Counter(zip(w, w[1:], w[2:]))
        again = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if split(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)), r.doc_id
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        assert r.base_failed == failed and (not failed or not r.kept)
    assert quality_rules.quality_rules(empty).count() == 0


@pytest.mark.parametrize("broadcast", [16 << 20, 0])
def test_common_lines_deplete_documents(spark, monkeypatch, broadcast):
    monkeypatch.setattr(quality_rules, "BROADCAST_BYTES", broadcast)
    boiler = [" ".join(prose(40 + k, 14).split()) for k in range(4)]
    rows = [(i, "\n".join([*boiler, f"own words number {i} " + " ".join(prose(500 + i, 6).split())]), "en", "host", 1, "", "", 1, "") for i in range(40)]
    rows += [(100 + i, prose(1000 + i), "en", "host", 1, "", "", 1, "") for i in range(40)] + [(200 + i, rows[0][1], "en", "other", 1, "", "", 1, "") for i in range(40)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(not got[i].base_failed and not got[i].kept for i in range(40))
    assert all(got[100 + i].kept for i in range(40))
    assert all(not got[200 + i].kept and got[200 + i].removed_share == 1 for i in range(40))  # each copy is a document of its host
    again = spark.createDataFrame([(None, rows[0][1], "en", "host", 1, "", "", 1, ""), (7, rows[7][1], "en", "host", 1, "", "", 1, ""), *rows], SCHEMA)
    shares = {(r.doc_id, round(r.removed_share, 9)) for r in quality_rules.quality_rules(again).collect() if r.doc_id in (None, 7)}
    assert shares == {(None, round(got[0].removed_share, 9)), (7, round(got[7].removed_share, 9))}


def test_quality_model(spark, empty):
    rows = [(i, prose(i, 80) if i % 3 else " | ".join(prose(i, 80).split()), "en", "s", 1, "", "", 1, "") for i in range(240)] + [(500, None, "en", "s", 1, "", "", 1, ""), (501, "", "en", "s", 1, "", "", 1, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    got = quality_model.score(df, quality_model.fit(df, labels)).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 240]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.95 * len(held)
    assert quality_model.score(empty, quality_model.fit(df, labels.limit(0))).count() == 0


def test_anchors_cover_every_window():
    text = (prose(1) + prose(2)).encode()
    data = np.frombuffer(text, np.uint8)
    _, _, _, s, n = byte_dedup.contexts(data, np.array([0, len(data)]), np.zeros(0, np.uint64))
    assert sorted(p for a, b in zip(s, n) for p in range(a, a + b)) == list(range(len(data) - 99))


def test_pipeline_stages(spark, tmp_path):
    rows = [(i, t, "en", f"src{(i or 0) % 2}", len(t or ""), "x", "y", 1, "z") for i, t in TEXTS] + [(None, prose(33) + ITEMS[1][1] + ". " + prose(34), "en", "s", 9, "", "", 1, ""), (None, prose(35) + 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + prose(36), "en", "s", 9, "", "", 1, ""), (30, prose(30) + ITEMS[1][1] + ". " + prose(31), "en", "s", 9, "", "", 1, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, kept = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept.append(Counter(r.doc_id for r in now.collect()) if k < 4 else now)
    good = {i for i, t in TEXTS if len(split(t)) >= 50} - {10, 14}
    assert set(kept[0]) == good | {30}
    assert set(kept[1]) == good - {2, 3, 12} | {30} and max(n for i, n in kept[1].items() if i is not None) == 1
    assert set(kept[2]) == good - {2, 3, 12} and (kept[1][None], kept[2][None]) == (3, 2)
    nothing = tmp_path / "nothing"
    docs.limit(0).write.parquet(str(nothing / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").limit(0).write.parquet(str(nothing / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(nothing)).count() == 0
    assert set(kept[3]) == set(kept[2])
    text = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "secrets")).collect()}[15]
    assert sum(secrets.MASK in r.text for r in spark.read.parquet(str(tmp_path / "secrets")).collect()) == 2
    assert secrets.MASK in text.text and text.n_chars == len(text.text)
    assert {r.doc_id for r in kept[4].collect()} == set(kept[3])
    tokens = lambda df: sorted((str(r.doc_id), r.n) for r in df.groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect())
    assert tokens(corpus_pipeline.run(spark, str(tmp_path))) == tokens(kept[4])
    json.dumps(sorted(kept[3], key=str))
