"""Operator 12: byte-level BPE by depth-first traversal of a trie of the distinct words.

``encode`` gives the ids of every text and ``decode`` the text of ids, as the
``tokenizers`` library does for the same vocabulary file without adding special
tokens; special tokens that stand in a text are found there. Both are one pass
of Arrow tasks: nothing is shuffled, and a lost task gives the same rows again.

The distinct words of a batch that the worker has not met yet, sorted by their
bytes, are the depth-first order of their trie: a word's new nodes are those
beyond its common prefix with the word before. Each node keeps one state, the
last token of the encoding of its prefix, so a shared prefix is encoded once.
The state of a node is its longest suffix that is a token and that can follow
the state at the node where this suffix starts; two tokens can follow each
other if no merge crosses their border before its parts are merged otherwise.
A word's ids are the states met when it is walked back from its end.

Edge cases: null and empty texts have no ids and decode to ''; null ids decode
to ''. Repeated rows and null doc_ids are encoded like any others; an empty
table gives no rows; other columns are dropped. Texts of any length go block
by block, cut before single spaces between other characters.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import documents
from concord.llm.kernels import chunks

#: The byte-level pre-tokeniser's rule, for texts of Latin-1 characters and for those whose classes all Unicode versions agree on.
LATIN = re.compile(
    r"'(?:s|t|re|ve|m|ll|d)| ?[a-zA-ZªµºÀ-ÖØ-öø-ÿ]+| ?[0-9²³¹¼½¾]+| ?[^\t-\r \x85\xa0a-zA-ZªµºÀ-ÖØ-öø-ÿ0-9²³¹¼½¾]+"
    r"|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"
)
SETTLED = regex.compile(r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
NOT_LATIN = re.compile(r"[^\x00-\xff]")
NOT_SETTLED = re.compile("[^\x00-\u0557\u2000-\u2064]")  # texts with others are split by the library's own pre-tokeniser
CUT = re.compile(r"(?<=\S)(?= \S)")
BLOCK = 1 << 20  # characters
MEMO = 600_000  # words whose ids a Python worker remembers; then it starts anew
LONG = 200  # bytes; longer words are not remembered

_state: dict[str, Vocabulary] = {}


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, merges and the words encoded so far by this Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, names = spec["model"], byte_names()
        if model["type"] != "BPE" or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE")
        self.path = path
        ids = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        as_bytes = {x: bytes(map(names.__getitem__, x)) for x in ids if x not in self.special}
        self.token = {b: ids[x] for x, b in as_bytes.items()}
        self.merge: dict[tuple[int, int], int] = {}  # pair of ids: rank
        self.parts: dict[int, tuple[int, int, int]] = {}  # id: left id, right id, rank of the merge that makes it
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = ids[left], ids[right]
            self.merge[a, b] = rank
            self.parts[ids[left + right]] = (a, b, rank)
        for a, b, rank in self.parts.values():
            if max(self.parts.get(a, (0, 0, -1))[2], self.parts.get(b, (0, 0, -1))[2]) > rank:
                raise ValueError("a merge comes before those that make its parts")
        if len(self.parts) != len(self.merge) or len(self.parts) + sum(len(b) == 1 for b in self.token) != len(self.token):
            raise ValueError("a token without one merge of its own")
        self.bytes_of = {i: b for b, i in self.token.items()} | {i: x.encode() for x, i in self.special.items()}
        self.size = {i: len(b) for i, b in self.bytes_of.items()}
        ends: dict[bytes, set[int]] = {}
        for b in self.token:
            if len(b) > 3:
                ends.setdefault(b[-4:], set()).add(len(b))
        self.ends = {b: (*sorted(n, reverse=True), 3, 2, 1) for b, n in ends.items()}  # lengths of tokens by their last four bytes
        self.find_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.follows: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}

    @cached_property
    def library(self):
        """The library's pre-tokeniser, for texts with characters whose class depends on the Unicode version."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path).pre_tokenizer

    def border(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at one border of a token, outermost last to be made first, each with the rank of the merge that takes it in."""
        out, taken = [(token, 1 << 40)], self.parts.get(token)
        while taken:
            out.append((taken[side], taken[2]))
            taken = self.parts.get(taken[side])
        return out

    def can_follow(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's bytes is a, b: no merge crosses the border while both of its parts are there."""
        for x, x_taken in self.border(a, 1):
            for y, y_taken in self.border(b, 0):
                rank = self.merge.get((x, y))
                # of equal merges the leftmost comes first: a's own before the crossing one, that before b's
                if rank is not None and rank < x_taken and rank <= y_taken:
                    return False
        return True

    def traverse(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each word with its ids, for sorted words: the trie of the words in depth-first order."""
        token, ends, follows, size = self.token, self.ends, self.follows, self.size
        if len(follows) > 4 * MEMO:
            follows.clear()
        short = (3, 2, 1)
        path: list[int] = [-1]  # the last token at every depth of the current branch
        before = b""
        for word in words:
            shared = 0
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                shared += 1
            del path[shared + 1 :]
            for depth in range(shared + 1, len(word) + 1):
                for n in ends.get(word[depth - 4 : depth], short) if depth > 3 else short:
                    start = depth - n
                    if start < 0:
                        continue
                    t = token.get(word[start:depth])
                    if t is None:
                        continue
                    if not start:
                        break
                    pair = path[start] << 32 | t
                    ok = follows.get(pair)
                    if ok is None:
                        ok = follows[pair] = self.can_follow(path[start], t)
                    if ok:
                        break
                path.append(t)
            before = word
            found, depth = [], len(word)
            while depth:
                t = path[depth]
                found.append(t)
                depth -= size[t]
            found.reverse()
            yield word, b"".join(t.to_bytes(4, "little") for t in found)

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of the words, from the memo or a traversal of those that are new."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        new = {w.encode(): w for w in words if w not in memo}
        extra: dict[str, bytes] = {}
        for word, ids in self.traverse(sorted(new)):
            (memo if len(word) <= LONG else extra)[new[word]] = ids
        return {w: memo[w] for w in words if w in memo} | extra if extra else memo

    def split(self, text: str) -> list[str]:
        if not NOT_LATIN.search(text):
            return LATIN.findall(text)
        if not NOT_SETTLED.search(text):
            return SETTLED.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def blocks(self, text: str) -> Iterator[str]:
        """The text in blocks that no word crosses."""
        start = 0
        while len(text) - start > BLOCK:
            cut = CUT.search(text, start + BLOCK)
            if not cut:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def pieces(self, text: str) -> Iterator[list[str] | int]:
        """Words of each stretch of the text in turn, or the id of a special token between them."""
        for i, part in enumerate(self.find_special.split(text) if self.find_special else [text]):
            if i % 2:
                yield self.special[part]
            elif part:
                for block in self.blocks(part):
                    yield self.split(block)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        if sum(map(len, texts)) > 4 * BLOCK:
            return [b"".join(self._ids([p]) for p in self.pieces(x)) for x in texts]
        split = [list(self.pieces(x)) for x in texts]
        ids = self.learn(set().union(*(p for x in split for p in x if not isinstance(p, int))))
        return [self._ids(x, ids) for x in split]

    def _ids(self, pieces: list[list[str] | int], ids: dict[str, bytes] | None = None) -> bytes:
        if ids is None:
            ids = self.learn(set().union(*(p for p in pieces if not isinstance(p, int))))
        return b"".join(p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(ids.__getitem__, p)) for p in pieces)

    def decode(self, ids: bytes) -> str:
        """The text of the ids; bytes that are not UTF-8 become U+FFFD."""
        numbers = iter(memoryview(ids).cast("I"))
        each = self.bytes_of.__getitem__
        return b"".join(iter(lambda: b"".join(map(each, islice(numbers, BLOCK))), b"")).decode("utf-8", "replace")


def _vocabulary(path: str) -> Vocabulary:
    if path not in _state:
        _state[path] = Vocabulary(path)
    return _state[path]


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit numbers) of every text; `vocabulary` is a path that every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabulary(vocabulary)
        for batch in chunks(batches):
            ids = words.encode([x or "" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return documents(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """The rows of `encoded` with the text of their ids beside them; special tokens stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabulary(vocabulary)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                text = pa.array([words.decode(x or b"") for x in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, text], [*part.schema.names, "text"])

    rest = encoded.drop("text")
    return rest.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + ", text string")


def op12(spark, sf_dir):
    import public_tokenizers

    from concord.llm.common import table

    path = public_tokenizers.path("byte_bpe_50k.json")
    return decode(encode(table(spark, sf_dir, "documents"), path), path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )
