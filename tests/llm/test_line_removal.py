"""The pipeline's first stage takes boilerplate lines out of the texts it keeps."""

import corpus_pipeline


def test_boilerplate_leaves_the_texts(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    line, few = "All rights reserved by the host", "Seen in a few documents only"
    rows = [(i, f"{line}!\n{own(i)}\n\n{line.upper()}" + (f"\n{few}" if i < 20 else ""), "big", 7) for i in range(21)]
    # the host grows: 21 documents are under a tenth of it, but over the square root of its size
    rows += [(100 + i, own(100 + i), "big", 7) for i in range(300)] + [(1000, f"{line}\n{own(1000)}", "other", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.keep_good(spark, docs, "").collect()}
    assert len(got) == len(rows)
    for i in range(21):
        want = f"{own(i)}\n" + (f"\n{few}" if i < 20 else "")
        assert (got[i].text, got[i].n_chars) == (want, len(want))
    assert all((got[i].text, got[i].n_chars) == (t, n) for i, t, _, n in rows[21:])
