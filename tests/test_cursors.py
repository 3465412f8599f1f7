"""A source that is paged by cursors, as a stream that stops and starts again."""

import json
from pathlib import Path

import pytest

from concord.sources.cursors import cursor_source

SCHEMA = "page string, n int"


def pages(folder, names):
    """Each page is a file that names the next one."""
    for name, behind in zip(names, [*names[1:], None], strict=True):
        (folder / name.replace("*", "first")).write_text(json.dumps({"rows": [[name, i] for i in range(3)], "next": behind}))


def run(spark, folder, pages_a_batch=2):
    q = (
        spark.readStream.format("cursor_pages").option("folder", str(folder)).option("pages_a_batch", pages_a_batch).load()
        .writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "check")).start()
    )
    try:
        q.processAllAvailable()
        return [p["sources"][0]["numInputRows"] for p in q.recentProgress if p["sources"][0]["numInputRows"]]
    finally:
        q.stop()


@pytest.fixture
def source(spark):
    def follow(options, cursor):
        folder = Path(options["folder"])
        with (folder / "followed").open("a") as f:
            f.write(f"{cursor}\n")
        return json.loads((folder / cursor.replace("*", "first")).read_text())["next"]

    def fetch(options, cursor):
        if (Path(options["folder"]) / "broken").exists():
            raise OSError("no answer")
        for name, i in json.loads((Path(options["folder"]) / cursor.replace("*", "first")).read_text())["rows"]:
            yield name, i

    spark.dataSource.register(cursor_source("cursor_pages", SCHEMA, follow, fetch))


def found(spark, folder):
    return sorted((r.page, r.n) for r in spark.read.parquet(str(folder / "out")).collect())


def test_pages_in_bounded_batches(spark, source, tmp_path):
    names = ["*", "a", "b", "c", "d"]
    pages(tmp_path, names)
    assert run(spark, tmp_path) == [6, 6, 3]
    assert found(spark, tmp_path) == sorted((p, i) for p in names for i in range(3))
    assert (tmp_path / "followed").read_text().split() == names  # each page is followed once
    run(spark, tmp_path)  # a finished source gives nothing again
    assert len(found(spark, tmp_path)) == 15


def test_goes_on_after_a_failure(spark, source, tmp_path):
    names = ["*", "a", "b", "c"]
    pages(tmp_path, names)
    (tmp_path / "broken").touch()
    with pytest.raises(Exception, match="no answer"):
        run(spark, tmp_path)
    (tmp_path / "broken").unlink()
    run(spark, tmp_path)
    assert found(spark, tmp_path) == sorted((p, i) for p in names for i in range(3))


def test_new_pages_behind_the_last_cursor(spark, source, tmp_path):
    pages(tmp_path, ["*", "a", "b"])
    last = tmp_path / "b"
    last.write_text(json.dumps({"rows": [], "next": "b"}))  # an open end names itself
    run(spark, tmp_path)
    assert len(found(spark, tmp_path)) == 6
    (tmp_path / "followed").unlink()
    pages(tmp_path, ["b", "c"])
    run(spark, tmp_path)
    assert found(spark, tmp_path) == sorted((p, i) for p in ("*", "a", "b", "c") for i in range(3))
    assert set((tmp_path / "followed").read_text().split()) == {"b", "c"}  # earlier pages are not followed again
