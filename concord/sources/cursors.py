"""A stream over a source that is paged by cursors (SRC-06): the offset is the cursor of the next page.

A page names the page after it, so pages can only be listed by following them.
The driver follows cursors alone, some pages a batch; executors fetch the rows,
a partition a page, so no page passes through the driver and a lost executor's
pages are fetched again. Checkpoints hold the cursor: a stream that starts again
goes on behind the last page of its last batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FIRST = "*"


def cursor_source(name: str, schema: str, follow: Callable[[dict, str], str | None], fetch: Callable[[dict, str], Iterator[tuple]]) -> type[DataSource]:
    """A streaming data source of that name.

    `follow(options, cursor)` gives the cursor behind a page, None after the last; it should ask for no rows. `fetch(options,
    cursor)` gives a page's rows and must give the same ones again. Option `pages_a_batch` (10) bounds a batch. A source that
    ends is not asked again; a stream that should see new pages lets `follow` give the last cursor itself until there are some.
    """

    class Page(InputPartition):
        def __init__(self, cursor: str):
            self.cursor = cursor

    class Reader(DataSourceStreamReader):
        def __init__(self, options: dict):
            self.options, self.most = options, int(options.get("pages_a_batch", 10))
            if self.most < 1:
                raise ValueError("pages_a_batch is a positive number")
            self.at: dict | None = None  # the end of the last batch
            self.after: dict[str, str | None] = {}  # followed cursors of batches that are not committed

        def initialOffset(self) -> dict:
            return {"cursor": FIRST, "pages": 0}

        def _behind(self, cursor: str) -> str | None:
            if cursor not in self.after:
                self.after[cursor] = follow(self.options, cursor)
            return self.after[cursor]

        def latestOffset(self) -> dict:
            at = self.at or self.initialOffset()
            for _ in range(self.most):
                if at["cursor"] is None:
                    break
                behind = self._behind(at["cursor"])
                if behind == at["cursor"]:  # nothing new yet
                    del self.after[behind]
                    break
                at = {"cursor": behind, "pages": at["pages"] + 1}
            self.at = at
            return at

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            # a stream that starts again is told its last offset by an empty range, before it asks for a new one
            if self.at is None or self.at["pages"] < end["pages"]:
                self.at = end
            out, cursor = [], start["cursor"]
            for _ in range(end["pages"] - start["pages"]):
                out.append(Page(cursor))
                cursor = self._behind(cursor)
            if cursor != end["cursor"]:
                raise ValueError(f"the pages behind {start} have changed: {cursor} instead of {end['cursor']}")
            return out

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from fetch(self.options, partition.cursor)

        def commit(self, end: dict) -> None:
            for cursor in list(self.after):  # in the order of the pages
                if cursor == end["cursor"]:
                    break
                del self.after[cursor]

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ARG002
            return Reader(dict(self.options))

    return Source
