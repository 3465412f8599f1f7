"""Operator 10: cost-balanced packing of token ids into sequences.

Each scan task tokenises its documents in order and packs them in blocks of
about ``block_tokens`` tokens, so nothing is shuffled, memory is bounded by a
block plus one document, and a lost task gives the same rows again. A block
of T tokens opens T // capacity full sequences and, for the rest, one short
sequence for each power of two in T % capacity, so that no sequence needs
padding. A document's cost is ``linear * n + quadratic * n^2`` (projections
and attention). Longest first, each document goes to the lowest-cost sequence
with room for all of it; only where no sequence has room is it cut, at the
room left in the lowest-cost open sequence.

Edge cases: null or empty text is a document of the end id alone; longer
documents than a sequence are cut into full ones and a rest; repeated rows
and null ids are packed like any other row; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from concord.llm.common import documents
from concord.llm.kernels import chunks

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
WORD = re.compile(r"[^ \t-\r]+")
#: The vocabulary's own rule for a lower-cased text of Latin-1 characters.
PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9²³¹¼½¾]|[^ \t-\r\x85\xa0a-zß-öø-ÿ0-9²³¹¼½¾]+")
LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
BEYOND = re.compile(r"[^\x00-\xff]|[ªºµ]|<\|")  # texts with these are split at white space only
MEMO = 600_000  # pieces whose ids a Python worker remembers; then it starts anew

_state: dict[str, object] = {}


class WordIds:
    """Ids of texts, piece by piece: no token of this vocabulary spans two pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode = tokenizer.encode_batch_fast
        vocab = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a piece
        self.ends[[i for x, i in vocab.items() if x.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {}

    def texts(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        split = [WORD.findall(x) if BEYOND.search(x) else PIECE.findall(x.lower()) for x in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        self.learn(set().union(*split))
        ids = self.memo.__getitem__
        return [b"".join(map(ids, x)) for x in split]

    def learn(self, pieces: set[str]) -> None:
        """Put the pieces into the memo; pieces of letters are encoded many at a time."""
        memo = self.memo
        missing = pieces - memo.keys()
        plain = [x for x in missing if LETTERS.fullmatch(x)]
        odd = [x for x in missing if not LETTERS.fullmatch(x)]
        groups = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        for group, e in zip(groups, self.encode([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, "<u4")
            cut = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cut) != len(group):
                odd += group
                continue
            data = ids.tobytes()
            memo.update((x, data[4 * a : 4 * b]) for x, a, b in zip(group, [0, *cut], cut, strict=False))
        for x, e in zip(odd, self.encode(odd, add_special_tokens=False), strict=True):
            memo[x] = np.asarray(e.ids, "<u4").tobytes()


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece of one block."""
    total = sum(lengths)
    room = [capacity] * (total // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if (total % capacity) >> b & 1]
    size, left, cost = np.array(room, np.int64), np.array(room, np.int64), np.zeros(len(room))
    out, full = [], 0
    todo: list[tuple[int, int, int]] = []  # length, document, start
    for d, n in enumerate(lengths):
        start = 0
        while n - start >= capacity:  # a sequence of its own
            out.append((d, start, capacity, full, 0))
            left[full], start, full = 0, start + capacity, full + 1
        if n > start:
            todo.append((n - start, d, start))
    todo.sort(key=lambda x: (-x[0], x[1]))
    for n, d, start in todo:
        while n:
            fits = left >= n
            s = int(np.where(fits if fits.any() else left > 0, cost, np.inf).argmin())
            piece = min(n, int(left[s]))
            out.append((d, start, piece, s, int(size[s] - left[s])))
            left[s] -= piece
            cost[s] += linear * piece + quadratic * piece * piece
            n, start = n - piece, start + piece
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, block_tokens: int = 1 << 20, linear: float = 1.0, quadratic: float = 1 / 4096) -> DataFrame:
    """Pieces of all documents; see the module. `tokenizer` is a path that every executor has."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _state:
            _state[tokenizer] = WordIds(tokenizer)
        words, end = _state[tokenizer], np.uint32(end_id).tobytes()
        next_id = TaskContext.get().partitionId() << 36
        ids: list[int | None] = []
        tokens: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal next_id, held
            lengths = [len(x) // 4 for x in tokens]
            pieces = assign(lengths, capacity, linear, quadratic)
            d, start, length, seq, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
            crc = [zlib.crc32(memoryview(tokens[a])[4 * b : 4 * (b + c)]) for a, b, c, _, _ in pieces]
            doc = pa.array(ids, pa.int64()).take(pa.array(d))
            out = pa.RecordBatch.from_arrays([doc, pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.array(lengths, np.int64)[d]), pa.array(seq + next_id), pa.array(offset)], [x.split()[0] for x in SCHEMA.split(", ")])
            next_id += int(seq.max()) + 1
            ids.clear()
            tokens.clear()
            held = 0
            return out

        for batch in chunks(batches):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for doc_id, x in zip(batch.column(0).to_pylist(), words.texts(texts), strict=True):
                ids.append(doc_id)
                tokens.append(x + end)
                held += len(x) // 4 + 1
                if held >= block_tokens:
                    yield flush()
        if ids:
            yield flush()

    return documents(docs).mapInArrow(run, SCHEMA)


def op10(spark, sf_dir):
    import public_tokenizers

    from concord.llm.common import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
