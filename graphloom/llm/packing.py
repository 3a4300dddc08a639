"""Packing into fixed windows by the sum-of-squares rule.

Each document becomes token ids and an end id, and is cut into full windows and a rest. A rest goes to the fill level
where it leaves the smallest sum of squared counts of partially filled windows; an array holds that count for each
level, and a new window is one of the choices. Open windows and their rests are held until they are full.

Rests are placed twice. The first placement runs inside each input partition, where texts become ids. What its open windows
hold at the end, or when there are more than MOST_OPEN, goes on as unplaced rests to the second one, which takes them by the
same rule in parts of about MANY_RESTS. Only what is then still open is laid end to end and cut into full windows, and the
remainder of each part into windows of powers of two, which take no padding. So memory is bounded, each id lies in exactly
one piece, and no window needs padding.

Windows are numbered by the partition that fills them. The first placement is written to the shared folder, and rests are
ordered in each part of the second, so a rerun of a lost partition gives the same rows.

Defined cases: a null text counts as empty and gives the end id alone; repeated rows are packed as often as they occur;
a null doc_id stays null; other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, small_batches
from graphloom.llm.words import text_chunks

WINDOW, END_ID = 2048, 1
#: Open windows that a partition of the first placement holds at most, and rests in a part of the second.
MOST_OPEN, MANY_RESTS = 2048, 16_384
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Pieces, or with rest (their ids) what is not yet placed; sequence_id is then a number of the rest.
PLACED = f"{SCHEMA}, rest binary"


class ByteBpe:
    """Ids of the byte-level vocabulary. tiktoken gives those of tokenizers several times faster; a text that holds a special token goes to tokenizers itself."""

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers as public
        import tiktoken

        self.file, self.exact = public.path(f"{name}.json"), None
        with open(self.file, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        with open(public.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return self.slow(text)
        return self.fast.encode_to_numpy(text, disallowed_special=())

    def slow(self, text: str) -> np.ndarray:
        from tokenizers import Tokenizer

        self.exact = self.exact or Tokenizer.from_file(self.file)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


class Windows:
    """Sum-of-squares packing of pieces (doc_id, start, ids, doc_tokens); out: what has been placed."""

    def __init__(self, window: int = WINDOW, first: int = 0):
        self.window, self.next = window, first
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = {}
        self.n_open, self.out = 0, []
        self.by_rule = self.cut = 0

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        full = len(ids) // self.window * self.window
        for at in range(0, full, self.window):
            self._emit([(doc, at, ids[at : at + self.window], len(ids))])
        if full < len(ids):
            self.place((doc, full, ids[full:].copy(), len(ids)))

    def place(self, piece: tuple) -> None:
        size, counts = len(piece[2]), self.counts
        levels = np.flatnonzero(counts[: self.window - size + 1])
        # Growth of the sum of squares: opening a window, or moving one from its level to a higher or full one.
        best, level = 2 * counts[size] + 1, 0
        if len(levels):
            to = levels + size
            growth = 1 - 2 * counts[levels] + np.where(to < self.window, 2 * counts[to] + 1, 0)
            k = len(growth) - 1 - int(np.argmin(growth[::-1]))
            if growth[k] <= best:
                level = int(levels[k])
        held = self._take(level) if level else []
        held.append(piece)
        if level + size == self.window:
            self.by_rule += 1
            self._emit(held)
            return
        self.open.setdefault(level + size, []).append(held)
        counts[level + size] += 1
        self.n_open += 1

    def _take(self, level: int) -> list[tuple]:
        self.counts[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def unplaced(self) -> list[tuple]:
        """Empties the open windows: their pieces."""
        pieces = [p for level in sorted(self.open) for held in self.open[level] for p in held]
        self.open, self.n_open = {}, 0
        self.counts[:] = 0
        return pieces

    def close(self) -> None:
        """Cuts what is open into full windows, and the remainder into powers of two."""
        pieces = self.unplaced()
        left = sum(len(p[2]) for p in pieces)
        while left:
            room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            taken, need = [], room
            while need:
                doc, start, ids, total = pieces.pop()
                if len(ids) > need:
                    pieces.append((doc, start + need, ids[need:], total))
                taken.append((doc, start, ids[:need], total))
                need -= len(taken[-1][2])
            left -= room
            self.cut += 1
            self._emit(taken)

    def rows(self, rests: list[tuple] = ()) -> pa.RecordBatch:
        """What has been placed since the last call, and rests that have not."""
        out = [(*x, None) for x in self.out]
        for doc, start, ids, total in rests:
            out.append((doc, start, len(ids), None, total, self.next, None, ids.astype("<u4").tobytes()))
            self.next += 1
        self.out = []
        columns = list(zip(*out, strict=True)) or [()] * 8
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.binary())], [*COLUMNS, "rest"])


def packed(docs: DataFrame, window: int = WINDOW, tokenizer=ByteBpe) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    most_open, many = MOST_OPEN, MANY_RESTS

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer()  # for this task: idle workers are to hold no tokenizer
        windows = Windows(window, TaskContext.get().partitionId() << 40)
        end = np.array([END_ID], np.uint32)
        for part in text_chunks(batches):
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                windows.add(doc, np.concatenate([encode(text), end]) if text else end)
            yield windows.rows(windows.unplaced() if windows.n_open > most_open else [])
        yield windows.rows(windows.unplaced())

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(window, 1 << 62 | TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc, start, total, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "rest")), strict=True):
                windows.place((doc, start, np.frombuffer(ids, "<u4"), total))
            yield windows.rows()
        windows.close()
        yield windows.rows()

    with small_batches(docs.sparkSession):
        once = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(first, PLACED), "packed")
    rests = once.where("rest IS NOT NULL")
    dealt = rests.repartition(1 + rests.count() // many, "sequence_id").sortWithinPartitions("sequence_id")
    twice = dealt.select("doc_id", "start", "doc_tokens", "rest").mapInArrow(second, PLACED)
    return once.where("rest IS NULL").select(*COLUMNS).unionByName(twice.select(*COLUMNS))
