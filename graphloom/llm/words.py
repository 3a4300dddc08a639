"""Hashes of the words of many texts at once (numpy, for use inside Arrow batches)."""

from __future__ import annotations

import numpy as np
import xxhash

#: An odd number: multiplying by it is one to one modulo 2^64.
ODD = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes hashed at once, so that a text of any length takes bounded memory.
SEGMENT = 1 << 19
#: Longer words are hashed by xxh3.
LONGEST = 64
#: A random number for each size of a word, and masks of the first 0 to 8 bytes.
_SEEDS = np.random.default_rng(5).integers(1, 1 << 63, LONGEST + 2, np.uint64)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def separators(*, spaces_only: bool) -> np.ndarray:
    """Byte values between words: ASCII white space, or everything of ASCII but letters and digits."""
    table = np.zeros(256, bool)
    for b in range(128):
        table[b] = b in (9, 10, 11, 12, 13, 32) if spaces_only else not chr(b).isalnum()
    return table


SPACES, MARKS = separators(spaces_only=True), separators(spaces_only=False)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def raw_words(texts: list[str | None]) -> list[bytes]:
    """Texts with A-Z lower-cased; a null text is empty."""
    return [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]


def raw_lower(texts: list[str | None]) -> list[bytes]:
    """Texts with all letters lower-cased; a null text is empty."""
    return [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]


def _hashed(data: bytes, first: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of the words at starts, mixed eight bytes after eight bytes; first: the first eight of each. A mix is one to one,
    so no pattern inside words cancels out. Words of more than LONGEST bytes are rare and hashed one by one."""
    h = mixed(_SEEDS[np.minimum(sizes, LONGEST + 1)] ^ (first & _MASKS[np.minimum(sizes, 8)]))
    lanes = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
    more, k = np.flatnonzero((sizes > 8) & (sizes <= LONGEST)), 8
    while len(more):
        h[more] = mixed(h[more] * ODD ^ (lanes[starts[more] + k] & _MASKS[np.minimum(sizes[more] - k, 8)]))
        k += 8
        more = more[sizes[more] > k]
    for i in np.flatnonzero(sizes > LONGEST).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + sizes[i]])
    return h


def _segment(data: bytes, apart: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Starts and hashes of the words of data, which neither begins nor ends inside a word."""
    edge = np.diff(np.concatenate([[True], apart[np.frombuffer(data, np.uint8)], [True]]).view(np.int8))
    starts = np.flatnonzero(edge == -1)
    sizes = np.flatnonzero(edge == 1) - starts
    data += bytes(8)
    first = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))[starts]
    return starts, [_hashed(data, first, starts, np.minimum(sizes, n) if n else sizes) for n in (0, *prefixes)]


def word_arrays(raw: list[bytes], apart: np.ndarray = SPACES, prefixes: tuple[int, ...] = ()) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all words, then of their first n bytes for each n of prefixes; and how many words each text has."""
    offsets = np.cumsum([0] + [len(r) + 1 for r in raw])
    data = b"\n".join(raw) + b"\n"
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = at + SEGMENT
        if end < len(data):  # up to the last separator of the segment, or the next one
            while not len(tail := np.flatnonzero(apart[np.frombuffer(data, np.uint8, min(end, len(data)) - at, at)])):
                end += SEGMENT
            end = at + int(tail[-1]) + 1
        s, h = _segment(data[at:end], apart, prefixes)
        starts.append(s + at)
        hashes.append(h)
        at = end
    return [np.concatenate(h) for h in zip(*hashes, strict=True)], np.diff(np.searchsorted(np.concatenate(starts), offsets))


def word_hashes(raw: list[bytes], apart: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    (flat,), counts = word_arrays(raw, apart)
    return flat, counts


def trigrams(raw: list[bytes], bits: int, apart: np.ndarray = MARKS):
    """Hashed byte trigrams of all texts, each text between spaces and all separators made spaces: (texts' positions, hashes)
    of at most SEGMENT bytes at a time. A text of n bytes has n trigrams."""
    sizes = np.array([len(r) for r in raw], np.int64)
    begins = np.cumsum(np.append(0, sizes[:-1] + 2)) if len(sizes) else np.empty(0, np.int64)
    whole = np.frombuffer(b" " + b"  ".join(raw) + b" ", np.uint8)
    for at in range(0, len(whole) - 2, SEGMENT):
        data = whole[at : at + SEGMENT + 2]
        data = np.where(apart[data], np.uint8(32), data).astype(np.uint32)
        h = (data[:-2] * np.uint32(0x9E3779B1)) ^ (data[1:-1] * np.uint32(0x85EBCA77)) ^ (data[2:] * np.uint32(0xC2B2AE3D))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        h = (h >> np.uint32(32 - bits)).astype(np.int64)
        # Trigrams that span two texts go.
        low, high = np.searchsorted(begins + sizes, at, side="right"), np.searchsorted(begins, at + len(h))
        rows = np.arange(low, high)
        a = np.clip(begins[rows] - at, 0, len(h))
        n = np.clip(begins[rows] + sizes[rows] - at, 0, len(h)) - a
        owner = np.repeat(rows, n)
        yield owner, h[np.arange(len(owner)) - np.repeat(np.cumsum(n) - n - a, n)]


def run_sums(rows_of, n: int, counts: np.ndarray, width: int, block: int = 1 << 16) -> np.ndarray:
    """Sums of consecutive runs of n rows, which rows_of(a, b) gives a block at a time; counts: the runs' lengths."""
    out = np.zeros((len(counts), width))
    owner = np.repeat(np.arange(len(counts)), counts)
    for a in range(0, n, block):
        b = min(n, a + block)
        first = np.flatnonzero(np.concatenate([[True], owner[a + 1 : b] != owner[a : b - 1]]))
        out[owner[a:b][first]] += np.add.reduceat(rows_of(a, b), first, axis=0, dtype=np.float64)
    return out


def table_sums(table: np.ndarray, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of table[index] over consecutive runs."""
    return run_sums(lambda a, b: table[index[a:b]], len(index), counts, table.shape[1])


def text_chunks(batches, column: str = "text", most_rows: int = 400, most_bytes: int = 1 << 19):
    """Slices of Arrow batches of so many rows and so much text at most; a longer text is alone."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
        at = 0
        while at < batch.num_rows:
            fit = int(np.searchsorted(np.cumsum(sizes[at : at + most_rows]), most_bytes, side="right"))
            end = at + max(1, fit)
            yield batch.slice(at, end - at)
            at = end
