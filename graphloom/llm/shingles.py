"""Word shingles as sorted arrays of 64-bit hashes (numpy, for use inside Arrow batches)."""

from __future__ import annotations

import numpy as np
import xxhash

from graphloom.llm.words import ODD, mixed, raw_words, word_hashes

WORDS = 5
_SALT = np.uint64(0x94D049BB133111EB)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text its distinct shingles: sorted uint64. With fewer words than WORDS the whole sequence is one."""
    flat, counts = word_hashes(raw_words(texts))
    run = flat
    if len(flat) >= WORDS:
        last = len(flat) - WORDS + 1
        run = flat[:last].copy()
        for k in range(1, WORDS):
            run *= ODD
            run += flat[k : last + k]
        run = mixed(run)
    out, at = [], 0
    for n in counts.tolist():
        if n >= WORDS:
            part = np.sort(run[at : at + n - WORDS + 1])
            new = np.ones(len(part), bool)
            np.not_equal(part[1:], part[:-1], out=new[1:])
            out.append(part[new])
        elif n:
            h = np.array([n], np.uint64)
            for w in flat[at : at + n]:
                h = h * ODD + w
            out.append(mixed(h + np.array([n], np.uint64) * _SALT))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def set_key(a: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(a.tobytes())


def bits_for(n: int) -> int:
    """Between half of n and n bits: enough to tell sets apart that differ in more than a third."""
    return min(1 << 16, max(64, 1 << max(n, 1).bit_length() - 1))


def folded_int(x: int, bits: int) -> int:
    return (x >> bits // 2) ^ (x & ((1 << bits // 2) - 1))


def parity_bitmap(a: np.ndarray, sharper: int = 1) -> bytes:
    """Bit k is the parity of the shingles that hash to k, so the XOR of two bitmaps counts no shingle of both."""
    b = bits_for(len(a)) * sharper
    return np.packbits((np.bincount((a & np.uint64(b - 1)).astype(np.int64), minlength=b) & 1).astype(np.uint8)).tobytes()


def folded(words: np.ndarray) -> np.ndarray:
    """Bitmaps of half the bits: both halves of each row XORed."""
    half = words.shape[1] // 2
    return words[:, :half] ^ words[:, half:]
