"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

The automaton reports, at each position, all pieces that end there (longest first, along its output links). One pass over
them fills a Viterbi table. What a step may relax depends on the model's kind:

- best sum: each piece adds its score, and the best sum at each position stays. These are a unigram model's ids;
- BPE: scores rank merges and do not add up, so the best sum gives other ids than the model. A piece may follow another only
  if merging the two texts by rank gives just these two (remembered for each pair); of the pieces that end at a position
  one fits the best path to its start, and that path is the model's own encoding.

Both paths are taken of every text: ids are the model's own, best_ids those of the best sum (the same in a unigram model).

Characters that no piece holds are cut points: they become byte pieces, or the unknown id. No piece holds a space mark after
another character, so texts are cut before space marks too, and the encodings of short cuts are remembered.

Defined cases: a null or empty text has no ids and decodes to an empty text; texts of any length take one pass; a space
mark (U+2581) in a text decodes to a space, as in the original library, so such texts do not round-trip.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import worker_cache
from graphloom.llm.words import text_chunks

SPACE = "▁"
#: Encodings and pairs remembered by a task, and the longest text remembered.
MOST_KNOWN, LONGEST_KNOWN = 1_000_000, 48
#: What an unknown character costs in a unigram model, below the least score.
UNKNOWN_PENALTY = 10.0


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """A model's pieces; encode() and decode()."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        m.ParseFromString(model)
        kind = proto.ModelProto.SentencePiece
        self.bpe = m.trainer_spec.model_type == proto.TrainerSpec.BPE
        self.prefix, self.fallback = m.normalizer_spec.add_dummy_prefix, m.trainer_spec.byte_fallback
        self.ids, self.scores, self.surface = {}, {}, []
        self.byte_ids, self.unknown = [0] * 256, 0
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(m.pieces):
            self.surface.append(p.piece.replace(SPACE, " ").encode())
            if p.type == kind.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value], self.surface[i] = i, bytes([value])
            elif p.type == kind.UNKNOWN:
                self.unknown, self.surface[i] = i, " ⁇ ".encode()
            elif p.type == kind.CONTROL:
                self.surface[i] = b""
            else:
                self.ids[p.piece], self.scores[p.piece] = i, p.score
                self.automaton.add_word(p.piece, (len(p.piece), i, p.piece))
        self.automaton.make_automaton()
        self.floor = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.chars = {c for p in self.ids for c in p if c in self.ids} if self.bpe else {p for p in self.ids if len(p) == 1}
        apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        blank = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))
        self.cuts = re.compile(f"[{blank}]|{SPACE}*[^{SPACE}{blank}]+|{SPACE}+" if blank else f"{SPACE}*[^{SPACE}]+|{SPACE}+") if apart else re.compile(r"(?s).+")
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.pairs: dict[int, bool] = {}
        self.weight = [p.score for p in m.pieces]
        self.begin, self.texts = len(m.pieces), [p.piece for p in m.pieces] + [""]

    @classmethod
    def read(cls, model: str) -> Pieces:
        with open(model, "rb") as f:
            return cls(f.read())

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: the best-scored neighbours first, the leftmost of equals."""
        parts, score = list(text), self.scores.get
        none = -np.inf
        ranks = [score(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := max(ranks)) > none:
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = score(parts[k - 1] + parts[k], none)
            if k < len(ranks):
                ranks[k] = score(parts[k] + parts[k + 1], none)
        return parts

    def fit(self, pair: int, a: int, b: int) -> bool:
        """Whether piece b may follow piece a (or begin a text); pair names both."""
        if len(self.pairs) >= MOST_KNOWN:
            self.pairs.clear()
        one, two = self.texts[a], self.texts[b]
        found = self.pairs[pair] = self.merged(one + two) == ([one, two] if one else [two])
        return found

    def _both_paths(self, run: str) -> tuple[list[int], list[int]]:
        """A BPE model's own ids and those of the best sum, in one pass. Every character of run is a piece."""
        size = len(run) + 1
        last, back = [self.begin] + [-1] * len(run), [0] * size
        best, top, far = [0.0] + [-np.inf] * len(run), [0] * size, [0] * size
        base, pairs, weight = self.begin + 1, self.pairs, self.weight
        for end, (n, i, _) in self.automaton.iter(run):
            end += 1
            start = end - n
            total = best[start] + weight[i]
            if total > best[end]:
                best[end], top[end], far[end] = total, i, n
            if last[end] < 0 and (before := last[start]) >= 0:
                pair = before * base + i
                fits = pairs.get(pair)
                if self.fit(pair, before, i) if fits is None else fits:
                    last[end], back[end] = i, n
        own, sums, at = [], [], len(run)
        while at:
            own.append(last[at])
            at -= back[at]
        at = len(run)
        while at:
            sums.append(top[at])
            at -= far[at]
        return own[::-1], sums[::-1]

    def _best_path(self, run: str) -> list[int]:
        best, last = [0.0] + [-np.inf] * len(run), [""] + [None] * len(run)
        at = 0
        for end, (_, _, piece) in self.automaton.iter(run):
            while at <= end:  # a character that no piece covers alone
                if best[at] + self.floor > best[at + 1]:
                    best[at + 1], last[at + 1] = best[at] + self.floor, run[at]
                at += 1
            score = best[end + 1 - len(piece)] + self.scores[piece]
            if score > best[end + 1] or last[end + 1] == piece:
                best[end + 1], last[end + 1] = score, piece
        out, at = [], len(run)
        while at:
            out.append(self.ids[last[at]])
            at -= len(last[at])
        return out[::-1]

    def _unknown(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.fallback else [self.unknown]

    def _cut(self, text: str) -> tuple[list[int], list[int]]:
        """ids and best_ids of a text without spaces inside."""
        out: list[int] = []
        sums: list[int] = []
        at = 0
        while at < len(text):
            end = at
            while end < len(text) and text[end] in self.chars:
                end += 1
            if end > at:
                own, best = self._both_paths(text[at:end]) if self.bpe else (self._best_path(text[at:end]),) * 2
                out += own
                sums += best
            while end < len(text) and text[end] not in self.chars:
                for ids in (out, sums):
                    if self.fallback or not ids or ids[-1] != self.unknown:
                        ids += self._unknown(text[end])
                end += 1
            at = end
        return out, sums

    def encode_both(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """ids and best_ids."""
        if not text:
            return np.empty(0, np.int32), np.empty(0, np.int32)
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        known, out, best = self.known, [], []
        for cut in self.cuts.findall(text):
            both = known.get(cut)
            if both is None:
                ids, sums = self._cut(cut)
                own = np.array(ids, np.int32).tobytes()
                both = (own, own if ids == sums else np.array(sums, np.int32).tobytes())
                if len(cut) <= LONGEST_KNOWN:
                    if len(known) >= MOST_KNOWN:
                        known.clear()
                    known[cut] = both
            out.append(both[0])
            best.append(both[1])
        return np.frombuffer(b"".join(out), np.int32), np.frombuffer(b"".join(best), np.int32)

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_both(text)[0]

    def decode(self, ids: np.ndarray) -> str:
        surface = self.surface
        text = b"".join([surface[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def lists(ids: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)]).astype(np.int32), np.concatenate(ids))


def encoded(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids and best_ids (arrays of int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_cache(f"pieces {model}", lambda: Pieces.read(model))
        for part in text_chunks(batches):
            ids, best = zip(*map(pieces.encode_both, part.column("text").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists(list(ids)), lists(list(best))], ["doc_id", "ids", "best_ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, best_ids array<int>")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


DIGEST = "doc_id long, n_tokens long, ids_crc32 long, best_tokens long, best_crc32 long, text_chars long, text_sha256 string"


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """rows (doc_id, ids, best_ids) with the ids' text: numbers and checksums (of little-endian unsigned 32-bit ids) of both, text_chars, text_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_cache(f"pieces {model}", lambda: Pieces.read(model))
        for batch in batches:
            out = []
            for doc, *both in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("best_ids"), strict=True):
                ids, best = (x.values.to_numpy() if x.is_valid else np.empty(0, np.int32) for x in both)
                text = pieces.decode(ids)
                out.append((doc, len(ids), crc(ids), len(best), crc(best), len(text), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.string())], [c.split()[0] for c in DIGEST.split(", ")])

    return rows.select("doc_id", "ids", "best_ids").mapInArrow(run, DIGEST)
