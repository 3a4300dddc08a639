"""SentencePiece encoding and packing."""

import random
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from graphloom.llm import packing, sentence_pieces
from graphloom.llm.queries_pieces import op3_sentencepiece

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    with open(sentence_pieces.model_path(), "rb") as f:
        raw = f.read()
    return raw, sentence_pieces.Pieces(raw)


def random_texts(n, seed=1):
    r = random.Random(seed)
    letters = "aaabt eh  ▁inos\n\t.,é你🙂0x<>THE"
    return ["".join(r.choices(letters, k=r.randint(1, 60))) for _ in range(n)] + [" ", "  ", "<0x0A>", "<s>", "a" * 300, " " * 40, "", "\x00"]


def test_bpe_equals_the_library(model):
    raw, mine = model
    lib = sentencepiece.SentencePieceProcessor(model_proto=raw)
    for t in random_texts(2000):
        ids = mine.encode(t)
        assert ids.tolist() == lib.encode(t), t
        assert mine.decode(ids) == lib.decode(ids.tolist()) == t.replace("▁", " ")
    assert mine.encode(None).tolist() == [] and mine.decode(mine.encode(None)) == ""


def test_unigram_scores_are_the_best(model):
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(model[0])
    m.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    r = random.Random(3)
    for p in m.pieces:
        if p.type == 1:
            p.score = -r.random() * 10
    raw = m.SerializeToString()
    mine, lib = sentence_pieces.Pieces(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    score = lambda ids: sum(m.pieces[i].score for i in ids)
    for t in random_texts(500, 5):
        assert abs(score(mine.encode(t).tolist()) - score(lib.encode(t))) < 1e-3, t


def plain_best_sum(pieces, cut):
    """The best sum of scores over all ways to cut a text into pieces, by plain dynamic programming."""
    longest, best = max(map(len, pieces.scores)), [0.0] + [-np.inf] * len(cut)
    for end in range(1, len(cut) + 1):
        for start in range(max(0, end - longest), end):
            best[end] = max(best[end], best[start] + pieces.scores.get(cut[start:end], -np.inf))
    return best[-1]


def test_best_sums_of_the_query(spark, model):
    """Every document of the table: its best_ids have the best sum, and decode to the text."""
    mine = sentence_pieces.Pieces(model[0])
    score = {mine.ids[p]: s for p, s in mine.scores.items()}
    rows = {r["doc_id"]: r for r in op3_sentencepiece(spark, SF).collect()}
    cuts = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        _, best = mine.encode_both(r["text"])
        assert mine.decode(best) == r["text"].replace("▁", " ")
        got = rows[r["doc_id"]]
        assert (got["best_tokens"], got["best_crc32"], got["text_chars"]) == (len(best), sentence_pieces.crc(best), len(r["text"]))
        cuts.update(c for c in mine.cuts.findall("▁" + r["text"].replace(" ", "▁")) if all(x in mine.chars for x in c))
    for cut in sorted(cuts)[::6]:
        assert abs(sum(score[i] for i in mine._cut(cut)[1]) - plain_best_sum(mine, cut)) < 1e-6, cut


def test_encoding_edges(spark, docs, nothing):
    path = sentence_pieces.model_path()
    got = {}
    for r in sentence_pieces.decoded(sentence_pieces.encoded(docs, path), path).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got[3][0]["n_tokens"] == got[4][0]["n_tokens"] == 0 and got[6][0]["text_chars"] == 300_000 and len(got[9]) == 3 and None in got
    assert sentence_pieces.encoded(nothing, path).count() == 0


def test_query_round_trips(spark):
    import hashlib

    want = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model_path())
    for r in op3_sentencepiece(spark, SF).collect():
        t = want[r["doc_id"]]
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest() and r["ids_crc32"] == zlib.crc32(np.array(lib.encode(t), "<u4").tobytes())


def checked(pieces, tokens, window):
    """Pieces cover each document once and windows have no gaps; gives the padding."""
    seen, windows = {}, {}
    for doc, start, length, crc, total, seq, offset in pieces:
        assert zlib.crc32(tokens[doc][start : start + length].astype("<u4").tobytes()) == crc and total == len(tokens[doc]) and length > 0
        seen.setdefault(doc, []).append((start, length))
        windows.setdefault(seq, []).append((offset, length))
    for doc, t in tokens.items():
        at = 0
        for start, length in sorted(seen[doc]):
            assert start == at
            at += length
        assert at == len(t)
    padding = 0
    for some in windows.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_windows(seed):
    r = np.random.default_rng(seed)
    tokens = {i: r.integers(0, 50_000, n).astype(np.uint32) for i, n in enumerate(r.integers(1, 90, 400))}
    tokens[1000] = r.integers(0, 9, 64).astype(np.uint32)
    w, last = packing.Windows(32), packing.Windows(32, 1 << 62)
    for d, t in tokens.items():
        w.add(d, t)
        if w.n_open > 5 * seed:
            for p in w.unplaced():
                last.place(p)
    for p in w.unplaced():
        last.place(p)
    last.close()
    assert checked(w.out + last.out, tokens, 32) == 0 and w.cut == 0 and last.by_rule > 0


def test_rests_of_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_OPEN", 3)
    monkeypatch.setattr(packing, "MANY_RESTS", 40)
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    encode = packing.ByteBpe()
    tokens = {r["doc_id"]: np.append(encode(r["text"] or ""), np.uint32(1)).astype(np.uint32) for r in docs.collect()}
    assert checked([tuple(r) for r in packing.packed(docs, 256).collect()], tokens, 256) == 0


def test_sum_of_squares_choice():
    w = packing.Windows(10)
    for n in (6, 6, 3, 4):
        w.add(n, np.zeros(n, np.uint32))
    # 6 opens, 6 opens; 3 makes 9 beside a 6 (1+1 rather than 4+1); 4 fills the other 6.
    assert sorted((lvl, len(v)) for lvl, v in w.open.items() if v) == [(9, 1)] and len(w.out) == 2


def test_ids_are_those_of_tokenizers():
    import public_tokenizers as public

    exact, mine = Tokenizer.from_file(public.path("byte_bpe_50k.json")), packing.ByteBpe()
    for t in [*random_texts(1000, 9), "a<|endoftext|>b", "it's  \n\n  1234 ,.! ünïcödé"]:
        assert mine(t).tolist() == exact.encode(t, add_special_tokens=False).ids, t


def test_packing_edges(spark, docs, nothing):
    encode = packing.ByteBpe()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] != 9]
    tokens = {d: np.append(encode(t or ""), np.uint32(1)).astype(np.uint32) for d, t in rows}
    got = [tuple(r) for r in packing.packed(docs.where("doc_id IS NULL OR doc_id <> 9")).collect()]
    assert checked(got, tokens, 2048) == 0 and {g[0] for g in got if g[2] == g[4] == 1} == {3, 4}
    assert sum(r["length"] for r in packing.packed(docs).collect()) == sum(map(len, tokens.values())) + sum(len(encode(t)) + 1 for t in ("twice", "twice", "twice but not quite"))
    assert packing.packed(nothing).count() == 0
