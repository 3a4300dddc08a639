"""N-gram Jaccard join: exact links at similarity 0.8 and their connected components.

1. Texts with the same shingle set form a class, known by its 128-bit digest; only classes are compared.
2. Shingles are put in one order for the whole corpus: those that a mergeable Misra-Gries summary of all texts calls
   frequent come last (rarest first among them), all others by hash. Two sets of similarity 0.8 share a shingle among
   their first n - ceil(0.8 n) + 1, so classes that share none of these prefix shingles are never brought together.
   Very frequent ones are bounded in number and counted by partial sums, so their holders never meet in one task; the
   holders of the others are told from each other by one sort.
3. Under each prefix shingle a few typical classes lead: the others are held against their bitmaps, and each goes with
   the leader that it is closest to, if their exact intersection is large enough. This joins groups of near copies by as many
   comparisons as they have members. Large groups are dealt out by size and hash, with a copy of the leader in each part.
4. What a prefix shingle still holds in different components becomes tiles. The largest component of a group is held against
   the rest, never against itself. Rows are cut into cells by their sizes, and a tile is made for each two cells whose size
   bands can link. Hashed parity bitmaps bound the overlap of two rows from above: at most (n + m - popcount(x xor y)) / 2.
   Rows with a partner that passes get sharper bitmaps, and only those that pass again their sorted arrays, whose exact
   intersection decides. A tile gives links that join components, never all pairs.

Components need no other links: two rows already in one component add nothing to it.

Defined cases: null or blank texts have no shingles and are their own component; a null doc_id is never a component's
name while another member has an id; repeated doc_ids are separate rows; other columns play no part; an empty table
gives an empty result. Shingles are 64-bit hashes of their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import drop, free, materialize, short, small_batches
from graphloom.llm.components import components
from graphloom.llm.shingles import folded, folded_int, parity_bitmap, set_key, shingle_sets
from graphloom.llm.words import text_chunks

PERCENT = 80
#: Frequent shingles that are put last in the order, and counters of the summary that finds them.
MOST_FREQUENT, COUNTERS = 65_536, 200_000
#: A shingle with so many holders by the summary is counted by partial sums.
HOT = 1000
#: A part of a group that is held against one leader has about so many rows, and a group so many leaders.
PART, LEADERS = 200, 4
#: Times the bits of a bitmap that rows get which the first bitmaps let pass.
SHARP = 8
#: A cell of a tile holds about so many rows or shingles.
TILE_ROWS, TILE_SHINGLES = 256, 400_000


def links(inter, n, m):
    return 100 * inter >= PERCENT * (n + m - inter)


def prefix_length(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


# The order of shingles.


def _lowered(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A Misra-Gries step: with more than COUNTERS counts, all are lowered until no more are left."""
    if len(keys) > COUNTERS:
        counts = counts - np.partition(counts, len(counts) - COUNTERS - 1)[len(counts) - COUNTERS - 1]
        keys, counts = keys[counts > 0], counts[counts > 0]
    return keys, counts


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return _lowered(keys[first], np.add.reduceat(counts, first) if len(first) else counts)


def _summaries(batches):
    keys, counts, held, size = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

    def flush():
        some = np.sort(np.concatenate(held)) if held else np.empty(0, np.uint64)
        first = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]])) if len(some) else np.empty(0, np.int64)
        more = _lowered(some[first], np.diff(np.append(first, len(some))))
        held.clear()
        return _merged(np.concatenate([keys, more[0]]), np.concatenate([counts, more[1]]))

    for batch in text_chunks(batches):
        sets = shingle_sets(batch.column("text").to_pylist())
        held += sets
        size += sum(map(len, sets))
        if size > 2_000_000:
            keys, counts = flush()
            size = 0
    keys, counts = flush()
    keep = counts > 1
    yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), pa.array(counts[keep])], ["shingle", "n"])


class Order:
    """The frequent shingles, the place of each (rarest first) and whether it is hot."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        at = np.argsort(shingles)
        self.known, self.rank, self.hot = shingles[at], at, counts[at] >= HOT

    def prefix(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The prefix of a set: shingles that are not hot, and hot ones."""
        if not len(a):
            return a, a
        most = prefix_length(len(a))
        at = np.searchsorted(self.known, a)
        at[at == len(self.known)] = 0
        common = self.known[at] == a if len(self.known) else np.zeros(len(a), bool)
        rare = a[~common]
        if len(rare) >= most:
            return rare[:most], a[:0]
        at = at[common][np.argsort(self.rank[at[common]])][: most - len(rare)]
        return np.concatenate([rare, self.known[at[~self.hot[at]]]]), self.known[at[self.hot[at]]]


def frequent_shingles(docs: DataFrame) -> Order:
    """The order made by at most MOST_FREQUENT shingles."""
    found = docs.select("text").mapInArrow(_summaries, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = found.where("n > 2").orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).toPandas()[::-1]
    return Order(top["shingle"].to_numpy(np.int64).view(np.uint64).copy(), top["n"].to_numpy(np.int64).copy())


# Classes and what brings them together.


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)))


def short_id(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


SIGNED = "doc_id long, digest long, n long, key binary, id long, bitmap binary, hot array<long>"


def _signed(order: Order):
    def run(batches):
        for batch in text_chunks(batches):
            sets = shingle_sets(batch.column("text").to_pylist())
            keys = [set_key(s) if len(s) else None for s in sets]
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([short_id(k) if k else None for k in keys], pa.int64())]
            columns += [pa.array([parity_bitmap(s) if len(s) else None for s in sets], pa.binary()), lists([order.prefix(s)[1] for s in sets])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), *columns], [c.split()[0] for c in SIGNED.split(", ")])

    return run


def _prefixes(order: Order, most: int = 100_000):
    """id, n, prefix: the shingles of each class that are not hot. Copies in one task are told once (as far as `most` ids tell)."""

    def run(batches):
        told: set[int] = set()
        for batch in text_chunks(batches):
            fresh = []
            for s in shingle_sets(batch.column("text").to_pylist()):
                if len(s) and (name := short_id(set_key(s))) not in told:
                    told.add(name)
                    fresh.append((name, len(s), order.prefix(s)[0]))
            if len(told) > most:
                told.clear()
            ids, sizes, prefix = zip(*fresh, strict=True) if fresh else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), lists(list(prefix))], ["id", "n", "prefix"])

    return run


def _groups(docs: DataFrame, nodes: DataFrame, order: Order) -> DataFrame:
    """g, holders, id: classes that share a prefix shingle with another; two alone need sizes that can link. Shingles that bring
    the same classes together, as those of one passage do, become one: a group is named by what its members' hashes sum to.
    Short ids stand for keys on the way; two keys with one id both come back."""
    cold = docs.select("text").mapInArrow(_prefixes(order), "id long, n int, prefix array<long>").select("id", "n", F.explode("prefix").alias("shingle"))
    told = {"holders": F.count(F.lit(1)), "x": F.expr("bit_xor(xxhash64(id))"), "low": F.min("id"), "high": F.max("id"), "least": F.min("n"), "most": F.max("n")}
    shared = F.expr(f"low <> high AND (holders > 2 OR 100 * least >= {PERCENT} * most)")
    cold = cold.withColumns({k: v.over(Window.partitionBy("shingle")) for k, v in told.items()}).where(shared)
    hot = nodes.select("id", "n", F.explode("hot").alias("shingle"))
    sums = hot.groupBy("shingle").agg(*[v.alias(k) for k, v in told.items()]).where(shared)
    hot = hot.join(F.broadcast(sums), "shingle")  # at most MOST_FREQUENT rows
    name = F.xxhash64("holders", "x", "low", "high").alias("g")
    return cold.select(name, "holders", "id").unionByName(hot.select(name, "holders", "id"))


def _classes(docs: DataFrame, signed: DataFrame, order: Order) -> DataFrame:
    """key, least (doc_id), n, bitmap, groups: the classes that share a group with another."""
    nodes = signed.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("id", "n", "bitmap", "hot")])
    nodes = materialize(nodes, "nodes")
    groups = _groups(docs, nodes, order).groupBy("id").agg(F.collect_set(F.struct("g", "holders")).alias("groups"))
    out = materialize(nodes.join(groups, "id").select("key", "least", "n", "bitmap", "groups"), "classes")
    drop(nodes)
    return out


# Bitmaps.


def _xor_counts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of each row of x and each of y, some rows at a time."""
    out = np.empty((len(x), len(y)), np.int64)
    step = max(1, 2_000_000 // max(1, y.size))
    for at in range(0, len(x), step):
        out[at : at + step] = np.bitwise_count(x[at : at + step, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)
    return out


def passing(n: np.ndarray, bitmaps: list[bytes], sides: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Pairs (i, j, bound) of rows in different components whose bitmaps allow a link; sides: 0 both, else only 1 against 2."""
    width = np.array([len(b) for b in bitmaps])
    found = []
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        x = np.frombuffer(b"".join(bitmaps[i] for i in at), np.uint64).reshape(len(at), -1)
        for v in (w, 2 * w):
            to = np.flatnonzero(width == v)
            if not len(to):
                continue
            y = x
            if v != w:
                y = folded(np.frombuffer(b"".join(bitmaps[i] for i in to), np.uint64).reshape(len(to), -1))
            bound = (n[at][:, None] + n[to][None, :] - _xor_counts(x, y)) // 2
            bound = np.minimum(bound, np.minimum(n[at][:, None], n[to][None, :]))
            ok = links(bound, n[at][:, None], n[to][None, :]) & (labels[at][:, None] != labels[to][None, :])
            if v == w:
                ok &= at[:, None] < to[None, :]
            ok &= (sides[at][:, None] == 0) | (sides[at][:, None] != sides[to][None, :])
            i, j = np.nonzero(ok)
            found.append(np.stack([at[i], to[j], bound[i, j]], axis=1))
    return np.concatenate(found) if found else np.empty((0, 3), np.int64)


def overlap_bound(n: int, x: bytes, m: int, y: bytes) -> int:
    """The most that two sets have in common, by their sizes and bitmaps; -1 if that is too little for a link."""
    if 100 * min(n, m) < PERCENT * max(n, m):
        return -1
    p, q = int.from_bytes(x), int.from_bytes(y)
    while len(x) != len(y):
        if len(x) > len(y):
            p, x = folded_int(p, 8 * len(x)), x[: len(x) // 2]
        else:
            q, y = folded_int(q, 8 * len(y)), y[: len(y) // 2]
    most = min(n, m, (n + m - (p ^ q).bit_count()) // 2)
    return most if links(most, n, m) else -1


def _runs(batches, columns: list[str]):
    """Rows that follow each other with the same values of columns, as dicts of lists."""
    held: dict | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        ids = list(zip(*(rows[c] for c in columns), strict=True))
        at = 0
        while at < len(ids):
            end = at + 1
            while end < len(ids) and ids[end] == ids[at]:
                end += 1
            part = {c: v[at:end] for c, v in rows.items()}
            if held is not None and held["run"] == ids[at]:
                for c, v in part.items():
                    held[c] += v
            else:
                if held is not None:
                    yield held
                held = part | {"run": ids[at]}
            at = end
    if held is not None:
        yield held


def _dealt(rows: DataFrame, keys: list[str], *then) -> DataFrame:
    """rows with those of the same keys together, in the order of then; as many tasks as the session's shuffles have."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *then)


# Leaders.


def _led(batches):
    """a, b, score: rows of a group part and the leader that their bitmaps bring closest."""
    for part in _runs(batches, ["g", "part"]):
        keys, sizes, maps = part["key"], part["n"], part["bitmap"]
        left, out = list(dict.fromkeys(range(len(keys)))), []
        for _ in range(LEADERS):
            if len(left) < 2:
                break
            lead, rest, apart = left[0], left[1:], []
            if len(rest) <= 16:
                bounds = [overlap_bound(sizes[i], maps[i], sizes[lead], maps[lead]) for i in rest]
            else:
                got = {int(i): int(b) for i, b in _against(sizes, maps, lead, rest)}
                bounds = [got.get(i, -1) for i in rest]
            for i, b in zip(rest, bounds, strict=True):
                if b < 0:
                    apart.append(i)
                elif keys[i] != keys[lead]:
                    out.append((keys[i], keys[lead], b / (sizes[i] + sizes[lead] - b)))
            left = apart
        if out:
            a, b, score = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(score, pa.float64())], ["a", "b", "score"])


def _against(sizes: list[int], maps: list[bytes], lead: int, rest: list[int]) -> np.ndarray:
    pairs = passing(np.array([sizes[lead], *(sizes[i] for i in rest)]), [maps[lead], *(maps[i] for i in rest)], np.array([1] + [2] * len(rest)), np.arange(len(rest) + 1))
    return np.stack([np.array(rest)[pairs[:, :2].max(axis=1) - 1], pairs[:, 2]], axis=1)


def _band(n: Column) -> Column:
    """Sizes of one band differ by a factor under 100 / PERCENT."""
    return F.floor(F.log(n) / float(np.log(100 / PERCENT)))


def _leader_pairs(classes: DataFrame) -> DataFrame:
    """a, b: each class with the leader that its bitmap brings it closest to, in any of its groups."""
    rows = classes.select("key", "n", "bitmap", F.size("groups").alias("weight"), F.explode("groups").alias("x")).select("key", "n", "bitmap", "weight", "x.g", "x.holders")
    parts, large = F.expr(f"1 + holders DIV {PART}"), F.col("holders") > PART
    part = F.when(large, F.concat_ws("/", _band(F.col("n")), F.pmod(F.xxhash64("key"), parts))).otherwise("")
    members = rows.select("g", part.alias("part"), "weight", "key", "n", "bitmap")
    # The leaders of large groups, one for each band, are chosen by partial sums and sent to all parts of the band.
    best = rows.where(large).groupBy("g", _band(F.col("n")).alias("band")).agg(F.max(F.struct("weight", "key")).alias("best"), F.max("holders").alias("holders"))
    best = best.select("g", "band", F.col("best.key").alias("key"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("at"))
    lead = best.join(classes.select("key", "n", "bitmap"), "key").select("g", F.concat_ws("/", "band", "at").alias("part"), F.lit(1 << 30).alias("weight"), "key", "n", "bitmap")
    pairs = _dealt(members.unionByName(lead), ["g", "part"], F.desc("weight"), "key").mapInArrow(_led, "a binary, b binary, score double")
    return materialize(pairs.groupBy("a").agg(F.max(F.struct("score", "b")).alias("best")).select("a", "best.b"), "leaders")


# Exact sets.


def _arrays(batches):
    for batch in text_chunks(batches):
        sets = shingle_sets(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "shingles"])


def _sharp(batches):
    for batch in text_chunks(batches):
        sets = shingle_sets(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([parity_bitmap(s, SHARP) for s in sets], pa.binary())], ["key", "bitmap"])


def _with_sets(docs: DataFrame, classes: DataFrame, roles: DataFrame, run=_arrays, schema: str = "key binary, shingles binary") -> DataFrame:
    """roles (a table with the column key) with the shingles of their classes, or what run makes of them. A row of docs for each
    class is picked by a broadcast list while that is short, else by a shuffle. Rows that repeat the id of one give their set again."""
    ids = short(materialize(classes.join(roles.select("key").distinct(), "key", "left_semi").select("least").distinct(), "ids"))
    chosen = docs.join(ids, docs["doc_id"].eqNullSafe(ids["least"]), "left_semi").select("text")
    return chosen.mapInArrow(run, schema).join(short(roles, 100_000), "key")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def _verified(batches):
    """a, b: members that link with their leader, which comes first among the rows of a part."""
    at, lead = None, np.empty(0, np.uint64)
    for batch in batches:
        out = []
        names = zip(*(batch.column(c).to_pylist() for c in ("lead", "part", "member", "key")), strict=True)
        for i, (name, part, member, key) in enumerate(names):
            mine = np.frombuffer(batch.column("shingles")[i].as_buffer(), np.uint64)
            if not member:
                at, lead = (name, part), mine.copy()
            elif at == (name, part) and links(_shared(mine, lead), len(mine), len(lead)):
                out.append((key, name))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], ["a", "b"])


def _stars(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b: the pairs that link. A leader's set goes once to each part of its members, not to each member."""
    parts = pairs.groupBy(F.col("b").alias("lead")).agg(F.expr(f"1 + count(*) DIV {PART}").alias("parts"))
    leads = parts.select("lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("member"), F.col("lead").alias("key"))
    part = F.pmod(F.xxhash64("a"), F.col("parts"))
    members = pairs.join(parts, pairs["b"] == parts["lead"]).select("lead", part.alias("part"), F.lit(1).alias("member"), F.col("a").alias("key"))
    roles = materialize(leads.unionByName(members), "roles")
    sets = _dealt(_with_sets(docs, classes, roles), ["lead", "part"], "member")
    out = materialize(sets.select("lead", "part", "member", "key", "shingles").mapInArrow(_verified, "a binary, b binary"), "stars")
    drop(roles)
    return out


# Tiles.


def _open_rows(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """g, holders, key, n, label, rest: members of groups that hold several components; rest: not of the group's largest."""
    rows = classes.select("key", "n", "groups").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    rows = rows.select("key", "n", "label", F.explode("groups").alias("x")).select("key", "n", "label", "x.g", "x.holders")
    each = rows.groupBy("g", "label").agg(F.count(F.lit(1)).alias("rows"), F.max("holders").alias("holders"))
    mixed = each.groupBy("g").agg(F.max(F.struct("rows", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("labels"), F.max("holders").alias("most")).where("labels > 1")
    parts = F.expr(f"1 + most DIV {PART}")
    mixed = short(materialize(mixed.select("g", "main", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")), "mixed"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.expr(f"1 + holders DIV {PART}")))
    return materialize(rows.join(mixed, ["g", "part"]).select("g", "holders", "key", "n", "label", (F.col("label") != F.col("main")).cast("int").alias("rest")), "open")


def _tile_rows(rows: DataFrame) -> DataFrame:
    """g, low, high, cell, key, label, n: a row for each tile that a class takes part in. A group of few rows is one tile."""
    out = ["g", "low", "high", "cell", "key", "label", "n"]
    few = F.col("holders") <= TILE_ROWS // 2
    small = rows.where(few).select("g", *[F.lit(0).cast("long").alias(c) for c in out[1:4]], "key", "label", "n")
    large = rows.where(~few).withColumn("size", F.floor(2 * F.log("n") / float(np.log(100 / PERCENT))).cast("long"))
    spans = large.groupBy("g", "rest", "size").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.expr(f"CAST(1 + count(*) DIV {TILE_ROWS} + sum(n) DIV {TILE_SHINGLES} AS LONG)").alias("cells"))
    spans = short(materialize(spans, "spans"))
    cell = lambda at: (F.col("size") * (1 << 33) + at * 2 + F.col("rest")).alias("cell")
    large = large.join(spans, ["g", "rest", "size"]).select("g", "key", "label", "n", cell(F.pmod(F.xxhash64("key", F.lit(7)), F.col("cells"))))
    cells = spans.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).select("g", "rest", "least", "most", cell(F.col("at")))
    one, two = cells.where("rest = 1").alias("p"), cells.alias("q")
    meet = F.expr(f"100 * p.most >= {PERCENT} * q.least AND 100 * q.most >= {PERCENT} * p.least AND (q.rest = 0 OR p.cell <= q.cell)")
    tiles = one.join(two, (F.col("p.g") == F.col("q.g")) & meet).select(F.col("p.g").alias("g"), F.col("p.cell").alias("low"), F.col("q.cell").alias("high"))
    sides = tiles.withColumn("cell", F.explode(F.array_distinct(F.array("low", "high"))))
    return small.unionByName(large.join(sides, ["g", "cell"]).select(*out))


def _pairs_of(tile: dict) -> np.ndarray:
    """Pairs (i, j, bound) of a tile that may link components."""
    alone = tile["low"][0] == tile["high"][0]
    if len(tile["n"]) == 2:
        (n, m), (x, y) = tile["n"], tile["bitmap"]
        ok = tile["label"][0] != tile["label"][1] and (alone or tile["cell"][0] != tile["cell"][1])
        most = overlap_bound(n, x, m, y) if ok else -1
        return np.array([[0, 1, most]] if most >= 0 else np.empty((0, 3)), np.int64)
    cells = np.array(tile["cell"])
    sides = np.zeros(len(cells), int) if alone else np.where(cells == tile["low"][0], 1, 2)
    names = {v: k for k, v in enumerate(dict.fromkeys(tile["label"]))}
    return passing(np.array(tile["n"]), tile["bitmap"], sides, np.array([names[v] for v in tile["label"]]))


TILE = ["g", "low", "high"]
HOPEFUL = "g long, low long, high long, cell long, key binary, label binary, n long, bitmap binary"
COLUMNS = [c.split()[0] for c in HOPEFUL.split(", ")]


def _hopeful(batches):
    """Rows of each tile that have a partner which the bitmaps allow."""
    for tile in _runs(batches, TILE):
        if len(tile["n"]) > 1 and len(pairs := _pairs_of(tile)):
            at = np.unique(pairs[:, :2])
            yield pa.RecordBatch.from_pydict({c: [tile[c][i] for i in at] for c in COLUMNS})


def _links(batches):
    """Exact links that join the components which a tile holds."""
    for tile in _runs(batches, TILE):
        if len(tile["n"]) < 2:
            continue
        pairs, root, sizes = _pairs_of(tile), {}, np.array(tile["n"])

        def top(x, root=root):
            while root.get(x, x) != x:
                root[x] = x = root.get(root[x], root[x])
            return x

        arrays = [np.frombuffer(s, np.uint64) for s in tile["shingles"]]
        out: list[tuple[bytes, bytes]] = []
        for i, j, _ in pairs[np.argsort(-pairs[:, 2] / (sizes[pairs[:, 0]] + sizes[pairs[:, 1]]), kind="stable")]:
            a, b = top(tile["label"][i]), top(tile["label"][j])
            if a != b and links(_shared(arrays[i], arrays[j]), len(arrays[i]), len(arrays[j])):
                root[a] = b
                out.append((tile["key"][i], tile["key"][j]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], ["a", "b"])


def _tile_links(docs: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    rows = _open_rows(classes, labels)
    tiles = _tile_rows(rows).join(classes.select("key", "bitmap"), "key").select(*COLUMNS)
    first = materialize(_dealt(tiles, TILE).mapInArrow(_hopeful, HOPEFUL).drop("bitmap"), "hopeful")
    sharp = _with_sets(docs, classes, first, _sharp, "key binary, bitmap binary").select(*COLUMNS).distinct()
    hopeful = materialize(_dealt(sharp, TILE).mapInArrow(_hopeful, HOPEFUL), "hopeful")
    drop(rows, first)
    sets = _with_sets(docs, classes, hopeful).select(*COLUMNS, "shingles")
    out = materialize(_dealt(sets, TILE).mapInArrow(_links, "a binary, b binary"), "links")
    drop(hopeful)
    return out


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest (of the text), n_shingles, component_id, key (the class) and component (its smallest key) for each document."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with small_batches(docs.sparkSession):
        order = frequent_shingles(docs)
        signed = materialize(docs.withColumn("digest", text_digest(F.col("text"))).mapInArrow(_signed(order), SIGNED), "signed")
        classes = _classes(docs, signed, order)
        pairs = _leader_pairs(classes)
        stars = _stars(docs, classes, pairs)
        drop(pairs)
        labels = components(stars, roots=False).select(F.col("node").alias("key"), F.col("component").alias("label"))
        found = components(stars.unionByName(_tile_links(docs, classes, labels)), roots=False)
        drop(classes, labels, stars)
    named = signed.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least")).join(found, F.col("key") == found["node"], "left")
    named = named.select("key", F.coalesce("component", "key").alias("component"), "least")
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = named.join(lowest, "component").select("key", "component", "component_id")
    out = signed.select("doc_id", "digest", "n", "key").join(classes, "key", "left")
    return out.select("doc_id", "digest", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "key", "component")


def text_digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id. Texts without shingles, and components without
    any id, stay whole."""
    fate = near_copies(docs).where("key IS NOT NULL AND component_id IS NOT NULL")
    fate = materialize(fate.select("doc_id", "digest", "component", "component_id"), "fate")
    groups = fate.groupBy("component").agg(F.count(F.when(F.col("doc_id") == F.col("component_id"), 1)).alias("winners"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    listed = fate.join(groups, "component").withColumn("again", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))).where("NOT again OR winners > 1")
    mine, text, again, component = (free(c, docs) for c in ("lost_id", "lost_text", "again", "component"))
    listed = listed.groupBy(F.col("doc_id").alias(mine), F.col("digest").alias(text)).agg(F.max("again").alias(again), F.max("component").alias(component))
    listed = short(materialize(listed, "lost"))
    joined = docs.join(listed, F.col("doc_id").cast("long").eqNullSafe(F.col(mine)) & (text_digest(F.col("text")) == F.col(text)), "left")
    once = joined.where(F.col(text).isNull()).select(*docs.columns)
    twice = joined.where(F.col(again)).groupBy(component).agg(F.max(F.struct(*docs.columns)).alias(mine)).select(f"{mine}.*")
    return once.unionByName(twice)
