"""Approximate nearest neighbours with a hierarchical k-means tree.

Rows with one vector form a class, of which only the k + 1 smallest ids can be among anybody's k nearest. The tree is
fitted on a bounded sample of classes; every class is put into a leaf. A query walks the tree best bin first: a priority
queue holds branches by their distance, and the nearest is opened next, until enough leaves have been visited. How many
are enough is calibrated: for some queries the exact neighbours are found over all rows, and the visits are widened until
the wanted recall is reached. Leaves and the queries that visit them meet in tiles of bounded size, so a leaf may hold any
part of all rows.

The largest inner product is made a smallest distance by one more component, sqrt(M^2 - |v|^2), with M the largest norm.
Scores are inner products of the original vectors in double precision.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, nor do rows without an id; rows that repeat an id and vector count once, and no row with the query's id is its
neighbour; ties go to the smaller id; with fewer than k candidates all are returned; other columns play no part; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialize

K = 20
#: The tree is fitted on at most SAMPLE classes; a leaf is meant to hold LEAF classes, but its share of the sample is at least LEAST.
SAMPLE, LEAF, LEAST, BRANCHES = 20_000, 1024, 8, 8
#: Queries whose exact neighbours calibrate the visits, and the recall that these must reach.
CALIBRATION, RECALL = 256, 0.95
#: Vectors and queries of a tile.
TILE_VECTORS, TILE_QUERIES = 4096, 2048


class Tree:
    """Centres of each inner node's children; a leaf is its number."""

    def __init__(self, x: np.ndarray, leaf_size: int, seed: int = 7):
        self.rng, self.size, self.n_leaves = np.random.default_rng(seed), leaf_size, 0
        self.root = self._split(x)

    def _split(self, x: np.ndarray):
        groups = []
        if len(x) > self.size:
            centres, near = self._means(x, min(BRANCHES, -(-len(x) // self.size) + 1))
            groups = [x[near == g] for g in range(len(centres))]
        if sum(len(g) > 0 for g in groups) < 2:
            self.n_leaves += 1
            return self.n_leaves - 1
        return centres, [self._split(g) for g in groups]

    def _means(self, x: np.ndarray, k: int):
        centres = x[self.rng.choice(len(x), k, replace=False)]
        for _ in range(8):
            near = distances(x, centres).argmin(axis=1)
            found = np.unique(near)
            centres = np.stack([x[near == g].mean(axis=0) for g in found])
        near = distances(x, centres).argmin(axis=1)
        found, near = np.unique(near, return_inverse=True)
        return centres[found], near

    def leaves(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if isinstance(node, int):
                out[at] = node
            else:
                near = distances(x[at], node[0]).argmin(axis=1)
                todo += [(child, at[near == g]) for g, child in enumerate(node[1]) if (near == g).any()]
        return out

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """The first leaves that best-bin-first search opens."""
        out, count = [], 0
        queue = [(0.0, 0, self.root)]
        while queue and len(out) < most:
            _, _, node = heapq.heappop(queue)
            while not isinstance(node, int):
                far = ((node[0] - q) ** 2).sum(axis=1)
                best = int(far.argmin())
                for g, child in enumerate(node[1]):
                    if g != best:
                        count += 1
                        heapq.heappush(queue, (float(far[g]), count, child))
                node = node[1][best]
            out.append(node)
        return out


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]


def widened(x: np.ndarray, largest: float) -> np.ndarray:
    """With the component that turns inner products into distances."""
    return np.concatenate([x, np.sqrt(np.maximum(0.0, largest - (x * x).sum(axis=1)))[:, None]], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _valid(column: Column) -> Column:
    fine = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return column.isNotNull() & (F.size(column) > 0) & fine & F.exists(column, lambda v: v != 0)


def _keyed(batches):
    for b in batches:
        if b.num_rows:
            x = _matrix(b.column("v")) + 0.0
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([xxhash.xxh3_128_digest(r.tobytes()) for r in x], pa.binary()), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel()), pa.array((x * x).sum(axis=1))], ["id", "key", "v", "norm"])


def _best(scores: np.ndarray, ids: list[list[int]], k: int) -> tuple[list[int], list[float]]:
    """The k best (score, id) of classes with these scores; each class may bring several ids."""
    at = np.argsort(-scores, kind="stable")
    pairs: list[tuple[float, int]] = []
    for i in at:
        if len(pairs) >= k and scores[i] < pairs[k - 1][0]:
            break
        pairs += [(scores[i], x) for x in ids[i]]
        pairs.sort(key=lambda p: (-p[0], p[1]))
        del pairs[k:]
    return [x for _, x in pairs], [s for s, _ in pairs]


def _tile_best(q: np.ndarray, matrix: np.ndarray, ids: list[list[int]]):
    """(ids, scores) of the best of a tile for each query. A quick product chooses; the chosen are scored one by one."""
    rough = q @ matrix.T
    most = min(K + 5, len(matrix))
    top = np.argpartition(-rough, most - 1, axis=1)[:, :most]
    least = np.take_along_axis(rough, top, axis=1).min(axis=1) - 1e-12
    tied = (rough >= least[:, None]).sum(axis=1) > most
    single = np.array([len(x) == 1 for x in ids])
    first = np.array([x[0] for x in ids])[top]
    scores = np.stack([(matrix[cols] * one).sum(axis=1) for cols, one in zip(top, q, strict=True)])
    order = np.lexsort((first, -scores), axis=1)[:, : K + 1]
    first, scores = np.take_along_axis(first, order, axis=1), np.take_along_axis(scores, order, axis=1)
    for r, cols in enumerate(top):
        if tied[r] or not single[cols].all():
            # Ties at the edge of the quick choice stay in, and classes bring all their ids.
            cols = np.flatnonzero(rough[r] >= least[r])
            yield _best((matrix[cols] * q[r]).sum(axis=1), [ids[c] for c in cols], K + 1)
        else:
            yield first[r], scores[r]


def _neighbours(batches):
    """A tile's vectors (side 0) come before its queries (side 1); for each query its best in the tile."""
    tile, vectors, ids, matrix = None, [], [], None
    for b in batches:
        tiles = list(zip(*(b.column(c).to_pylist() for c in ("leaf", "vb", "qb")), strict=True))
        x, sides, lists, keys = _matrix(b.column("v")) if b.num_rows else None, b.column("side").to_pylist(), b.column("ids").to_pylist(), b.column("key").to_pylist()
        out, at = ([], [], []), 0
        while at < len(tiles):
            end = at + 1
            while end < len(tiles) and tiles[end] == tiles[at] and sides[end] == sides[at]:
                end += 1
            if tiles[at] != tile:
                tile, vectors, ids, matrix = tiles[at], [], [], None
            if sides[at] == 0:
                vectors.append(x[at:end])
                ids += lists[at:end]
            elif vectors:
                if matrix is None:
                    matrix = np.concatenate(vectors)
                for q0 in range(at, end, 256):
                    q1 = min(end, q0 + 256)
                    for r, found in enumerate(_tile_best(x[q0:q1], matrix, ids)):
                        for o, v in zip(out, (keys[q0 + r], *found), strict=True):
                            o.append(v)
            at = end
        yield _results(list(zip(*out, strict=True)))


def _merged(batches):
    """Rows of one key follow each other; the best of all of them."""
    key, pairs = None, []

    def done():
        pairs.sort(key=lambda p: (-p[0], p[1]))
        return key, [i for _, i in pairs[: K + 1]], [s for s, _ in pairs[: K + 1]]

    for b in batches:
        out = []
        for k, ids, scores in zip(*(b.column(c).to_pylist() for c in ("key", "ids", "scores")), strict=True):
            if k != key:
                if key is not None:
                    out.append(done())
                key, pairs = k, []
            pairs += zip(scores, ids, strict=True)
            if len(pairs) > 50 * K:
                pairs = [*zip(*done()[:0:-1], strict=True)]
        yield _results(out)
    yield _results([done()] if key is not None else [])


def _results(rows):
    keys, ids, scores = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], ["key", "ids", "scores"])


def _calibrated(tree: Tree, largest: float, indexed: DataFrame, queries: DataFrame) -> int:
    """The least number of visits that finds RECALL of the calibration queries' exact neighbours."""
    rows = queries.orderBy(F.xxhash64("key")).limit(CALIBRATION).select("key", "v").toPandas()
    if not len(rows):
        return 1
    keys, q = list(map(bytes, rows["key"])), np.stack(rows["v"].map(np.asarray).to_list())

    def exact(batches):
        for b in batches:
            if not b.num_rows:
                continue
            scores, own, leaf = _matrix(b.column("v")) @ q.T, b.column("key").to_pylist(), np.asarray(b.column("leaf").to_pylist(), np.int64)
            most = min(K + 1, len(scores))
            top = np.argpartition(-scores, most - 1, axis=0)[:most]
            of = np.tile(np.arange(len(q)), (most, 1))
            keep = np.array([[own[i] != keys[j] for j, i in enumerate(row)] for row in top])
            yield pa.RecordBatch.from_arrays([pa.array(of[keep], pa.int64()), pa.array(leaf[top[keep]], pa.int64()), pa.array(np.take_along_axis(scores, top, axis=0)[keep], pa.float64())], ["q", "leaf", "score"])

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "leaf"))
    found = indexed.select("key", "v", "leaf").mapInArrow(exact, "q long, leaf long, score double").withColumn("rank", rank).where(F.col("rank") <= K).groupBy("q", "leaf").count().toPandas()
    at = np.zeros(tree.n_leaves)
    wide = widened(q, largest)
    orders = [{leaf: k for k, leaf in enumerate(tree.visits(x, tree.n_leaves))} for x in wide]
    for j, leaf, n in found.itertuples(index=False):
        at[orders[j][leaf]] += n
    reached, visits = np.cumsum(at) / max(1, at.sum()), 1
    while visits < tree.n_leaves and reached[visits - 1] < RECALL:
        visits += 1
    return visits


def nearest(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the K nearest of each row for which is_query holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v"), is_query.alias("asked")).where(F.col("id").isNotNull() & _valid(F.col("v")))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (usual["n"] if usual else 0))
    keyed = rows.select("id", "v").mapInArrow(_keyed, "id long, key binary, v array<double>, norm double")
    first = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    classes = keyed.distinct().withColumn("k", first).where(F.col("k") <= K + 1).groupBy("key").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"), F.max("norm").alias("norm"))
    classes = materialize(classes, "classes")
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("norm"), F.lit(0.0)).alias("norm")).first()
    largest = float(size["norm"])

    sample = classes.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").toPandas()["v"]
    x = widened(np.stack(sample.map(np.asarray).to_list()), largest) if len(sample) else np.zeros((0, 1))
    leaf_size = max(LEAST, -(-LEAF * len(x) // max(1, size["n"])))
    tree = Tree(x, leaf_size)

    def put(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.leaves(widened(_matrix(b.column("v")), largest)), pa.int64())], [*b.schema.names, "leaf"])

    indexed = materialize(classes.select("key", "v", "ids").mapInArrow(put, "key binary, v array<double>, ids array<long>, leaf long"), "indexed")
    asked = materialize(rows.where("asked").select("id", "v").mapInArrow(_keyed, "id long, key binary, v array<double>, norm double").select(F.col("id").alias("query_id"), "key", "v").distinct(), "asked")
    queries = asked.groupBy("key").agg(F.first("v").alias("v"))
    visits = _calibrated(tree, largest, indexed, queries)

    def walk(batches):
        for b in batches:
            if b.num_rows:
                found = [tree.visits(q, visits) for q in widened(_matrix(b.column("v")), largest)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int64()))], [*b.schema.names, "leaves"])

    walked = materialize(queries.mapInArrow(walk, "key binary, v array<double>, leaves array<long>"), "walked").select("key", "v", F.explode("leaves").alias("leaf"))
    # One row for each leaf, of which the sample's size bounds the number.
    sizes = indexed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / TILE_VECTORS).alias("vbs")).join(walked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / TILE_QUERIES).alias("qbs")), "leaf")
    sizes = F.broadcast(sizes)
    mine = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    one = indexed.join(sizes, "leaf").select("leaf", (mine % F.col("vbs")).alias("vb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("qbs") - 1)).alias("qb"), F.lit(0).alias("side"), "key", "v", "ids")
    two = walked.join(sizes, "leaf").select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("vbs") - 1)).alias("vb"), (mine % F.col("qbs")).alias("qb"), F.lit(1).alias("side"), "key", "v", F.lit(None).cast("array<long>").alias("ids"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles = one.unionByName(two).repartition(parts, "leaf", "vb", "qb").sortWithinPartitions("leaf", "vb", "qb", "side")
    schema = "key binary, ids array<long>, scores array<double>"
    found = tiles.mapInArrow(_neighbours, schema).repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_merged, schema)
    pairs = F.filter(F.arrays_zip("ids", "scores"), lambda p: p["ids"] != F.col("query_id"))
    out = asked.select("query_id", "key").join(found, "key").select("query_id", F.posexplode(F.slice(pairs, 1, K)).alias("k", "p"))
    return out.select("query_id", (F.col("k") + 1).alias("rank"), F.col("p.ids").alias("vec_id"), F.col("p.scores").alias("score"))
