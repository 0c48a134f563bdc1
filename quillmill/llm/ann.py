"""Approximate nearest neighbours by shifted Hilbert orderings of projected vectors.

Vectors that are equal make one class, which keeps its smallest ids; classes are what is indexed. Each of ``CURVES``
orderings projects them on ``PROJECTED`` random orthogonal directions, turns each coordinate into its quantile, shifts the
cube by an offset of its own and walks it along a Hilbert curve. The keys are range-partitioned by Spark and cut into
tiles of consecutive ranks. A query looks at its own tile and the two beside it in every ordering, by vectors
rounded to bytes; the best of all orderings are merged and reranked by the exact inner product in double precision.

A tile holds ``TILE_SCALE * n ** TILE_POWER`` of n vectors (at least as many as are asked for), so a query's comparisons
grow more slowly than the table and are fewer than those of an exact search beyond some eight thousand vectors.
The power was chosen on vectors without any structure in 64 dimensions, where nothing but reach gives recall (see the
README). Quantiles are fitted on a bounded sample, every row is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.operators.skew import join_keyed
from quillmill.session import cut_lineage

TOP = 20
QUERY_STEP = 20
CURVES = 64
PROJECTED = 10
BITS = 6
#: Rows of a tile: scale times a power of the number of vectors.
TILE_SCALE, TILE_POWER = 0.0642, 0.7
#: Candidates beyond the wanted ones that are kept for the exact ranking, of one curve and of all.
SLACK_CURVE, SLACK = 4, 12
#: Rows whose coordinates' quantiles are taken.
FIT_ROWS = 4096
#: The share of the cube that a coordinate takes; its curve's shift moves it within the rest.
SPAN = 0.9
SEED = 20240607


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer cells (Skilling's transform)."""
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    level = 1 << (bits - 1)
    while level > 1:
        rest = level - 1
        for i, axis in enumerate(axes):
            high = (axis & level) != 0
            swap = np.where(high, 0, (axes[0] ^ axis) & rest)
            axes[0] = np.where(high, axes[0] ^ rest, axes[0] ^ swap)
            axes[i] = axes[i] if i == 0 else axis ^ swap
        level >>= 1
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(cells), np.int64)
    level = 1 << (bits - 1)
    while level > 1:
        turn = np.where(axes[-1] & level, turn ^ (level - 1), turn)
        level >>= 1
    key = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ turn) >> b) & 1)
    return key


class Curves:
    """Directions, shifts and quantile edges of every ordering."""

    def __init__(self, sample: np.ndarray, dim: int, curves: int, projected: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        self.bits, self.projected = bits, min(projected, dim)
        self.directions = np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, : self.projected] for _ in range(curves)], axis=1)
        self.shifts = rng.random((curves, self.projected))
        self.edges = np.quantile(sample @ self.directions, np.linspace(0, 1, 257)[1:-1], axis=0)

    def keys(self, vectors: np.ndarray) -> Iterator[np.ndarray]:
        """The place on each curve of every row."""
        at = vectors @ self.directions
        rank = np.stack([np.searchsorted(self.edges[:, j], at[:, j], side="right") for j in range(at.shape[1])], axis=1) / 256
        for c, shift in enumerate(self.shifts):
            own = rank[:, c * self.projected : (c + 1) * self.projected]
            yield hilbert_keys(((SPAN * own + (1 - SPAN) * shift) * (1 << self.bits)).astype(np.int64), self.bits)


def tile_rows(n: int, top: int = TOP) -> int:
    return max(top, math.ceil(TILE_SCALE * n**TILE_POWER))


def comparisons(n: int, top: int = TOP, curves: int = CURVES) -> int:
    """Vectors that one query is compared with, counted once for each ordering; an exact search takes n."""
    return curves * min(n, 3 * tile_rows(n, top))


def valid_vectors(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, embedding, dim, h1, h2`` of the rows that take part.

    Null vectors, empty and zero ones and such with null or non-finite components take no part. Rows that share an id,
    and rows without one, are candidates like any other. h1 and h2 are hashes of the vector.
    """
    kind = embeddings.schema[embedding].dataType
    element = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    e = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{element}>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    e = e.where(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    return e.withColumns({"dim": F.size("embedding"), "h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(7), F.col("embedding"))})


def inner_product(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def _key_rows(batches: Iterator[pa.RecordBatch], curves: Curves, dim: int) -> Iterator[pa.RecordBatch]:
    """A row a vector and curve, with the vector rounded to bytes."""
    names = ["curve", "key", "cid", "asked", "scale", "vec"]
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            vectors = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            scale = np.abs(vectors).max(axis=1) / 127
            packed = pa.array([v.tobytes() for v in np.rint(vectors / scale[:, None]).astype(np.int8)], pa.binary())
            scales = pa.array(scale)
            for c, keys in enumerate(curves.keys(vectors)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), c, np.int32)), pa.array(keys), part.column("cid"), part.column("asked"), scales, packed], names)


class _Run:
    """Consecutive ranks of one curve, as arrays."""

    def __init__(self, rank: int, parts: list[tuple[np.ndarray, ...]]):
        self.cid, self.asked, self.scale, vecs = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.vec = vecs.astype(np.float32)
        self.rank = rank + np.arange(len(self.cid))


def _runs(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """``curve, (cid, asked, scale, vec)`` of each batch's stretch of one curve."""
    for batch in batches:
        curve = batch.column("curve").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(curve)) + 1).tolist(), len(curve)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                part = batch.slice(a, b - a)
                vec = np.frombuffer(b"".join(part.column("vec").to_pylist()), np.int8).reshape(-1, dim)
                yield int(curve[a]), (part.column("cid").to_numpy(), part.column("asked").to_numpy(zero_copy_only=False), part.column("scale").to_numpy(), vec)


_FOUND = (("query", pa.int64()), ("cids", pa.binary()), ("scores", pa.binary()))
_FOUND_SCHEMA = "query long, cids binary, scores binary"


def _best(q_cid: np.ndarray, q_vec: np.ndarray, cid: np.ndarray, vec: np.ndarray, scale: np.ndarray, keep: int) -> list[tuple[int, bytes, bytes]]:
    """Each query's best candidates by rounded vectors (in units of the query's own scale), itself left out."""
    score = (q_vec @ vec.T) * scale.astype(np.float32)
    score[q_cid[:, None] == cid[None]] = -np.inf
    if score.shape[1] > keep:
        at = np.argpartition(score, -keep, axis=1)[:, -keep:]
        score, cid = np.take_along_axis(score, at, axis=1), cid[at]
    else:
        cid = np.broadcast_to(cid, score.shape)
    return [(int(q), c[s > -np.inf].tobytes(), s[s > -np.inf].tobytes()) for q, c, s in zip(q_cid, cid, score, strict=True)]


def _found_batch(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FOUND, strict=True)], [n for n, _ in _FOUND])


def _search(batches: Iterator[pa.RecordBatch], starts: dict[tuple[int, int], int], tile: int, dim: int, keep: int) -> Iterator[pa.RecordBatch]:
    """Queries against the tiles beside them, as far as these lie in the same partition."""
    part = TaskContext.get().partitionId()

    def search(run: _Run, done: int, last: int) -> pa.RecordBatch:
        """Of the queries in tiles ``done`` to ``last``."""
        tiles, rows = run.rank // tile, []
        for t in np.unique(tiles[run.asked & (tiles >= done) & (tiles <= last)]):
            a, b = np.searchsorted(tiles, (t - 1, t + 2))
            own = np.flatnonzero(run.asked[a:b] & (tiles[a:b] == t)) + a
            rows += _best(run.cid[own], run.vec[own], run.cid[a:b], run.vec[a:b], run.scale[a:b], keep)
        return _found_batch(rows)

    held: list[tuple[np.ndarray, ...]] = []
    curve, rank, size, done = None, 0, 0, 0
    for c, arrays in _runs(batches, dim):
        if c != curve:
            if held:
                yield search(_Run(rank, held), done, 1 << 62)
            curve, held, size, rank = c, [], 0, starts[part, c]
            done = rank // tile
        held.append(arrays)
        size += len(arrays[0])
        if size >= 32 * tile:  # all but the last two tiles have what they need; these two stay
            run = _Run(rank, held)
            last = int(run.rank[-1]) // tile - 1
            yield search(run, done, last - 1)
            keep_from = int(np.searchsorted(run.rank // tile, last - 1))
            held = [tuple(x[keep_from:] for x in (run.cid, run.asked, run.scale, run.vec.astype(np.int8)))]
            rank, size, done = rank + keep_from, size - keep_from, last
    if held:
        yield search(_Run(rank, held), done, 1 << 62)


_EDGE = (("curve", pa.int32()), ("tile", pa.int64()), ("part", pa.int32()), ("cids", pa.binary()), ("scales", pa.binary()), ("vecs", pa.binary()), ("asked", pa.binary()))
_EDGE_SCHEMA = "curve int, tile long, part int, cids binary, scales binary, vecs binary, asked binary"


def _edges(batches: Iterator[pa.RecordBatch], spans: dict[tuple[int, int], tuple[int, int, int]], tile: int, dim: int) -> Iterator[pa.RecordBatch]:
    """The two tiles at each end of a partition's ranks, unless the curve itself ends there."""
    part, at, before = TaskContext.get().partitionId(), 0, None
    for c, (cid, asked, scale, vec) in _runs(batches, dim):
        low, high, n = spans[part, c]
        at = low if c != before else at
        before = c
        tiles = (at + np.arange(len(cid))) // tile
        at += len(cid)
        wanted = np.zeros(len(cid), bool)
        if low > 0:
            wanted |= tiles <= low // tile + 1
        if high < n:
            wanted |= tiles >= (high - 1) // tile - 1
        rows = []
        for t in np.unique(tiles[wanted]):
            own = tiles == t
            rows.append((c, int(t), part, cid[own].tobytes(), scale[own].tobytes(), vec[own].tobytes(), asked[own].astype(np.int8).tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*rows, strict=True), _EDGE, strict=True)], [x for x, _ in _EDGE])


def _search_edges(batches: Iterator[pa.RecordBatch], dim: int, keep: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            vec = np.frombuffer(row["vecs"], np.int8).reshape(-1, dim).astype(np.float32)
            own = np.frombuffer(row["asked"], np.int8).astype(bool)
            q_vec = np.frombuffer(row["q_vecs"], np.int8).reshape(-1, dim)[own].astype(np.float32)
            q_cid = np.frombuffer(row["q_cids"], np.int64)[own]
            if len(q_cid):
                yield _found_batch(_best(q_cid, q_vec, np.frombuffer(row["cids"], np.int64), vec, np.frombuffer(row["scales"], np.float64), keep))


def _merge(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """``query, cid`` of the best of all orderings."""
    for batch in batches:
        queries, cids = [], []
        for query, found in zip(batch.column("query").to_pylist(), batch.column("found").to_pylist(), strict=True):
            cid = np.frombuffer(b"".join(x["cids"] for x in found), np.int64)
            score = np.frombuffer(b"".join(x["scores"] for x in found), np.float32)
            cid, first = np.unique(cid, return_index=True)
            cid = cid[np.argsort(-score[first], kind="stable")[:keep]]
            queries.append(np.full(len(cid), query))
            cids.append(cid)
        if queries:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(queries), pa.int64()), pa.array(np.concatenate(cids), pa.int64())], ["query", "cid"])


def _expand(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """Ids of the classes found, the query's own row left out, ties to the smaller id."""
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for row in batch.to_pylist():
            own = list(row["ids"])
            if row["query_id"] in own:
                own.remove(row["query_id"])
            found = [(row["self"], i) for i in own] + [(x["score"], i) for x in row["others"] or () for i in x["ids"]]
            found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
            for rank, (score, i) in enumerate(found[:top], 1):
                for column, value in zip(rows, (row["query_id"], rank, i, score), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["query_id", "rank", "vec_id", "score"])


_RESULT = "query_id long, rank int, vec_id long, score double"


def _classes(vectors: DataFrame, top: int, step: int) -> DataFrame:
    """``cid, h1, h2, embedding, ids, n_queries`` of the distinct vectors; ids: the smallest ``top`` + 1, null last."""
    by = Window.partitionBy("h1", "h2").orderBy(F.col("vec_id").asc_nulls_last())
    few = vectors.withColumn("r", F.row_number().over(by)).where(F.col("r") <= top + 1)
    each = few.groupBy("h1", "h2").agg(F.any_value("embedding").alias("embedding"), F.array_sort(F.collect_list(F.struct("r", "vec_id"))).alias("ids"))
    asked = vectors.where(F.col("vec_id") % step == 0).groupBy("h1", "h2").agg(F.count("*").alias("n_queries"))
    each = each.join(asked, ["h1", "h2"], "left")
    return cut_lineage(each.select(
        F.monotonically_increasing_id().alias("cid"), "h1", "h2", "embedding", F.transform("ids", lambda x: x["vec_id"]).alias("ids"), F.coalesce("n_queries", F.lit(0)).alias("n_queries")
    ))


def _candidates(classes: DataFrame, n: int, dim: int, top: int, curves: int, projected: int) -> DataFrame:
    """``query, cid``: for each class with a query the classes most like it that the curves find."""
    spark = classes.sparkSession
    place = F.pmod(F.xxhash64("h1"), F.lit(1 << 20))
    thin = classes.where(place < int(min(1.0, 1.2 * FIT_ROWS / n + 64 / n) * (1 << 20)) + 1).orderBy(F.xxhash64("h1"), "h2").limit(FIT_ROWS)
    sample = np.array([r["embedding"] for r in thin.select("embedding").collect()], float).reshape(-1, dim)
    model = spark.sparkContext.broadcast(Curves(sample, dim, curves, projected, BITS, SEED))
    keyed = classes.select("cid", (F.col("n_queries") > 0).alias("asked"), "embedding").mapInArrow(
        lambda it: _key_rows(it, model.value, dim), "curve int, key long, cid long, asked boolean, scale double, vec binary"
    )
    order = ["curve", "key", "cid"]
    placed = cut_lineage(keyed.repartitionByRange(*order).sortWithinPartitions(*order))

    # first and last rank of a partition's part of each curve: at most one row a partition and one a curve
    counts = placed.groupBy(F.spark_partition_id().alias("part"), "curve").count().orderBy("curve", "part").collect()
    spans, upto = {}, dict.fromkeys(range(curves), 0)
    for r in counts:
        spans[r["part"], r["curve"]] = (upto[r["curve"]], upto[r["curve"]] + r["count"], n)
        upto[r["curve"]] += r["count"]
    starts = {k: low for k, (low, _, _) in spans.items()}
    tile, keep = tile_rows(n, top), top + SLACK_CURVE
    inside = placed.mapInArrow(lambda it: _search(it, starts, tile, dim, keep), _FOUND_SCHEMA)
    edges = cut_lineage(placed.mapInArrow(lambda it: _edges(it, spans, tile, dim), _EDGE_SCHEMA))
    near = F.explode(F.array(*[F.col("tile") + d for d in (-1, 0, 1)])).alias("tile")
    asking = edges.select("curve", near, F.col("part").alias("q_part"), F.col("cids").alias("q_cids"), F.col("vecs").alias("q_vecs"), "asked")
    across = edges.drop("asked").join(asking, ["curve", "tile"]).where("part != q_part").drop("part", "q_part")
    found = inside.unionByName(across.mapInArrow(lambda it: _search_edges(it, dim, keep), _FOUND_SCHEMA))
    return found.groupBy("query").agg(F.collect_list(F.struct("cids", "scores")).alias("found")).mapInArrow(lambda it: _merge(it, top + SLACK), "query long, cid long")


def nearest_neighbours(embeddings: DataFrame, top: int = TOP, step: int = QUERY_STEP, curves: int = CURVES, projected: int = PROJECTED) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found of every query row (vec_id divisible by ``step``).

    Nearest by inner product; ties to the smaller vec_id (null last); all candidates if there are fewer than ``top``. See
    ``valid_vectors`` for what takes part. Vectors are compared with those of their own length, an inner product having
    no meaning across lengths. Rows that repeat an id are queries and candidates of their own. A table without a
    valid vector gives no rows; other columns are not looked at.
    """
    spark = embeddings.sparkSession
    vectors = valid_vectors(embeddings)
    lengths = [r["dim"] for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).where("n > 1").orderBy("dim").collect()]
    out = spark.createDataFrame([], _RESULT)
    for dim in lengths:
        mine = vectors.where(F.col("dim") == dim)
        classes = _classes(mine, top, step)
        facts = classes.agg(F.count("*").alias("n"), F.sum("n_queries").alias("queries")).first()
        if not facts["queries"]:
            continue
        pairs = cut_lineage(_candidates(classes, facts["n"], dim, top, curves, projected))
        # the exact ranking
        there = classes.select("cid", F.col("embedding").alias("theirs"), "ids")
        here = classes.where("n_queries > 0").select(F.col("cid").alias("query"), "embedding")
        scored = pairs.join(there, "cid").join(here, "query").select("query", F.struct((-inner_product(F.col("embedding"), F.col("theirs"))).alias("minus"), F.col("ids")[0].alias("low"), "ids").alias("x"))
        best = scored.groupBy("query").agg(F.slice(F.array_sort(F.collect_list("x")), 1, top).alias("xs"))
        best = best.select(F.col("query").alias("cid"), F.transform("xs", lambda x: F.struct((-x["minus"]).alias("score"), x["ids"].alias("ids"))).alias("others"))
        asked = classes.where("n_queries > 0").join(best, "cid", "left")
        results = cut_lineage(asked.select(F.struct("h1", "h2").alias("at"), "n_queries", "ids", inner_product(F.col("embedding"), F.col("embedding")).alias("self"), "others"))
        queries = mine.where(F.col("vec_id") % step == 0).select(F.struct("h1", "h2").alias("at"), F.col("vec_id").alias("query_id"))
        joined = join_keyed(queries, results, "at", "n_queries", facts["queries"])
        out = out.unionByName(joined.select("query_id", "ids", "self", "others").mapInArrow(lambda it: _expand(it, top), _RESULT))
    return out
