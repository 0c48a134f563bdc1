"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a flow whose documents queue in a fixed shuffled order, up to ``max_epochs`` times
over. A copy's virtual finish time is its flow's cumulative tokens, itself included, over the flow's
weight. The mix serves all copies by finish time and stops at the total budget. A flow that runs dry
stops taking part, so its share passes to the others by weight, which is also what the closed-form
targets (water filling) state.

Nothing here needs one source's rows in one task: cumulative sums run over (source, hash bucket)
and get the totals of the buckets before them, and the global order is cut into ranges of finish
time that hold about equally many tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import WORD, whole_row
from quillmill.session import cut_lineage

MAX_EPOCHS = 3
#: Rows that one bucket of a prefix sum should hold.
BUCKET_ROWS = 200_000
#: Tables of sources are broadcast up to this many rows, and joined by shuffle beyond.
BROADCAST_SOURCES = 100_000
_HASH_SPACE = float(1 << 32)


def word_count(text: str = "text") -> Column:
    """Number of words (runs without ASCII white space); null: 0."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, rank, weight, source_size, target, level`` from ``(source, source_size)``.

    Weights repeat over the sources in code-point order, null last. A target is
    ``least(max_epochs * source_size, level * weight)`` with the level at which the targets
    sum to all sizes: the first level (the largest that fits), over sources sorted by capacity per weight, that the
    source at hand can still take.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(by_name).cast("long"))
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    cap = (F.lit(max_epochs) * F.col("source_size")).cast("double")
    ranked = ranked.withColumn("_cap", cap).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    fill = Window.orderBy("_ratio", "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = ranked.withColumn("_total", F.sum("source_size").over(every).cast("double")).withColumn(
        "_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    )
    level = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(every)
    return levels.withColumn("level", F.coalesce(level, F.lit(0.0))).select(
        "source", "rank", "weight", "source_size", F.least("_cap", F.col("level") * F.col("weight")).alias("target"), "level"
    )


def _queue(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """Slim rows with size and place in the shuffle."""
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count().alias("size"),
        digest.alias("place"),
        *[F.col(c).alias(f"_carry_{c}") for c in carry],
    ).withColumn("_h", F.conv(F.substring("place", 1, 8), 16, 10).cast("long"))


def _with_sources(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    right = sources.select(F.col("source").alias("_s"), "rank", "weight", "source_size", "target")
    right = F.broadcast(right) if n_sources <= BROADCAST_SOURCES else right
    return rows.join(right, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    max_epochs: int = MAX_EPOCHS,
    bucket_rows: int = BUCKET_ROWS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row a document: ``doc_id, size, source_size, target, taken, copies`` and ``carry`` columns.

    ``copies`` (0 to ``max_epochs``) is how often the mix takes the document, ``taken`` that times
    its size. Null texts have size 0; the null source is a source of its own, last in order; repeated
    rows are queued one by one. The place in the shuffle is a hash of id and text, so rows that share an id, or have
    none, are spread by their texts. Ties in finish time go by source, pass, place in the shuffle, doc_id and size, so
    reruns agree. An empty table, or one without a word, takes nothing. Columns not named are not looked at.
    """
    base = cut_lineage(_queue(docs, carry))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"), F.max("size").alias("_most"))
    sources = cut_lineage(source_targets(sizes.select("source", "source_size"), weights, max_epochs))
    facts = sizes.agg(F.sum("source_size").alias("budget"), F.sum("_n").alias("n"), F.count("*").alias("k"), F.max("_most").alias("most")).first()
    level = sources.agg(F.max("level")).first()[0] or 0.0
    budget, n = facts["budget"] or 0, facts["n"] or 0
    buckets = max(16, -(-n // bucket_rows))

    # distributed prefix sums: (source, bucket) totals first, rows inside a bucket after
    rows = _with_sources(base, sources, facts["k"]).withColumn("_b", F.floor(F.col("_h") * (buckets / _HASH_SPACE)).cast("int"))
    totals = rows.groupBy("rank", "_b").agg(F.sum("size").alias("_sum"))
    past = Window.partitionBy("rank").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("rank", "_b", F.coalesce(F.sum("_sum").over(past), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("rank", "_b").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(offsets, ["rank", "_b"]).withColumn("_upto", F.col("_offset") + F.sum("size").over(within)).drop("_sum", "_offset", "_b", "_h")
    placed = cut_lineage(placed)

    finish = lambda epoch: (F.col("source_size") * epoch + F.col("_upto")) / F.col("weight")
    order = ["_f", "rank", "_e", "place", "doc_id", "size"]
    last = None
    if budget:
        # no copy that finishes later than the level by the longest document of the lightest source can be served
        bound = level + facts["most"] / min(weights)
        copies = placed.select("*", F.explode(F.array(*[F.lit(e) for e in range(max_epochs)])).alias("_e")).withColumn("_f", finish(F.col("_e")))
        copies = copies.where(F.col("_f") <= F.lit(float(bound))).select(*order)
        ranges = max(16, -(-(n * max_epochs) // bucket_rows))
        copies = copies.withColumn("_r", F.floor(F.col("_f") * F.lit(ranges / max(level, 1.0))).cast("long"))
        sums = copies.groupBy("_r").agg(F.sum("size").alias("_sum"))
        upto = sums.select("_r", (F.sum("_sum").over(Window.orderBy("_r")) - F.col("_sum")).alias("_past"))
        inside = Window.partitionBy("_r").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        served = copies.withColumn("_in", F.sum("size").over(inside)).join(upto, "_r").where(F.col("_past") + F.col("_in") <= budget)
        last = served.agg(F.max(F.struct("_f", "rank", "_e", "place", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "size")).alias("x")).first()["x"]
    if last is None:
        taken = F.lit(0).cast("long")
    else:
        cut = F.struct(F.lit(last["_f"]).alias("_f"), F.lit(last["rank"]).cast("long").alias("rank"), F.lit(last["_e"]).alias("_e"), F.lit(last["place"]).alias("place"), F.lit(last["doc_id"]).cast("long").alias("doc_id"), F.lit(last["size"]).cast("long").alias("size"))
        taken = sum(
            (F.when(F.struct(finish(e).alias("_f"), F.col("rank"), F.lit(e).alias("_e"), F.col("place"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), F.col("size")) <= cut, 1).otherwise(0) for e in range(max_epochs)),
            F.lit(0),
        ).cast("long")
    return placed.withColumn("copies", taken).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *[F.col(f"_carry_{c}").alias(c) for c in carry]
    )


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The rows and columns of the mix: each document as often as it is taken.

    Rows find their count by id and a hash of id, source and text; repeated rows pool their counts, and the row with the
    least hash of all columns stands for those that differ elsewhere. Null and empty texts have no words: they come
    along as often as their place in the queue is served, and a table without any word gives no rows, nor does an
    empty one. Columns may have any name.
    """
    source = F.col("source").cast("string")
    key = F.xxhash64(F.col("doc_id").isNull(), source.isNull(), F.col("doc_id").cast("long"), source, F.col("text").cast("string"), F.col("text").isNull())
    slim = docs.select("doc_id", "source", "text", key.alias("key"))
    copies = mix_sources(slim, weights, max_epochs, carry=("key",)).groupBy("key", F.coalesce("doc_id", F.lit(0)).alias("id")).agg(F.sum("copies").cast("int").alias("copies"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), key.alias("key"), whole_row(docs).alias("row"))
    same = Window.partitionBy("key", "id").orderBy(F.xxhash64("row"))  # dealt as the join is, so texts move once
    one = rows.join(copies.where("copies > 0"), ["key", "id"]).withColumn("n", F.row_number().over(same)).where("n = 1")
    return one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


#: The same mix as window sums over whole tables.
MIXING_SQL = r"""
WITH q AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM q GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, (1 + (rank - 1) % 3)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM r),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT *, least(cap, coalesce(max(CASE WHEN lev <= cap / weight THEN lev END) OVER (), 0) * weight) AS target,
        sum(source_size) OVER () AS budget FROM l),
d AS (SELECT q.doc_id, q.size, q.place, t.rank, t.weight, t.source_size, t.target, t.budget,
        sum(q.size) OVER (PARTITION BY t.rank ORDER BY q.place, q.doc_id, q.size ROWS UNBOUNDED PRECEDING) AS upto,
        row_number() OVER () AS id
      FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source),
c AS (SELECT d.*, e.e, (source_size * e.e + upto)::DOUBLE / weight AS f FROM d, (VALUES (0), (1), (2)) e(e)),
g AS (SELECT *, sum(size) OVER (ORDER BY f, rank, e, place, doc_id, size ROWS UNBOUNDED PRECEDING) AS total FROM c)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       sum(CASE WHEN total <= budget THEN size ELSE 0 END)::BIGINT AS taken,
       sum(CASE WHEN total <= budget AND budget > 0 THEN 1 ELSE 0 END)::BIGINT AS copies
FROM g GROUP BY id, doc_id, size, source_size, target
"""
