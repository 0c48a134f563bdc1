"""Relational extras over the star schema and the events: joins, grouping sets, windows, sets, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.operators.relational import asof_join, range_join
from quillmill.plans.registry import Catalog
from quillmill.plans.text import _METRICS, _PASS
from quillmill.session import load, shared_folder
from quillmill.sources import records
from quillmill.streaming import remainders, streams

query = Catalog()


@query("pricing_summary", "lineitem", sql="""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*)::BIGINT AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(lineitem):
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return lineitem.where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(revenue, 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("revenue_by_nation", "lineitem", "orders", "customer", "nation", "region", sql="""SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def revenue_by_nation(lineitem, orders, customer, nation, region):
    slim = lineitem.select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"))
    by_order = slim.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return by_order.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name", "n_name").agg(F.round(F.sum("x"), 2).alias("revenue"))


@query("customers_without_orders", "customer", "orders", sql="SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def customers_without_orders(customer, orders):
    return customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("customers_with_orders", "customer", "orders", sql="SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def customers_with_orders(customer, orders):
    return customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("orders_per_customer", "customer", "orders", sql="SELECT c_custkey, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def orders_per_customer(customer, orders):
    return customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("cube_segments", "customer", sql="SELECT c_mktsegment, c_nationkey, count(*)::BIGINT AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def cube_segments(customer):
    return customer.cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))


@query("rollup_status", "orders", sql="SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_status(orders):
    return orders.rollup("o_orderstatus", "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("grouping_sets", sql="SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("top_orders", "orders", sql="SELECT o_custkey, o_orderkey, r::INTEGER AS r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def top_orders(orders):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return orders.withColumn("r", F.row_number().over(w)).where("r <= 2").select("o_custkey", "o_orderkey", "r")


@query("running_total", "orders", sql="SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders")
def running_total(orders):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), F.lag("o_orderkey").over(w).alias("before"))


@query("set_operations", "customer", "supplier", sql="""SELECT 'both' AS op, count(*)::BIGINT AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'either', count(*)::BIGINT FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'first', count(*)::BIGINT FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)""")
def set_operations(customer, supplier):
    a, b = customer.select(F.col("c_nationkey").alias("k")), supplier.select(F.col("s_nationkey").alias("k"))
    count = lambda name, df: df.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
    return count("both", a.intersect(b)).unionByName(count("either", a.union(b).distinct())).unionByName(count("first", a.subtract(b)))


@query("asof_events", "events", sql="""SELECT c.event_id, p.value AS asof_value FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON c.user_id = p.user_id AND c.ts >= p.ts""")
def asof_events(events):
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value"))
    return asof_join(clicks, bought, "user_id", "ts", "value").select("event_id", "asof_value")


@query("price_bands", "part", sql="SELECT p_partkey, band FROM part JOIN (SELECT unnest(range(100)) AS band) b ON p_retailprice >= band * 25 AND p_retailprice < band * 25 + 40")
def price_bands(part):
    bands = part.sparkSession.range(100).select(F.col("id").alias("band"), (F.col("id") * 25).alias("low"), (F.col("id") * 25 + 40).alias("high"))
    return range_join(part.select("p_partkey", "p_retailprice"), bands, "p_retailprice", "low", "high", 25.0).select("p_partkey", "band")


@query("tumbling_counts", "events", sql="SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(events):
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query("user_sessions", "events", sql="""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 minute THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT user_id, min(ts) AS session_start, count(*)::BIGINT AS n FROM s GROUP BY user_id, s""")
def user_sessions(events):
    return events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


@query("pivot_types", "events", sql="SELECT user_id, count(CASE WHEN event_type = 'view' THEN 1 END)::BIGINT AS view, count(CASE WHEN event_type = 'click' THEN 1 END)::BIGINT AS click, count(CASE WHEN event_type = 'purchase' THEN 1 END)::BIGINT AS purchase FROM events GROUP BY 1")
def pivot_types(events):
    wide = events.groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).count()
    return wide.select("user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("view", "click", "purchase")])


_STREAM_REASON = rf"CASE WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 50 THEN 'short' WHEN lang <> 'en' THEN 'language' WHEN NOT {_PASS} THEN 'gopher' END"


def _arriving_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as arriving files, with scores that pass."""
    docs = load(spark, sf_dir, "documents")
    scores = {"lang_score": F.lit(1.0), "nsfw_score": F.lit(0.0), "toxic_score": F.lit(0.0), "quality": F.lit("high"), "quality_score": F.lit(1.0)}
    return streams.arriving(spark, f"{sf_dir}/documents.parquet*", docs.schema).withColumns(scores)


@query("stream_cascade", sql=f"SELECT doc_id, {_STREAM_REASON} AS discard_reason FROM ({_METRICS})")
def stream_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.run_available(streams.cascade_stream(_arriving_documents(spark, sf_dir)).select("doc_id", "discard_reason"), "cascade")


@query("stream_funnel", sql=f"SELECT coalesce({_STREAM_REASON}, 'kept') AS reason, count(*)::BIGINT AS count FROM ({_METRICS}) GROUP BY 1")
def stream_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.run_available(streams.running_funnel(streams.cascade_stream(_arriving_documents(spark, sf_dir))), "funnel", "complete")


def _arriving_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    return streams.arriving(spark, f"{sf_dir}/events.parquet*", events.schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_windows", sql="SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.run_available(streams.tumbling(_arriving_events(spark, sf_dir)), "windows", "complete")
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_dedup", sql="SELECT DISTINCT props AS props FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each text within the watermark, which here spans all events."""
    return streams.run_available(streams.exact_dedup_stream(_arriving_events(spark, sf_dir), "ts", "props", "400 days").select("props"), "unique")


@query("split_records", "pages", sql="""SELECT page_id, (i - 1)::INTEGER AS record_no, (list_sum(list_transform(w[1:i - 1], lambda x: length(x) + 3)))::BIGINT AS start, md5(w[i]) AS record_md5
FROM (SELECT page_id, string_split(html, '<p>') AS w, unnest(range(1, len(string_split(html, '<p>')) + 1)) AS i FROM pages)""".replace("(list_sum", "coalesce(list_sum").replace(" + 3)))::", " + 3)), 0)::"))
def split_records(pages):
    """A table function called from SQL, beside each page's row."""
    records.register(pages.sparkSession)
    return pages.sparkSession.sql("SELECT page_id, record_no, start, md5(record) AS record_md5 FROM {pages}, LATERAL split_records(html, '<p>')", pages=pages)


@query("stream_documents", "documents", sql="SELECT doc_id % 7 AS source, (row_number() OVER (PARTITION BY doc_id % 7 ORDER BY doc_id) - 1)::BIGINT AS document_no, md5(text) AS text_md5 FROM documents")
def stream_documents(docs):
    """Seven sources' documents as chunks of 997 characters, which cut texts and delimiters, over files that arrive one by one."""
    spark, path, mark = docs.sparkSession, f"{shared_folder(docs.sparkSession)}/chunks-{uuid.uuid4().hex}", "<|endoftext|>"
    whole = F.concat("text", F.lit(mark))
    pieces = docs.select((F.col("doc_id") % 7).alias("source"), "doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length(whole) - 1) / 997)), lambda i: F.substring(whole, (i * 997 + 1).cast("int"), F.lit(997)))).alias("i", "text"))
    order = Window.partitionBy("source").orderBy("doc_id", "i")
    numbered = pieces.select("source", (F.row_number().over(order) - 1).cast("long").alias("chunk_no"), "text").withColumn("last", F.lit(False))
    numbered.repartition(5, F.col("chunk_no") % 5).write.parquet(path)
    arrived = remainders.documents(streams.arriving(spark, path, numbered.schema, files_per_trigger=1), mark)
    return streams.run_available(arrived, "documents").select("source", "document_no", F.md5("text").alias("text_md5"))
