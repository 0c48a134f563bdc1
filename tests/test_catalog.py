"""Every query of the core catalog against its SQL on the smallest tables, plan shapes, streams."""

import duckdb
import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillmill.plans import catalog
from quillmill.streaming import streams

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect())
    cursor = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in cursor.fetchall())
    assert got == want


def test_queries_without_sql(spark, sf):
    """What SQL can't say: the rows' number, and bounds that trained models and learnt vocabularies have to keep."""
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    got = {name: catalog.QUERIES[name](spark, sf).cache() for name in set(catalog.QUERIES) - set(catalog.ORACLES)}
    assert {k: v.count() for k, v in got.items() if k in ("langid_predict", "filter_cascade_trained", "html_extract", "bpe_vocab", "vocab_overlap", "bpe_compression")} == {
        "langid_predict": n, "filter_cascade_trained": n, "html_extract": 50, "bpe_vocab": 400, "vocab_overlap": 2, "bpe_compression": 1}
    assert {r["discard_reason"] for r in got["filter_cascade_trained"].collect()} >= {None, "language"}
    assert got["bpe_compression"].first()["ratio"] > 1.5
    assert got["html_extract"].where("text is null or text like '%<p>%'").count() == 0
    langs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    assert got["langid_predict"].join(langs, "doc_id").where("label = lang").count() > 0.9 * n
    for name in ("quality_predict", "toxic_predict"):
        seen = got[name].where("not held_out")
        assert seen.where("label = pred").count() > 0.9 * seen.count() and got[name].where("score < 0 or score > 1").count() == 0
    assert got["classifier_confusion"].agg(F.sum("n")).first()[0] == got["quality_predict"].where("held_out").count()


def test_native_queries_have_no_python(spark, sf):
    for name in ("gopher_pass", "pii_mask_all_counts", "line_dedup_unique", "filter_cascade_kept"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan


def test_filters_reach_the_scan(spark, sf):
    plan = spark.read.parquet(f"{sf}/orders.parquet").where("o_totalprice > 1000").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in plan


def test_entry_and_keys(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_equals_batch(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    scores = {"lang_score": F.lit(1.0), "nsfw_score": F.lit(0.0), "toxic_score": F.lit(0.0), "quality": F.lit("high"), "quality_score": F.lit(1.0)}
    stream = streams.cascade_stream(streams.arriving(spark, str(tmp_path / "in"), docs.schema).withColumns(scores))
    got = streams.run_available(stream.select("doc_id", "discard_reason"), "t_cascade")
    want = streams.cascade_stream(docs.withColumns(scores)).select("doc_id", "discard_reason")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_stream_windows_and_dedup(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: streams.arriving(spark, str(tmp_path / "in"), events.schema)
    windows = streams.run_available(streams.tumbling(source()), "t_windows")
    assert 0 < windows.agg(F.sum("n")).first()[0] <= 1000
    unique = streams.run_available(streams.exact_dedup_stream(source(), "ts", "event_type", "40 days"), "t_unique")
    assert unique.count() == events.select("event_type").distinct().count()
