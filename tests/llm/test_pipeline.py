from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmill.llm import langid, mixing, pii, queries
from test_operators import check_pieces, slow_groups, slow_mix, texts_of


def through_the_stages(spark, docs, folder, labelled=None):
    """Each stage on all that the one before kept, against brute force; returns the rows that came out of each."""
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        if name == "language_id" and labelled is not None:
            out = langid.drop_rejected(docs, langid.fit(labelled))
        else:
            out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(f"{folder}/{name}")
        before, docs = docs, spark.read.parquet(f"{folder}/{name}")
        rows_ = before.collect()
        if name == "language_id":
            model = langid.fit(before if labelled is None else labelled)
            want = [r for r in rows_ if not model.predict([r["text"]])[0][2]]
            assert sorted(docs.collect(), key=str) == sorted(want, key=str)
        elif name == "simhash":
            kept = sorted((r["doc_id"] for r in docs.collect()), key=str)
            assert kept == sorted({c for _, _, c in slow_groups(texts_of(before))}, key=str)
        elif name == "pii":
            model = pii.fit(before)
            spans = lambda t: pii.base_spans(t) + pii.added_spans(t, pii.base_spans(t), model)
            masked = [(r["doc_id"], r["text"] and pii.mask(r["text"], spans(r["text"]))) for r in rows_]
            assert sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str) == sorted(masked, key=str)
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in docs.collect())
        elif name == "mixing":
            taken = Counter()
            for (d, _, _), n in slow_mix([(r["doc_id"], r["text"], r["source"]) for r in rows_]).items():
                taken[d] += n
            got = Counter()
            for r in docs.select("doc_id", mixing.word_count().alias("n")).collect():
                got[r["doc_id"]] += r["n"]
            assert +got == +taken
        else:
            check_pieces(docs.collect(), texts_of(before))
        if name != "packing":
            assert docs.columns == columns
        counts.append(docs.count())
    return counts


def test_stages_equal_brute_force(spark, documents, tmp_path):
    counts = through_the_stages(spark, documents, tmp_path)
    assert counts[0] > counts[1] > 0


def test_stages_on_odd_rows(spark, documents, odd, tmp_path):
    """Nulls, empty, repeated and very long texts among clean ones, with a column named like a helper."""
    mixed = documents.limit(40).unionByName(documents.limit(3)).unionByName(odd.where("doc_id <> 6 or doc_id is null").withColumn("doc_id", F.col("doc_id") + 1000).select(documents.columns))
    mixed = mixed.withColumn("row_key", F.concat(F.lit("k"), F.col("doc_id").cast("string")))
    counts = through_the_stages(spark, mixed, tmp_path, documents)
    assert all(counts)


def test_stages_without_a_model_to_reject(spark, odd, tmp_path):
    """The stages after the first on rows that it would have dropped, then all of them on an empty table."""
    docs = odd
    for name, stage in corpus_pipeline.STAGES[1:]:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() > 0
    empty = odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, empty, "").write.parquet(str(tmp_path / f"empty-{name}"))
        empty = spark.read.schema(stage(spark, empty, "").schema).parquet(str(tmp_path / f"empty-{name}"))
        assert empty.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cursor = c.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, cursor.fetchall()))
