"""Treebank tokens, reservoirs, the record table function, documents out of chunks."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmill.functions.tokens import treebank_tokens
from quillmill.operators import quality, sampling
from quillmill.sources import records
from quillmill.streaming import remainders, streams


@pytest.mark.parametrize(("text", "tokens"), [
    ("I don't know.", "I do n't know ."), ("They'll say it's John's, won't they?", "They 'll say it 's John 's , wo n't they ?"), ("(so).", "( so ) ."), ('He said "no."', 'He said " no . "'),
    ("costs $1,000.50 at 10:30, ok", "costs $ 1,000.50 at 10:30 , ok"), ("Wait... what--now", "Wait ... what -- now"), ("the U.S. economy grew. It did", "the U.S. economy grew . It did"), ("J. Smith came", "J. Smith came"),
    ("well-known O'Neil", "well-known O'Neil"), ("the dogs' bowl", "the dogs ' bowl"), ("Ärger über 5%.", "Ärger über 5 % ."), ("a.b e.g. this", "a.b e.g. this"), ("", ""), (" \n ", ""), ("DON'T", "DO N'T"), ("end.\n\nNext", "end . Next"),
])
def test_tokens(spark, text, tokens):
    assert " ".join(spark.createDataFrame([(text,)], "text string").select(treebank_tokens(F.col("text"))).first()[0]) == tokens


def test_where_words_and_tokens_disagree(spark):
    """Fifty words between blanks pass; the same text is too full of marks as tokens, and one of 30 contractions is long enough only as tokens."""
    marks, short = "word , ; " * 20 + "more " * 10, "it's well " * 15 + "over there now then"
    rows = spark.createDataFrame([(0, marks), (1, short), (2, None)], "doc_id long, text string")
    words = {r["doc_id"]: r for r in quality.with_quality(rows).collect()}
    tokens = {r["doc_id"]: r for r in quality.with_quality(rows, treebank=True).collect()}
    assert words[0]["n_words"] == tokens[0]["n_words"] == 70 and words[1]["n_words"] == 34 and tokens[1]["n_words"] == 49 and tokens[2]["n_words"] == 0
    glued = spark.createDataFrame([(0, "word,word;word!" * 17 + " end" * 40)], "doc_id long, text string")
    assert quality.with_quality(glued).first()["gopher_pass"] is False and quality.with_quality(glued, treebank=True).first()["alpha_ratio"] < 0.8


def test_reservoir_is_uniform_and_merges(spark):
    df = spark.range(40).withColumn("w", F.lit(1.0)).repartition(7)
    drawn = Counter(r["id"] for seed in range(60) for r in sampling.reservoir(df, "id", 10, seed=seed).collect())
    assert sum(drawn.values()) == 600 and len(drawn) == 40 and max(drawn.values()) < 32 and min(drawn.values()) > 3
    assert "Sort" not in sampling.reservoir(df, "id", 10)._jdf.queryExecution().executedPlan().toString()
    one = {r["id"] for r in sampling.reservoir(df.coalesce(1), "id", 10).collect()}
    assert one == {r["id"] for r in sampling.reservoir(df, "id", 10).collect()}
    assert sampling.reservoir(df, "id", 100).count() == 40 and sampling.reservoir(df.limit(0), "id", 5).count() == 0 and sampling.reservoir(df, "id", 0).count() == 0


def test_reservoir_goes_by_weight(spark):
    df = spark.range(300).withColumn("w", F.when(F.col("id") % 3 == 0, 9.0).when(F.col("id") == 1, None).when(F.col("id") == 2, -1.0).otherwise(1.0))
    drawn = [r["id"] for seed in range(8) for r in sampling.reservoir(df, "id", 40, F.col("w"), seed).collect()]
    heavy = sum(i % 3 == 0 for i in drawn) / len(drawn)
    assert len(drawn) == 320 and 0.65 < heavy < 0.9 and not {1, 2} & set(drawn)


def test_reservoir_of_a_stream(spark, tmp_path):
    df = spark.range(500)
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = streams.arriving(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)
    streams.for_each_batch(stream, sampling.reservoir_sink(str(tmp_path / "out"), "id", 20), str(tmp_path / "progress")).awaitTermination()
    assert {r["id"] for r in sampling.read_reservoir(spark, str(tmp_path / "out")).collect()} == {r["id"] for r in sampling.reservoir(df, "id", 20).collect()}
    assert sampling.read_reservoir(spark, str(tmp_path / "nothing")) is None


def test_record_function(spark):
    records.register(spark)
    spark.createDataFrame([(1, "a|b||c"), (2, ""), (3, None)], "k int, t string").createOrReplaceTempView("texts")
    rows = spark.sql("SELECT k, record_no, start, record FROM texts, LATERAL split_records(t, '|')").collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 0, "a"), (1, 1, 2, "b"), (1, 2, 4, ""), (1, 3, 5, "c"), (2, 0, 0, "")]
    assert spark.sql("SELECT record FROM texts, LATERAL split_records(t, '||', false)").count() == 2
    for call in ("split_records(t, '')", "split_records(t, t)", "split_records(k, '|')", "split_records(t, '|', 3)"):
        with pytest.raises(Exception, match="has to be"):
            spark.sql(f"SELECT * FROM texts, LATERAL {call}").collect()


def test_chunks_in_any_order(spark, tmp_path):
    """Chunks cut anywhere, over files that arrive one by one and out of order; some come twice, the last one closes the source."""
    rng = random.Random(3)
    want, rows = set(), []
    for source in ("a", "b", "c"):
        texts = ["".join(rng.choice("xyz<|>é") for _ in range(rng.randint(0, 40))) for _ in range(12)] + ["tail"]
        whole = "<END>".join(texts)
        cuts = sorted({0, len(whole), *(rng.randrange(len(whole)) for _ in range(25))})
        chunks = [(source, i, whole[x:y], y == len(whole)) for i, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False))]
        rows += [*chunks, *rng.sample(chunks, 4)]
        want |= {(source, i, t) for i, t in enumerate(texts)}
    rng.shuffle(rows)
    schema = "source string, chunk_no long, text string, last boolean"
    for i in range(5):
        spark.createDataFrame(rows[i::5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.arriving(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files_per_trigger=1)
    assert {tuple(r) for r in streams.run_available(remainders.documents(stream, "<END>"), "chunks").collect()} == want
    with pytest.raises(ValueError):
        remainders.Remainders("")
