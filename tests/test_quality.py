import re

import pytest
from pyspark.sql import functions as F

from quillmill.operators import quality as Q

GOOD = "Seven plain words stand in this line.\n" * 20


def lines(n, dotted):
    return "\n".join(["four or five words" + "." * 3 * (i < dotted) for i in range(n)])


#: Both sides of each bound: words, mean length, lines ending in dots, words with a letter.
BOUNDS = [
    ("few words", "abcd " * 49, False), ("enough words", "abcd " * 50, True), ("most words", "abcd\n" * 100_000, True), ("too many words", "abcd\n" * 100_001, False),
    ("short", "abc " * 99 + "ab", False), ("short enough", "abc " * 100, True), ("long enough", "abcdefghij\t" * 60, True), ("long", "abcdefghij " * 60 + "k" * 11, False),
    ("dots at the bound", lines(100, 30), True), ("dots beyond", lines(100, 31), False), ("dots and blanks", lines(10, 4).replace("...", "... \t") + "\n", False),
    ("dots inside", "there ... along they went\n" * 20, True), ("letters at the bound", "word " * 80 + "1234 " * 20, True), ("letters below", "word " * 79 + "1234 " * 21, False),
    ("letters anywhere", "1é2 " * 60, True), ("empty", "", False),
]


@pytest.mark.parametrize("name,text,passes", BOUNDS)
def test_quality_bounds(spark, name, text, passes):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert Q.with_quality(docs).first()["gopher_pass"] is passes


def test_quality_metrics_against_plain_python(spark):
    texts = ["", " \n ", "a", "a...", "a...\n", "a...\n\n", "x ... \r\ny....\n..", "12 ab 3c -- é", "\u00a0 a\u00a0b", "." * 50_000, "1" * 50_000 + " b"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in Q.with_quality(docs).collect():
        words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", r["text"]) if w]
        parts = (r["text"][:-1] if r["text"].endswith("\n") else r["text"]).split("\n")
        dotted = sum(p.rstrip(" \t\x0b\f\r").endswith("...") for p in parts)
        alpha = sum(any(c.isalpha() for c in w) for w in words)
        n = len(words)
        want = (n, sum(map(len, words)) / n if n else 0, dotted / len(parts), alpha / n if n else 0)
        assert (r["n_words"], r["mean_word_len"], r["ellipsis_ratio"], r["alpha_ratio"]) == pytest.approx(want), r["text"][:40]


def test_presets_differ_at_fifty(spark):
    rows = spark.createDataFrame([("x" * 50,), (" " + "x" * 49 + " ",), ("x" * 51,)], "t string")
    got = rows.select(Q.SCALAR.too_short(F.col("t")).alias("s"), Q.BATCHED.too_short(F.col("t")).alias("b")).collect()
    assert [(r["s"], r["b"]) for r in got] == [(False, True), (True, False), (False, False)]


def test_one_reason_a_row(spark):
    good = GOOD
    rows = [(1, good, "en"), (2, "tiny", "en"), (3, good, "fr"), (4, None, "en"), (5, "ab ab " * 100, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(
        {"lang_score": F.lit(1.0), "nsfw_score": F.lit(0.0), "toxic_score": F.lit(0.9) * (F.col("doc_id") == 1).cast("int"), "quality": F.lit("high"), "quality_score": F.lit(1.0)})
    out = Q.discard_reason(docs)
    assert {r["doc_id"]: r["discard_reason"] for r in out.collect()} == {1: "toxic", 2: "short", 3: "language", 4: "short", 5: "gopher"}
    assert sum(r["pct"] for r in Q.funnel(out).collect()) == pytest.approx(1)


def test_trained_models_after_an_observation(spark, sf, tmp_path):
    """Counts observed while writing leave state in the session, which no prediction may try to send to tasks."""
    from quillmill.operators import classify
    from quillmill.sources import sinks

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert tuple(sinks.rewrite_without(docs, labels.where("doc_id < 5"), "doc_id", str(tmp_path / "o")).first())[1] > 0
    assert classify.train_and_predict(docs, labels, "quality").count() == labels.join(docs, "doc_id").count()
    assert classify.score_documents(docs, labels, "toxic").where("score < 0 or score > 1").count() == 0
