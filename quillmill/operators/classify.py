"""Trained classifiers: language profiles by naive Bayes over n-gram tables, quality and toxicity by Spark ML."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import one_line
from quillmill.operators.batches import slices
from quillmill.operators.skew import small
from quillmill.session import cut_lineage, shared_folder


def held_out(key: str, share: int = 5) -> Column:
    """A fifth of the rows by hash of the key."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % share == 0


def _letters(text: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of all texts, their code points side by side in one number, and the text of each."""
    rows = [t or "" for t in texts.to_pylist()]
    code = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(t) for t in rows])
    if len(code) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = row[2:] == row[:-2]
    return (code[:-2] << 42 | code[1:-1] << 21 | code[2:])[inside], row[:-2][inside]


def _spelled(grams: np.ndarray) -> list[str]:
    return ["".join(map(chr, (g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF))) for g in grams.tolist()]


def _numbers(grams: list[str]) -> np.ndarray:
    return np.array([ord(a) << 42 | ord(b) << 21 | ord(c) for a, b, c in grams], np.int64)


def language_profiles(docs: DataFrame, top: int = 400) -> DataFrame:
    """``gram, lang, logp``: the ``top`` most frequent trigrams of each language, smoothed by one.

    Tasks add up the trigrams of a few megabytes of texts by language, so what is shuffled are counts.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096, 1 << 19):
            names = part.column("lang").dictionary_encode()
            grams, row = _trigrams(part.column("text"))
            of = names.indices.to_numpy(zero_copy_only=False)[row]
            for i, lang in enumerate(names.dictionary.to_pylist()):
                found, n = np.unique(grams[of == i], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n)], ["lang", "number", "n"])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(_spelled(batch.column("number").to_numpy()), pa.string()), batch.column("n")], ["lang", "gram", "n"])

    letters = docs.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), _letters(F.col("text")).alias("text"))
    counts = letters.mapInArrow(counted, "lang string, number long, n long").groupBy("lang", "number").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts.mapInArrow(spelled, "lang string, gram string, n long"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    return best.join(small(total), "lang").select("gram", "lang", F.log((F.col("n") + 1) / (F.col("total") + F.col("kinds"))).alias("logp"))


#: Rows of a profile table that is sent to every task; a larger one is joined.
MOST_SENT = 1_000_000


def identify_language(docs: DataFrame, profiles: DataFrame, floor: float = -12.0, most_sent: int = MOST_SENT) -> DataFrame:
    """``doc_id, label, score``: naive Bayes over profile trigrams; blank texts are unknown with score 0.

    The profile table holds ``top`` rows a language and is sent to every task if that is few: then each text is scored where it
    lies. A larger one meets each document's trigrams and their counts in a join.
    """
    docs, profiles = docs.select("doc_id", _letters(F.col("text")).alias("text")), cut_lineage(profiles)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if profiles.count() > most_sent:
        return _joined_language(docs, profiles, floor)
    table = profiles.orderBy("lang", "gram").toArrow()
    langs = table.column("lang").combine_chunks().dictionary_encode()
    names, number = langs.dictionary.to_pylist(), _numbers(table.column("gram").to_pylist())
    order = np.argsort(number, kind="stable")
    sent = docs.sparkSession.sparkContext.broadcast((names, number[order], langs.indices.to_numpy()[order], table.column("logp").to_numpy()[order] - floor))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, number, lang, weight = sent.value
        known, first, many = np.unique(number, return_index=True, return_counts=True)
        for part in slices(batches, 1024, 1 << 19):
            labels, scores = ["unknown"] * part.num_rows, np.zeros(part.num_rows)
            grams, row = _trigrams(part.column("text"))
            at = np.minimum(np.searchsorted(known, grams), max(len(known) - 1, 0))
            use = np.flatnonzero(known[at] == grams) if len(known) else at[:0]
            at, row = at[use], row[use]
            hits = many[at]  # one for each language that has the trigram
            entry = np.repeat(first[at], hits) + np.arange(int(hits.sum())) - np.repeat(np.cumsum(hits) - hits, hits)
            cells, of = np.unique(np.repeat(row, hits) * len(names) + lang[entry], return_inverse=True)
            sums = np.bincount(of, weight[entry], len(cells))
            rows = cells // max(len(names), 1)
            begin = np.flatnonzero(np.diff(rows, prepend=-1))
            for low, high in zip(begin.tolist(), np.append(begin, len(cells))[1:].tolist(), strict=True):
                s = sums[low:high]
                best = len(s) - 1 - int(s[::-1].argmax())  # of equal ones the last name
                labels[rows[low]], scores[rows[low]] = names[cells[low + best] % len(names)], 1 / np.exp(s - s[best]).sum()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(labels, pa.string()), pa.array(scores)], ["doc_id", "label", "score"])

    found = docs.mapInArrow(scored, f"doc_id {kind}, label string, score double")
    return found.select("doc_id", fold_language(F.col("label")).alias("label"), "score")


def _joined_language(docs: DataFrame, profiles: DataFrame, floor: float) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024, 1 << 19):
            grams, row = _trigrams(part.column("text"))
            order = np.lexsort((grams, row))
            grams, row = grams[order], row[order]
            begin = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])])) if len(grams) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row[begin])), pa.array(_spelled(grams[begin]), pa.string()), pa.array(np.diff(np.append(begin, len(grams))))], ["doc_id", "gram", "n"])

    hits = docs.mapInArrow(counted, f"doc_id {kind}, gram string, n long").join(profiles, "gram").groupBy("doc_id", "lang").agg(F.sum(F.col("n") * (F.col("logp") - floor)).alias("s"))
    w = Window.partitionBy("doc_id")
    odds = F.col("s") - F.max("s").over(w)
    soft = hits.withColumn("p", F.exp(odds) / F.sum(F.exp(odds)).over(w))
    best = soft.groupBy("doc_id").agg(F.max(F.struct("s", "lang", "p")).alias("x")).select("doc_id", F.col("x.lang").alias("label"), F.col("x.p").alias("score"))
    return docs.select("doc_id").join(best, "doc_id", "left").select("doc_id", fold_language(F.coalesce("label", F.lit("unknown"))).alias("label"), F.coalesce("score", F.lit(0.0)).alias("score"))


def fold_language(label: Column) -> Column:
    """Regional and script variants of Chinese and English under one name."""
    return F.when(label.startswith("zh"), "zh").when(label.startswith("en"), "en").otherwise(label)


def filter_by_label(scored: DataFrame, label: str, threshold: float, inverse: bool = False) -> DataFrame:
    """The rows a classifier gave ``label`` with at least ``threshold``; inverse: all others, unscored ones among them."""
    given = F.coalesce((F.col("label") == label) & (F.col("score") >= threshold), F.lit(False))
    return scored.where(~given if inverse else given)


def text_pipeline(dims: int = 1 << 14):
    """Lower-cased words and bigrams, hashed, into a logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler

    return Pipeline(stages=[
        RegexTokenizer(inputCol="line", outputCol="words", pattern=r"[^\p{L}\p{N}]+"),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        HashingTF(inputCol="words", outputCol="f1", numFeatures=dims),
        HashingTF(inputCol="pairs", outputCol="f2", numFeatures=dims),
        VectorAssembler(inputCols=["f1", "f2"], outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label", maxIter=20, regParam=0.01),
    ])


def _fitted(rows: DataFrame):
    """The pipeline fitted to rows, written down and read back: a fitted one carries a summary of its training, and with that
    the session and what belongs to it, into every task that predicts."""
    from pyspark.ml import PipelineModel

    path = f"{shared_folder(rows.sparkSession)}/classifier-{uuid.uuid4().hex}"
    text_pipeline().fit(rows).write().save(path)
    return PipelineModel.load(path)


def train_and_predict(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, held_out, label, pred, score``: fit on labelled rows not held out, predict all labelled ones."""
    from pyspark.ml.functions import vector_to_array

    rows = docs.select("doc_id", one_line(F.col("text")).alias("line")).join(labels.select("doc_id", F.col(label).cast("double").alias("label")), "doc_id").withColumn("held_out", held_out("doc_id"))
    model = _fitted(rows.where(~F.col("held_out")))
    scored = model.transform(rows)
    return scored.select("doc_id", "held_out", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("pred"), vector_to_array("probability")[1].alias("score"))


def score_documents(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, pred, score`` of every document by a model of all the labelled ones."""
    from pyspark.ml.functions import vector_to_array

    lines = docs.select("doc_id", one_line(F.coalesce("text", F.lit(""))).alias("line"))
    model = _fitted(lines.join(labels.select("doc_id", F.col(label).cast("double").alias("label")), "doc_id"))
    return model.transform(lines).select("doc_id", F.col("prediction").cast("int").alias("pred"), vector_to_array("probability")[1].alias("score"))


def confusion(predictions: DataFrame) -> DataFrame:
    """``label, pred, n`` of held-out rows."""
    return predictions.where("held_out").groupBy("label", "pred").agg(F.count("*").alias("n"))
