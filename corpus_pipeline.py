"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Language identification (rejected documents go), SimHash near-duplicates (one of each group
stays), personal data (masked), mixing of sources to target weights, packing into windows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.langid import drop_rejected
from quillmill.llm.mixing import mixed_documents
from quillmill.llm.packing import pack_documents
from quillmill.llm.pii import mask_documents
from quillmill.llm.simhash import keep_one_of_each
from quillmill.session import load, shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; null, letterless and unlike texts go.

    Repeated rows stay or go together, very long texts are read whole, extra columns come along under any name. An
    empty table, or one without a label, gives no rows.
    """
    return drop_rejected(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the smallest doc_id (null last); of repeated rows one.

    Null and empty texts are one group; extra columns come along under any name; an empty table gives no rows.
    """
    return keep_one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with personal data masked in the text and ``n_chars``, where there is one, counted anew.

    Null and empty texts stay as they are (a null text has null n_chars), repeated rows stay repeated, spans that
    overlap become one mark; extra columns come along under any name; an empty table gives no rows.
    """
    masked = mask_documents(docs)
    return masked.withColumn("n_chars", F.length("text").cast(masked.schema["n_chars"].dataType)) if "n_chars" in masked.columns else masked


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, up to three times.

    The null source is one of its own; null and empty texts have size 0; repeated rows pool their counts; ties are
    settled by hashes, so reruns agree. Extra columns come along under any name; an empty table gives no rows.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places in the windows; the only stage that doesn't return documents.

    A null or empty text is one piece, very long ones are cut at whole windows, repeated rows are packed one by one;
    an empty table gives no rows.
    """
    return pack_documents(docs)


STAGES = [
    ("language_id", language),
    ("simhash", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

#: Language models, span classifiers and tokenizers are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what they hand on lies in the shared folder and goes once read.

    The last stage's rows stay there for the caller, who may still read them.
    """
    shared = shared_folder(spark)
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = f"{shared}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = out
    return docs
