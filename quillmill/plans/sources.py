"""Queries over readers and writers: a table goes out in a format, comes back through the reader and has to be itself."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import tokens
from quillmill.plans.registry import Catalog
from quillmill.plans.tokens import _STREAM as STREAM_SQL
from quillmill.plans.tokens import _with_end as ids_with_end
from quillmill.sources import readers as R
from quillmill.sources import sinks as S
from quillmill.sources import warc
from quillmill.session import shared_folder

query = Catalog()


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _digest(column: str = "text"):
    return F.md5(F.col(column)).alias("text_md5")


@query("scan_jsonl", "documents", sql="SELECT doc_id, lang, md5(text) AS text_md5 FROM documents")
def scan_jsonl(docs):
    path = _folder(docs.sparkSession, "jsonl")
    S.write_jsonl(docs.select("source", "doc_id", "lang", "text"), path, "source")
    return R.read_jsonl(docs.sparkSession, path, "doc_id long, lang string, text string", "*.json").select("doc_id", "lang", _digest())


@query("scan_json_list", "benchmark", sql="SELECT item_id, md5(text) AS text_md5 FROM benchmark")
def scan_json_list(benchmark):
    """One JSON list, told apart from JSON lines by its first character; a benchmark is small enough for one file."""
    spark, path = benchmark.sparkSession, _folder(benchmark.sparkSession, "list")
    benchmark.agg(F.to_json(F.collect_list(F.struct("item_id", "text"))).alias("value")).write.text(path)
    return R.read_json_or_jsonl(spark, path, "item_id long, text string").select("item_id", _digest())


@query("scan_json_lines", "benchmark", sql="SELECT item_id, md5(text) AS text_md5 FROM benchmark")
def scan_json_lines(benchmark):
    path = _folder(benchmark.sparkSession, "lines")
    S.write_jsonl(benchmark, path)
    return R.read_json_or_jsonl(benchmark.sparkSession, path, "item_id long, text string").select("item_id", _digest())


@query("scan_text_lines", "documents", sql="SELECT md5(line) AS line_md5, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")
def scan_text_lines(docs):
    path = _folder(docs.sparkSession, "text")
    docs.select("text").write.text(path)
    return R.read_text_files(docs.sparkSession, path, whole=False).groupBy(F.md5("text").alias("line_md5")).agg(F.count("*").alias("n"))


@query("scan_whole_files", "labels", sql="SELECT quality, count(*)::BIGINT AS n_lines, sum(doc_id)::BIGINT AS ids FROM labels GROUP BY quality")
def scan_whole_files(labels):
    """A folder a label; whole files come back as one text each."""
    path = _folder(labels.sparkSession, "whole")
    labels.select("quality", F.col("doc_id").cast("string").alias("value")).write.partitionBy("quality").text(path)
    files = labels.sparkSession.read.option("wholetext", "true").text(path)
    lines = files.select(F.col("quality").cast("int").alias("quality"), F.explode(F.split(F.rtrim(F.regexp_replace("value", r"\n$", "")), "\n")).alias("line"))
    return lines.groupBy("quality").agg(F.count("*").alias("n_lines"), F.sum(F.col("line").cast("long")).alias("ids"))


@query("scan_delimited_docs", "documents", sql="SELECT md5(text) AS text_md5, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def scan_delimited_docs(docs):
    path = _folder(docs.sparkSession, "delimited")
    docs.select("text").write.option("lineSep", "<|endoftext|>").text(path)
    return R.read_delimited(docs.sparkSession, path).groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("n"))


def _archive(rows: DataFrame, kind: str, url, payload, path: str) -> None:
    """An archive with a gzip member for each row."""
    warc.register(rows.sparkSession)
    rows.select(F.lit(kind).alias("record_type"), url.alias("url"), payload.alias("payload")).write.format("warc").mode("append").save(path)


#: Bytes of a range in the queries: so few that even the small tables' archives are read in several.
_SPLIT = 1 << 16


@query("scan_wet", "documents", sql="SELECT 'http://documents.example/' || doc_id AS url, md5(text) AS text_md5, true AS valid FROM documents")
def scan_wet(docs):
    path = _folder(docs.sparkSession, "wet")
    address = F.concat(F.lit("http://documents.example/"), F.col("doc_id").cast("string"))
    _archive(docs, "conversion", address, F.col("text"), path)
    return R.read_wet(docs.sparkSession, path).select("url", _digest(), "valid")


def _response():
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"), F.col("html"))


@query("scan_warc", "pages", sql="SELECT url, md5(html) AS html_md5 FROM pages")
def scan_warc(pages):
    path = _folder(pages.sparkSession, "warc")
    _archive(pages, "response", F.col("url"), _response(), path)
    return R.read_warc_html(pages.sparkSession, path).select("url", F.md5("html").alias("html_md5"))


@query("scan_warc_splits", "documents", sql="SELECT 'http://documents.example/' || doc_id AS url, md5(text) AS text_md5, 2::BIGINT AS times, 1::BIGINT AS places FROM documents")
def scan_warc_splits(docs):
    """The same archives whole and in byte ranges: each record comes from either reading, at the same position."""
    spark, path = docs.sparkSession, _folder(docs.sparkSession, "splits")
    _archive(docs, "conversion", F.concat(F.lit("http://documents.example/"), F.col("doc_id").cast("string")), F.col("text"), path)
    both = R.read_archive(spark, path, "conversion").unionByName(R.read_archive(spark, path, "conversion", _SPLIT))
    return both.groupBy("url", F.md5("payload").alias("text_md5")).agg(F.count("*").alias("times"), F.countDistinct("path", "position").alias("places"))


@query("warc_wet_join", "pages", sql="SELECT url, md5(html) AS html_md5, md5(upper(url)) AS text_md5 FROM pages")
def warc_wet_join(pages):
    path = _folder(pages.sparkSession, "both")
    _archive(pages, "response", F.col("url"), _response(), f"{path}/warc")
    _archive(pages, "conversion", F.col("url"), F.upper("url"), f"{path}/wet")
    both = R.page_with_text(R.read_warc_html(pages.sparkSession, f"{path}/warc"), R.read_wet(pages.sparkSession, f"{path}/wet"))
    return both.select("url", F.md5("html").alias("html_md5"), _digest())


@query("scan_damaged", "pages", sql="SELECT CASE WHEN page_id % 3 = 0 THEN 'damaged' ELSE 'response' END AS record_type, count(*)::BIGINT AS n, count(DISTINCT CASE WHEN page_id % 3 = 0 THEN NULL ELSE url END)::BIGINT AS n_urls FROM pages GROUP BY 1")
def scan_damaged(pages):
    """Members with a wrong checksum cost themselves, and are told; their neighbours are read."""
    spark, path = pages.sparkSession, _folder(pages.sparkSession, "damaged")

    def members(batches):
        for batch in batches:
            made = []
            for i, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                member = bytearray(warc.member_bytes("response", url, html.encode()))
                member[-5] ^= 0xFF * (i % 3 == 0)
                made.append(bytes(member))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["payload"])

    warc.register(spark)
    pages.select("page_id", "url", "html").mapInArrow(members, "payload binary").write.format("warc").option("verbatim", "true").mode("append").save(path)
    return R.read_archive(spark, path, "response", _SPLIT).groupBy("record_type").agg(F.count("*").alias("n"), F.countDistinct("url").alias("n_urls"))


@query("parse_wet_text", "documents", sql=r"SELECT md5(trim(regexp_replace(text, '\s*\n\s*', ' ', 'g'))) AS text_md5, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def parse_wet_text(docs):
    """A WET file as one string, split into its records natively."""
    record = F.concat(F.lit("WARC/1.0\r\nWARC-Type: conversion\r\nContent-Length: "), F.octet_length("text").cast("string"), F.lit("\r\n\r\n"), "text", F.lit("\r\n\r\n"))
    files = docs.groupBy(F.floor(F.col("doc_id") / 50).alias("file")).agg(F.array_join(F.collect_list(record), "").alias("value"))
    return R.parse_wet_text(files).groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("n"))


@query("scan_url_list", "pages", sql="SELECT url, count(*)::BIGINT AS n FROM pages GROUP BY url")
def scan_url_list(pages):
    path = _folder(pages.sparkSession, "urls")
    pages.select(F.explode(F.array(F.concat(F.lit("  "), "url", F.lit(" ")), F.lit(" "))).alias("value")).write.text(path)
    return R.read_url_list(pages.sparkSession, path).groupBy("url").agg(F.count("*").alias("n"))


@query("dataset_fields", "conversations", sql="""SELECT conv_id::VARCHAR AS id, CASE WHEN role = 'user' THEN md5(text) ELSE md5(text || '?') END AS question_md5,
 CASE WHEN role = 'user' THEN turn::VARCHAR END AS answer, NULL::VARCHAR AS response FROM conversations""")
def dataset_fields(conversations):
    """Columns under any of the names that question-answer sets use."""
    mine = F.col("role") == "user"
    rows = conversations.select(F.col("conv_id").alias("id"), F.when(mine, F.col("text")).alias("question"), F.concat("text", F.lit("?")).alias("query"), F.when(mine, F.col("turn")).alias("solution"))
    got = R.with_fallbacks(rows, id=("id",), **R.QA_FIELDS)
    return got.select("id", F.md5("question").alias("question_md5"), "answer", "response")


@query("first_documents", "documents", sql="SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE length(text) > 0 ORDER BY doc_id LIMIT 25")
def first_documents(docs):
    return R.first_documents(docs, 25, "doc_id").select("doc_id", _digest())


@query("write_fasttext", "labels", "documents", sql=r"""SELECT label, md5(line) AS line_md5, count(*)::BIGINT AS n FROM (SELECT '__label__' || quality AS label,
 '__label__' || quality || ' ' || regexp_replace(replace(text, chr(10), ' '), '^\s+|\s+$', '', 'g') AS line FROM labels JOIN documents USING (doc_id)) GROUP BY ALL""")
def write_fasttext(labels, docs):
    path = _folder(docs.sparkSession, "fasttext")
    S.write_fasttext(labels.join(docs, "doc_id"), F.col("quality").cast("string"), F.col("text"), path)
    lines = docs.sparkSession.read.text(path)
    return lines.groupBy(F.substring_index("value", " ", 1).alias("label"), F.md5("value").alias("line_md5")).agg(F.count("*").alias("n"))


@query("rewrite_without_ids", "documents", "labels", sql="""SELECT count(CASE WHEN l.doc_id IS NULL THEN 1 END)::BIGINT AS kept, count(l.doc_id)::BIGINT AS removed
 FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) l ON d.doc_id = l.doc_id""")
def rewrite_without_ids(docs, labels):
    return S.rewrite_without(docs, labels.where("quality = 0").select("doc_id"), "doc_id", _folder(docs.sparkSession, "rewritten"))


@query("copy_representatives", "documents", sql="SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text")
def copy_representatives(docs):
    """Exact copies as clusters; their representatives written and read back."""
    spark, path = docs.sparkSession, _folder(docs.sparkSession, "representatives")
    low = docs.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("cluster_id"))
    clustered = docs.select("doc_id", F.md5("text").alias("h")).join(low, "h").select("doc_id", "cluster_id")
    S.write_representatives(docs, clustered, path)
    return spark.read.schema("doc_id long, text string").json(path).select("doc_id", _digest())


_TOKENS = f"SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, token FROM (SELECT doc_id, unnest(ids) AS token, generate_subscripts(ids, 1) AS i FROM ({STREAM_SQL}))"


def _decoded(rows: DataFrame, key: str) -> DataFrame:
    """``key, n, tokens_md5`` of little-endian 16-bit ids."""

    def decode(batches):
        for batch in batches:
            ids = [np.frombuffer(data, "<u2").tolist() for data in batch.column("data").to_pylist()]
            digests = [hashlib.md5(" ".join(map(str, i)).encode()).hexdigest() for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([len(i) for i in ids], pa.int64()), pa.array(digests)], [key, "n", "tokens_md5"])

    return rows.select(key, "data").mapInArrow(decode, f"{key} long, n long, tokens_md5 string")


@query("token_files", "documents", sql=f"SELECT (pos // 4096)::BIGINT AS block, count(*)::BIGINT AS n, md5(string_agg(token, ' ' ORDER BY pos)) AS tokens_md5 FROM ({_TOKENS}) GROUP BY 1")
def token_files(docs):
    """The stream as blocks of 4,096 ids in several files, read back."""
    spark, path = docs.sparkSession, _folder(docs.sparkSession, "tokens")
    S.write_token_blocks(tokens.token_stream(ids_with_end(tokens.in_order(docs.select("doc_id", "text"))), ordered=True), path, 4096, 16)
    return _decoded(spark.read.parquet(path), "block")


@query("token_exports", "documents", sql=f"""WITH t AS (SELECT pos // 65536 AS file, count(*) AS n, sum(token) AS total FROM ({_TOKENS}) GROUP BY 1)
SELECT printf('tokens-%06d.%s', file::BIGINT, kind) AS file, (file * 65536)::BIGINT AS start, n::BIGINT AS n, (2 * n + header)::BIGINT AS n_bytes, total::BIGINT AS total FROM t, (VALUES ('bin', 0), ('npy', 128)) v(kind, header)""")
def token_exports(docs):
    """Files to be mapped into memory, without and with a header: the index, their bytes, and the sum of the ids after the header."""
    spark, path = docs.sparkSession, _folder(docs.sparkSession, "export")
    S.write_token_blocks(tokens.token_stream(ids_with_end(tokens.in_order(docs.select("doc_id", "text"))), ordered=True), f"{path}/blocks", 4096, 16)
    index = [S.export_token_files(spark, f"{path}/blocks", f"{path}/{kind}", kind == "npy") for kind in ("bin", "npy")]

    def summed(batches):
        for batch in batches:
            data = batch.column("content").to_pylist()
            names = [p.rsplit("/", 1)[1] for p in batch.column("path").to_pylist()]
            totals = [int(np.frombuffer(d, "<u2", offset=128 * n.endswith(".npy")).sum(dtype=np.int64)) for n, d in zip(names, data, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([len(d) for d in data], pa.int64()), pa.array(totals, pa.int64())], ["file", "n_bytes", "total"])

    files = spark.read.format("binaryFile").load([f"{path}/bin", f"{path}/npy"]).select("path", "content").mapInArrow(summed, "file string, n_bytes long, total long")
    return index[0].unionByName(index[1]).join(files, "file")


@query("random_windows", "documents", sql=f"""WITH t AS ({_TOKENS}), n AS (SELECT count(*) AS n, (SELECT count(*) FROM documents) AS k FROM t),
s AS (SELECT w, ('0x' || substr(md5('42:' || w), 1, 15))::BIGINT % (n - 64) AS start FROM n, (SELECT unnest(range((SELECT k FROM n))) AS w))
SELECT w::BIGINT AS "window", start, md5(string_agg(token, ' ' ORDER BY pos) FILTER (pos < start + 64)) AS x_md5, md5(string_agg(token, ' ' ORDER BY pos) FILTER (pos > start)) AS y_md5
FROM s JOIN t ON t.pos BETWEEN s.start AND s.start + 64 GROUP BY ALL""")
def random_windows(docs):
    """As many windows as there are documents, anywhere in the stream, over the ends of documents, blocks and files."""
    spark, path = docs.sparkSession, _folder(docs.sparkSession, "windows")
    S.write_token_blocks(tokens.token_stream(ids_with_end(tokens.in_order(docs.select("doc_id", "text"))), ordered=True), path, 4096, 16)
    found = tokens.random_windows(spark.read.parquet(path), 64, docs.count())
    digest = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), " ")).alias(f"{c}_md5")
    return found.select("window", "start", digest("x"), digest("y"))


@query("write_eval", "conversations", sql="SELECT 'records' AS part, count(*)::BIGINT AS n FROM conversations UNION ALL SELECT 'summary', count(DISTINCT role)::BIGINT FROM conversations")
def write_eval(conversations):
    spark, path = conversations.sparkSession, _folder(conversations.sparkSession, "eval")
    S.write_evaluation(conversations, conversations.agg(F.countDistinct("role").alias("roles")), path)
    records = spark.read.json(f"{path}/records").agg(F.count("*").alias("n")).select(F.lit("records").alias("part"), "n")
    return records.unionByName(spark.read.json(f"{path}/summary").select(F.lit("summary").alias("part"), F.col("roles").alias("n")))
