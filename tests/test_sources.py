import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.operators import tokens
from quillmill.sources import readers as R
from quillmill.sources import sinks as S


def record(kind, url, body):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_archives(spark, tmp_path):
    html = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi</p>"
    data = b"".join(gzip.compress(x) for x in (record("warcinfo", "", b"x"), record("conversion", "http://a/", "é WARC/1.0 inside".encode()), record("conversion", "http://b/", b"\xff\xfe"), record("response", "http://c/", html)))
    (tmp_path / "x.warc.wet.gz").write_bytes(data)
    (tmp_path / "broken.warc.gz").write_bytes(data[:40])
    wet = {r["url"]: (r["text"], r["valid"]) for r in R.read_wet(spark, str(tmp_path)).collect()}
    assert wet == {"http://a/": ("é WARC/1.0 inside", True), "http://b/": (None, False)}
    pages = spark.createDataFrame([("http://a/", "<p>")], "url string, html string")
    assert R.page_with_text(pages, R.read_wet(spark, str(tmp_path))).first()["text"] == "é WARC/1.0 inside"
    assert bytes(R.read_warc_html(spark, str(tmp_path)).first()["html"]) == b"<p>hi</p>"


def test_wet_text(spark):
    text = "WARC/1.0\r\nContent-Length: 9\r\n\r\none\r\ntwo\r\nWARC/1.0\r\nno length\r\n\r\nx"
    assert [r["text"] for r in R.parse_wet_text(spark.createDataFrame([(text,)], "value string")).collect()] == ["one two"]


def test_json_either_way(spark, tmp_path):
    rows = [{"problem": "1+1", "answer": "2"}, {"problem": "2+2", "solution": "4"}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n{broken\n")
    for name in ("a.json", "b.jsonl"):
        df = R.with_fallbacks(R.read_json_or_jsonl(spark, str(tmp_path / name), "problem string, answer string, solution string"), **R.QA_FIELDS)
        assert {(r["question"], r["answer"]) for r in df.where("question is not null").collect()} == {("1+1", "2"), ("2+2", "4")}
    assert R.read_jsonl(spark, str(tmp_path), "problem string").where("problem is not null").count() == 2


def test_delimited(spark, tmp_path):
    (tmp_path / "d.txt").write_text("one\n<|endoftext|>two<|endoftext|>")
    assert [r["text"] for r in R.read_delimited(spark, str(tmp_path / "d.txt")).collect()] == ["one\n", "two"]


def test_token_files_keep_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, [i * 10 + j for j in range(i % 5)]) for i in range(50)], "doc_id long, ids array<int>")
    stream = tokens.token_stream(docs.repartition(7))
    S.write_tokens(stream, str(tmp_path / "t"), 16)
    want = [i * 10 + j for i in range(50) for j in range(i % 5)]
    assert np.concatenate(list(S.read_tokens(spark, str(tmp_path / "t")))).tolist() == want
    assert S.export_token_bin(spark, str(tmp_path / "t"), str(tmp_path / "t.bin")) == len(want)
    assert np.fromfile(tmp_path / "t.bin", "<u2").tolist() == want
    assert S.export_npy(spark, str(tmp_path / "t"), str(tmp_path / "t.npy")) == len(want)
    assert np.load(tmp_path / "t.npy").tolist() == want
    packed = {r["sequence_id"]: (r["input_ids"], r["labels"]) for r in tokens.packed_sequences(stream, 8).collect()}
    assert packed == {k: (want[8 * k : 8 * k + 8], want[8 * k + 1 : 8 * k + 9]) for k in range((len(want) - 1) // 8)}


def test_rewrite_without(spark, tmp_path):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = S.rewrite_without(docs, spark.createDataFrame([(3,), (4,)], "doc_id long"), "doc_id", str(tmp_path / "o")).first()
    assert (got["kept"], got["removed"]) == (8, 2)


def test_token_blocks_and_files(spark, tmp_path):
    """Blocks of one size, files of several, exports with an index; an id that doesn't fit raises."""
    docs = spark.createDataFrame([(i, [i * 10 + j for j in range(i % 9)]) for i in range(80)], "doc_id long, ids array<int>")
    want = [i * 10 + j for i in range(80) for j in range(i % 9)]
    S.write_token_blocks(tokens.token_stream(docs.repartition(5)), str(tmp_path / "b"), 16, 3)
    blocks = spark.read.parquet(str(tmp_path / "b"))
    rows = blocks.orderBy("block").collect()
    assert [r["n"] for r in rows[:-1]] == [16] * (len(rows) - 1) and [r["file"] for r in rows] == [r["block"] // 3 for r in rows]
    assert np.concatenate([np.frombuffer(r["data"], "<u2") for r in rows]).tolist() == want
    for npy in (False, True):
        index = S.export_token_files(spark, str(tmp_path / "b"), str(tmp_path / f"e{npy}"), npy).orderBy("start").collect()
        read = [(np.load(tmp_path / f"e{npy}" / r["file"], mmap_mode="r") if npy else np.memmap(tmp_path / f"e{npy}" / r["file"], "<u2", "r")) for r in index]
        assert [len(x) for x in read] == [r["n"] for r in index] and [r["start"] for r in index] == [48 * i for i in range(len(index))]
        assert np.concatenate(read).tolist() == want
    big = spark.createDataFrame([(0, 0, [1, 70_000])], "doc_id long, start long, ids array<int>")
    with pytest.raises(Exception, match="doesn't fit"):
        S.write_token_blocks(big, str(tmp_path / "big"))
    S.write_token_blocks(big, str(tmp_path / "big"), dtype="<u4")
    x = tokens.random_windows(spark.read.parquet(str(tmp_path / "big")), 1, 3).collect()
    assert [(r["start"], r["x"], r["y"]) for r in x] == [(0, [1], [70_000])] * 3


def test_random_windows(spark, tmp_path):
    docs = spark.createDataFrame([(i, [i * 10 + j for j in range(i % 9)]) for i in range(80)], "doc_id long, ids array<int>")
    want = [i * 10 + j for i in range(80) for j in range(i % 9)]
    S.write_token_blocks(tokens.token_stream(docs), str(tmp_path / "b"), 16, 3)
    blocks = spark.read.parquet(str(tmp_path / "b"))
    for length in (1, 7, 40):
        got = tokens.random_windows(blocks, length, 500).collect()
        assert len(got) == 500 and all(r["x"] == want[r["start"] : r["start"] + length] and r["y"] == want[r["start"] + 1 : r["start"] + length + 1] for r in got)
        starts = [r["start"] for r in got]
        assert 0 <= min(starts) < 30 and len(want) - length - 30 < max(starts) < len(want) - length and len(set(starts)) > 150
    assert got != tokens.random_windows(blocks, 40, 500, seed=7).collect()
    assert tokens.random_windows(blocks, len(want), 5).count() == 0 and tokens.random_windows(blocks, len(want) - 1, 5).count() == 5
    plan = tokens.random_windows(blocks, 7, 5)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan
    S.write_token_blocks(tokens.token_stream(docs.limit(0)), str(tmp_path / "none"))
    assert tokens.random_windows(spark.createDataFrame([], "file int, block long, n int, data binary"), 3, 5).count() == 0


def test_counts_come_from_the_pass_that_writes(spark, tmp_path):
    """One job reads the input once: a row counted is a row that went by."""
    from quillmill.operators import quality

    docs = spark.createDataFrame([(i, "word " * (10 * i), "en" if i % 3 else "de") for i in range(30)] + [(None, None, "en")], "doc_id long, text string, lang string")
    scores = {"lang_score": F.lit(1.0), "nsfw_score": F.lit(0.0), "toxic_score": F.lit(0.0), "quality": F.lit("high"), "quality_score": F.lit(1.0)}
    judged = quality.discard_reason(docs.withColumns(scores))
    report = {r["reason"]: r["n"] for r in S.write_kept(judged, str(tmp_path / "kept")).collect()}
    want = {r["reason"]: r["n"] for r in quality.funnel(judged).collect()}
    assert report == want and spark.read.json(str(tmp_path / "kept")).count() == want["kept"]
    assert quality.funnel(judged.limit(0)).count() == 0 and S.write_kept(judged.limit(0), str(tmp_path / "none")).count() == 0
    scans = quality.funnel(judged.where("doc_id >= 0"))._jdf.queryExecution().optimizedPlan().toString()
    assert scans.count("LogicalRDD") == 1
    ids = spark.createDataFrame([(3,), (3,), (None,), (99,)], "doc_id long")
    assert tuple(S.rewrite_without(docs, ids, "doc_id", str(tmp_path / "o")).first()) == (30, 1)
    assert spark.read.json(str(tmp_path / "o")).count() == 30
