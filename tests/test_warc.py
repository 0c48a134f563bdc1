"""The archive source: byte ranges, damage, writing."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from quillmill.sources import readers as R
from quillmill.sources import warc


def rows(df):
    return sorted(((r["record_type"], r["url"], bytes(r["payload"]), r["position"]) for r in df.collect()), key=repr)


def member(i, rng):
    return warc.member_bytes("response" if i % 3 else "request", f"http://a.example/{i}", rng.randbytes(rng.randint(0, 400)) + b"WARC/1.0\r\n" * rng.randint(0, 3))


def test_ranges_don_t_matter(spark, tmp_path):
    """Whole, in pieces smaller than members, with wrong checksums, broken headers, gaps, and an end that is cut off."""
    rng = random.Random(4)
    parts = [member(i, rng) for i in range(80)]
    good = len(parts)
    for i in (7, 30, 31):
        parts[i] = parts[i][:-5] + bytes([parts[i][-5] ^ 1]) + parts[i][-4:]
    parts[12] = b"\x00" + parts[12][1:]  # no member any more, told by the one before
    parts[50] += b"junk between members"
    parts[79] = parts[79][:-20]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    (tmp_path / "_hidden.warc.gz").write_bytes(parts[0])
    whole = rows(R.read_archive(spark, str(tmp_path)))
    assert [r[0] for r in whole].count("damaged") == 6 and len(whole) == good - 5 + 6
    for size in (100, 333, 5000):
        df = R.read_archive(spark, str(tmp_path), split_bytes=size)
        assert rows(df) == whole
        assert size > 1000 or df.rdd.getNumPartitions() > 8
    kinds = {r[0] for r in rows(R.read_archive(spark, str(tmp_path), "request", 333))}
    assert kinds == {"request", "damaged"}
    by_hand = spark.read.format("binaryFile").load(str(tmp_path / "a.warc.gz")).count()
    assert by_hand == 1 and rows(R._whole_archives(spark, str(tmp_path / "a.warc.gz"), None)) == whole


@pytest.mark.parametrize("zipped", [True, False])
def test_one_member_or_none(spark, tmp_path, zipped):
    """An archive zipped as a whole, or not at all, is one stream; what comes before the damage is kept."""
    data = b"".join(warc.record_bytes("conversion", f"u{i}", b"x" * i) for i in range(30))
    name = "a.wet.gz" if zipped else "a.wet"
    (tmp_path / name).write_bytes(gzip.compress(data) if zipped else data)
    want = [("conversion", f"u{i}", b"x" * i) for i in range(30)]
    assert sorted(r[:3] for r in rows(R.read_archive(spark, str(tmp_path), split_bytes=50))) == sorted(want)
    (tmp_path / name).write_bytes((gzip.compress(data, 0) if zipped else data)[:700])
    got = rows(R.read_archive(spark, str(tmp_path), split_bytes=50))
    assert [r[0] for r in got].count("damaged") == 1 and 3 < len(got) < 12


def test_written_and_read_back(spark, tmp_path):
    path = str(tmp_path / "out")
    warc.register(spark)
    df = spark.range(200).select(F.lit("response").alias("record_type"), F.concat(F.lit("http://x/"), "id").alias("url"), F.repeat(F.lit("é\r\n\r\nWARC/1.0\r\n"), F.col("id").cast("int") % 7).alias("payload")).repartition(3)
    df.write.format("warc").mode("append").save(path)
    want = sorted((r["record_type"], r["url"], r["payload"].encode()) for r in df.collect())
    assert sorted(r[:3] for r in rows(R.read_archive(spark, path, split_bytes=300))) == want
    df.limit(5).write.format("warc").mode("overwrite").save(path)
    assert R.read_archive(spark, path).count() == 5
    assert spark.createDataFrame([(None, None, None)], "record_type string, url string, payload string").write.format("warc").mode("append").save(path) is None
    assert R.read_archive(spark, path, "resource").select("url", "payload").first() == (None, bytearray(b""))


def test_empty_folder_and_missing_path(spark, tmp_path):
    assert R.read_archive(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        R.read_archive(spark, str(tmp_path / "nowhere")).count()
