"""Removal of bytes that occur earlier against a plain dictionary of strings."""

import hashlib
import random

import numpy as np
import pytest

from quillmill.llm import suffixes
from quillmill.llm.queries import op11_suffix_array


def plain(rows, window=100):
    """Rows of one doc_id are judged alike: a string of the same document counts from a smaller start on."""
    rows = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in rows:
        place = (d is None, d or 0)
        for i in range(len(b) - window + 1):
            w = b[i : i + window]
            first[w] = min(first.get(w, (place, i)), (place, i))
    out = []
    for d, b in rows:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < ((d is None, d or 0), i):
                gone[i + 1 : i + 1 + window] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])
        out.append((d, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def planted(seed, n):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé 日") for _ in range(rng.choice([90, 99, 100, 101, 130, 400]))) for _ in range(12)]
    rows = []
    for i in range(n):
        text = "".join(rng.choice([rng.choice(passages), "".join(rng.choice("abc ") for _ in range(rng.randint(1, 150)))]) for _ in range(rng.randint(0, 6)))
        rows.append((None if rng.random() < 0.03 else i, None if rng.random() < 0.03 else text))
    rows += [(n, "x" * 900), (n + 1, "ab" * 700), (n + 2, "x" * 250), (3, passages[0] * 3), rows[5], rows[5], (n + 3, rows[7][1]), (n + 4, rows[7][1])]
    return rows


@pytest.mark.parametrize(("window", "wide", "budget", "longest"), [(100, 1024, 1 << 16, 128), (100, 2, 300, 7), (60, 1, 1, 128), (33, 3, 1000, 20), (7, 5, 2000, 128)])
def test_against_dictionary(spark, monkeypatch, window, wide, budget, longest):
    monkeypatch.setattr(suffixes, "COLLECTION_BYTES", budget)
    monkeypatch.setattr(suffixes, "LONGEST", longest)
    monkeypatch.setattr(suffixes, "SEGMENT", 500)
    rows = planted(window + wide, 60)
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, first int, anchor string").repartition(3)
    joined = suffixes.remove_repeated_bytes(df, window=window, wide=wide, most_sent=0)
    out = suffixes.remove_repeated_bytes(df, window=window, wide=wide, with_text=True)
    assert got(joined) == got(out)
    assert got(out) == plain(rows, window)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in out.collect())


def test_query_on_given_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op11_suffix_array(spark, sf)) == plain(rows)


def test_odd_rows_and_empty_table(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert got(suffixes.remove_repeated_bytes(odd)) == plain(rows)
    assert suffixes.remove_repeated_bytes(odd.limit(0)).count() == 0


def test_the_transform_is_that_of_the_collection():
    """The order is that of the strings' symbols, the common prefixes are theirs, and pairs lead from suffix to suffix."""
    rng = random.Random(3)
    regions = [bytes(rng.choice(b"ab") for _ in range(rng.randint(4, 40))) for _ in range(60)] + [b"abababababab"] * 5
    built = suffixes.Collection(regions, 4, 1)
    data = b"".join(regions)
    stops = np.cumsum([len(r) for r in regions])
    number = {int(built.symbol[i]): data[i] for i in range(len(data))}
    assert len(set(number.values())) == len(number)
    suffix = [built.symbol[s : stops[np.searchsorted(stops, s, side="right")]].tolist() for s in built.starts.tolist()]
    assert sorted(built.starts.tolist()) == list(range(len(data))) and suffix == sorted(suffix)
    shared = [0] + [next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(suffix, suffix[1:], strict=False)]
    assert built.common.tolist() == [min(4, k) for k in shared]
    ends = len(built.lengths)
    for i, (pair, s) in enumerate(zip(built.pairs.tolist(), suffix, strict=True)):
        assert pair >> 31 == s[0]
        rest = pair & 0x7FFFFFFF
        assert (rest < ends and len(s) == 1) or suffix[rest - ends] == s[1:], i


def test_windows_that_differ_stay(spark):
    """Regions may share their anchor and still hold no equal window: the transform says no."""
    anchor = "the very same twenty-four bytes and some more"
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdef") for _ in range(60)) + anchor + "".join(rng.choice("abcdef") for _ in range(60)) for _ in range(30)]
    out = suffixes.remove_repeated_bytes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["n_removed"] for r in out.collect()} == {0}


def test_the_shared_anchors_go_out_as_a_filter_of_two_bytes_each(spark):
    n = 300_000
    anchors = spark.range(n).selectExpr("id * 7919 AS anchor", "2L AS all")
    known = suffixes._filter(anchors, n)
    assert known.nbytes <= 2 * n + 8
    word, bits = suffixes._bits(np.arange(n) * 7919, len(known))
    assert np.all(known[word] & bits == bits)
    word, bits = suffixes._bits(np.arange(n) * 7919 + 1, len(known))
    assert np.mean(known[word] & bits == bits) < 0.01


def test_texts_of_a_large_batch_are_hashed_a_megabyte_at_a_time(monkeypatch):
    import pyarrow as pa

    from quillmill.llm import substring

    sizes = []

    def spied(texts, window, gram):
        sizes.append(sum(map(len, texts)))
        return regions(texts, window, gram)

    regions = substring.regions
    monkeypatch.setattr(substring, "regions", spied)
    texts = [" ".join(f"w{i * j}" for j in range(200)) for i in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(range(4000)), pa.array(texts)], ["id", "key", "text"])
    for step in (substring._anchors, substring._places):
        sizes.clear()
        rows = sum(out.num_rows for out in step(iter([batch]), 35, 8))
        assert rows and sum(sizes) == sum(map(len, texts)) and max(sizes) < 3 << 19
