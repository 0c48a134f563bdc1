import random
from collections import Counter

import pyarrow as pa
import pytest

from quillmill.operators import bpe
from quillmill.operators.bpe import Codec, MergeLoop, Vocabulary


def naive_merges(counts, n):
    """Full recount for every merge."""
    words = {tuple(bytes([b]) for b in w.encode()): c for w, c in counts.items()}
    out = []
    for _ in range(n):
        pairs = Counter()
        for w, c in words.items():
            for p in zip(w, w[1:]):
                pairs[p] += c
        if not pairs:
            break
        best = max(pairs, key=lambda p: (pairs[p], p))
        out.append(best)
        merged = Counter()
        for w, c in words.items():
            x, i = [], 0
            while i < len(w):
                if w[i : i + 2] == best:
                    x.append(w[i] + w[i + 1])
                    i += 2
                else:
                    x.append(w[i])
                    i += 1
            merged[tuple(x)] += c
        words = merged
    return out


def test_incremental_merges_equal_full_recount():
    rng = random.Random(1)
    counts = Counter("".join(rng.choice("aab é") for _ in range(rng.randint(1, 9))) for _ in range(300))
    loop = MergeLoop(dict(counts))
    got = []
    while (p := loop.step()) is not None and len(got) < 60:
        got.append(p)
    assert got[:60] == naive_merges(counts, 60)


@pytest.fixture(scope="module")
def vocabulary(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return bpe.train_bpe(docs, 350, ("<|endoftext|>", "<|endoftext|><|endoftext|>"))


def test_specials_stay_whole(vocabulary):
    codec = Codec(vocabulary)
    text = "Héllò hôw <|endoftext|><|endoftext|> are ü? 🙃<|endoftext|>"
    ids = codec.encode(text)
    assert codec.decode(ids) == text
    tokens = [vocabulary.tokens[i] for i in ids]
    assert tokens.count(b"<|endoftext|><|endoftext|>") == 1 and tokens.count(b"<|endoftext|>") == 1
    assert len(vocabulary.tokens) == 350 and not any(b"<|" in t for t in list(vocabulary.tokens.values())[:348])


def test_iterable_and_unknown_ids(vocabulary):
    codec = Codec(vocabulary)
    assert list(codec.encode_iterable(["ab", " cd"])) == codec.encode("ab") + codec.encode(" cd")
    assert codec.decode([*codec.encode("hi"), 10**6]) == "hi" and codec.encode("") == []


def test_text_form_round_trip(vocabulary):
    again = bpe.load_vocabulary(*bpe.dump_vocabulary(vocabulary), vocabulary.specials)
    assert again.tokens == vocabulary.tokens and again.merges == vocabulary.merges


def test_missing_bytes_are_refused():
    with pytest.raises(ValueError):
        Vocabulary({0: b"a"}, [])


@pytest.mark.parametrize("most", [0, 5, 40])
def test_words_beyond_the_drivers_share_stay_in_spark(spark, most):
    rng = random.Random(most)
    rows = [("".join(rng.choice("aaab cd é") for _ in range(rng.randint(0, 60))),) for _ in range(80)]
    docs = spark.createDataFrame(rows, "text string").repartition(3)
    assert bpe.train_bpe(docs, 330, most_words=most).merges == bpe.train_bpe(docs, 330).merges == naive_merges(dict(bpe.pretoken_counts(docs).collect()), 74)
    assert len(bpe._head_and_tail(bpe.pretoken_counts(docs), most)[0]) <= most


def test_ids_leave_a_worker_in_pieces(spark, vocabulary, monkeypatch):
    texts = ["word " * n for n in (0, 1, 400_000, 3)] + [None] + ["x" * 70] * 300
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").coalesce(1)
    codec = Codec(vocabulary)
    got = df.select("i", bpe.encode_udf(spark, vocabulary)("text").alias("ids"))
    back = {r["i"]: r["t"] for r in got.select("i", bpe.decode_udf(spark, vocabulary)("ids").alias("t")).collect()}
    assert back == dict(enumerate(texts))
    assert {r["i"]: r["ids"] for r in got.collect()} == {i: None if t is None else codec.encode(t) for i, t in enumerate(texts)}
    assert [len(p) for p in bpe._pieces(pa.array(["a" * 600_000] * 3))] == [1, 1, 1]
    codec.encode("y" * 70)
    assert all(len(w) <= Codec.LONGEST for w in codec.cache)
