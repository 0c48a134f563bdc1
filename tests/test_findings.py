"""Cases in which queries differed from their SQL on larger tables."""

import random
from collections import Counter
from hashlib import md5
from itertools import combinations

import pandas as pd
from pyspark.sql import functions as F

from quillmill.functions.tokens import treebank_tokens
from quillmill.operators import attention, bpe
from quillmill.operators import dedup as D
from quillmill.plans import dedup
from quillmill.plans import tokens as token_plans
from quillmill.sources import readers as R
from quillmill.sources import warc
from quillmill.streaming import remainders


def test_what_begins_a_sentence_does_not_stand_before_the_next_stop(spark):
    texts = spark.createDataFrame([("end. SS. Next one.",), ("Wait... Yes. (No.) A. B. Z",)], "text string")
    got = [r[0] for r in texts.select(treebank_tokens(F.col("text"))).collect()]
    assert got == [["end", ".", "SS.", "Next", "one", "."], ["Wait", "...", "Yes", ".", "(", "No", ".", ")", "A.", "B.", "Z"]]


def test_pages_of_one_address_keep_their_number(spark):
    pages = spark.createDataFrame([("u", b"1"), ("u", b"2"), ("v", b"3"), ("w", b"4")], "url string, html binary")
    texts = spark.createDataFrame([("u", "U"), ("u", "U"), ("v", "V"), ("v", "V2"), ("x", "X")], "url string, text string")
    assert sorted((r["url"], bytes(r["html"]), r["text"]) for r in R.page_with_text(pages, texts).collect()) == [("u", b"1", "U"), ("u", b"2", "U"), ("v", b"3", "V")]


def test_pairs_that_share_no_bucket_are_found(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:30], f"x{i}", *words[30:], *(f"y{i // 2}{j}" for j in range(40))])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    exact = {tuple(r) for r in D.exact_jaccard_pairs(docs).collect()}
    assert len(exact) == 6
    # two bands of fifty hashes miss nearly everything
    assert not {tuple(r) for r in D.fuzzy_pairs(docs, bands=2).collect()} >= exact
    assert {tuple(r) for r in D.fuzzy_pairs(docs, bands=2, complete=True).collect()} == exact


def test_tiles_of_a_long_sequence_are_sent_a_bounded_number_of_times(spark):
    for n in (100, 1000):
        packed = spark.range(n).selectExpr("0 AS sequence", "id AS tile", "1 AS n", "CAST('q' AS BINARY) AS queries", "CAST('k' AS BINARY) AS keys")
        last = spark.createDataFrame([(0, n - 1)], "sequence int, last long")
        assert attention.dealt(packed, last).count() <= n * (attention.BLOCKS + 1)
        assert attention.dealt(packed, last, causal=False).count() <= n * 2 * attention.BLOCKS


def test_documents_of_a_large_batch_come_a_piece_at_a_time(monkeypatch):
    class Value:
        kept = None

        def exists(self):
            return self.kept is not None

        def get(self):
            return self.kept

        def update(self, value):
            self.kept = value

    class Map(dict):
        containsKey, getValue, removeKey, updateValue = dict.__contains__, dict.__getitem__, dict.__delitem__, dict.__setitem__

    monkeypatch.setattr(remainders, "PIECE", 1000, raising=False)
    texts = [str(i) * (1 + i % 7) for i in range(2000)] + ["x" * 5000, "end"]
    whole = "<END>".join(texts)
    chunks = [whole[i : i + 97] for i in range(0, len(whole), 97)]
    one = remainders.Remainders("<END>")
    one.open, one.early, got, most = Value(), Map(), [], 0
    for turn in (1, 0):  # the odd ones first, which wait
        frame = pd.DataFrame([(n, c, n == len(chunks) - 1) for n, c in enumerate(chunks) if n % 2 == turn], columns=["chunk_no", "text", "last"])
        for out in one.handleInputRows((3,), iter([frame]), None):
            got += zip(out["source"], out["document_no"], out["text"], strict=True)
            most = max(most, len(out))
    assert got == [(3, i, text) for i, text in enumerate(texts)]
    assert most < 300 and one.open.get() == (len(chunks), len(texts), "") and not one.early


def test_sets_are_not_shuffled_for_their_pairs(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i // 2, i // 2 + 9))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    heads, same = D.set_classes(D.cut_lineage(D.gram_sets(docs)))
    assert sorted((r["a"], r["b"]) for r in same.collect()) == [(i, i + 1) for i in range(0, 40, 2)]
    pairs = spark.createDataFrame([(0, 2), (4, 8)], "a long, b long")
    plan = heads._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    got = {(r["a"], r["b"]): r["jaccard"] for r in D.similarities(pairs, heads).collect()}
    assert got == {(0, 2): 4 / 6, (4, 8): 3 / 7}
    # an id that comes twice keeps the text that nothing else has
    twice = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "g h i j k l m"), (None, "x y z x y z")], "doc_id long, text string")
    heads, _ = D.set_classes(D.cut_lineage(D.gram_sets(twice)))
    assert sorted((r["doc_id"], len(r["hs"])) for r in heads.collect()) == [(1, 2), (2, 3)]


def test_grams_travel_packed(spark):
    rows = [(i, " ".join(f"w{j % 7 * (j + i % 3)}" for j in range(30 + i))) for i in range(50)] + [(90, "too few words"), (91, None), (92, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Counter()
    for _, text in rows:
        w = (text or "").split()
        want.update({md5(" ".join(w[i : i + 5]).encode()).hexdigest() for i in range(len(w) - 4)})
    found = D.shared_grams(docs)
    assert sorted(map(tuple, found.collect())) == sorted((g, n) for g, n in want.items() if n > 1)
    assert D.shared_grams(docs.limit(0)).count() == 0
    plan = dedup.ngram_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "Generate" not in plan  # no row for each gram


def test_archives_are_read_a_megabyte_at_a_time(spark, tmp_path):
    warc.register(spark)
    rows = spark.range(300).selectExpr("concat('http://a/', id) AS url", "repeat(md5(cast(id AS string)), 1000) AS payload").coalesce(1)
    rows.write.format("warc").mode("append").save(str(tmp_path / "a"))
    reader = warc.ArchiveReader({"path": str(tmp_path / "a")})
    batches = [b for split in reader.partitions() for b in reader.read(split)]
    assert sum(b.num_rows for b in batches) == 300 and max(b.nbytes for b in batches) < 2 << 20


def test_only_prefixes_of_sets_travel(spark, monkeypatch):
    """All pairs of brute force at the threshold, ones exactly at it included, without a row for each gram."""
    rng = random.Random(4)
    sets = {}
    while len(sets) < 240:
        base = set(rng.sample(range(400), rng.randint(1, 25)))
        for _ in range(4):
            kept = set(rng.sample(sorted(base), rng.randint(len(base) * 3 // 4, len(base)))) | set(rng.sample(range(400), rng.randint(0, 3)))
            sets[len(sets)] = kept | ({9000, 9001, 9002} if len(sets) % 3 else set()) or {1}
    grams = {g: rng.getrandbits(64) - (1 << 63) for s in sets.values() for g in s}
    heads = spark.createDataFrame([(i, sorted(grams[g] for g in s)) for i, s in sets.items()], "doc_id long, hs array<long>").repartition(5)
    plans = []
    monkeypatch.setattr(D, "cut_lineage", lambda df, f=D.cut_lineage: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df))
    for threshold in (0.5, 0.8, 0.9, 1.0):
        similar = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sets, 2)}
        want = {p for p, j in similar.items() if j >= threshold}
        found = D.prefix_candidates(heads, threshold)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        candidates = [(r["a"], r["b"]) for r in found.collect()]
        assert len(candidates) == len(set(candidates)) and set(candidates) >= want
        got = {(r["a"], r["b"]): r["jaccard"] for r in D.verified_pairs(found, heads, threshold).collect()}
        assert got == {p: similar[p] for p in want} and len(got) > (10 if threshold < 0.9 else 0)
    assert not any("explode(hs" in p for p in plans)


def test_the_order_of_grams_counts_all_of_them(spark):
    grams = [g - (1 << 63) for g in range(0, 1 << 64, (1 << 64) // 5000)]
    sets = spark.createDataFrame([(i, sorted({*grams[i::50], grams[7]})) for i in range(50)], "doc_id long, hs array<long>").repartition(3)
    counts = D.cell_counts(sets)
    assert len(counts) == 1 << D.CELL_BITS and counts.sum() == len(grams) + 49 and counts.max() == 50
    # the gram that all sets have is behind the others of its set, wherever its hash lies
    assert all(r["h"] != grams[7] for r in D.prefixes(sets, 0.8).collect())
    assert D.prefixes(sets, 0.8).count() == sum(n - -(-4 * n // 5) + 1 for n in (len(set(grams[i::50]) | {grams[7]}) for i in range(50)))
    empty = sets.limit(0)
    assert not D.cell_counts(empty).any() and D.prefix_candidates(empty, 0.8).count() == 0


def test_a_set_travels_to_tiles_not_to_pairs(spark, monkeypatch):
    monkeypatch.setattr(D, "TILE", 8, raising=False)
    rows = [(i, sorted({*range(100), 1000 + i})) for i in range(60)] + [(i, sorted({*range(200, 230), *range(i % 3)})) for i in range(100, 106)] + [(300, [1, 2]), (300, [1, 2, 3, 4])]
    sets = spark.createDataFrame(rows, "doc_id long, hs array<long>").repartition(3)
    pairs = spark.createDataFrame([(a, b) for a in range(60) for b in range(a + 1, 60)] + list(combinations(range(100, 106), 2)) + [(0, 300), (299, 300)], "a long, b long")
    placed = D.tiles(pairs).collect()
    assert sorted((r["a"], r["b"]) for r in placed) == sorted(map(tuple, pairs.collect()))
    assert len({(r["family"], r["x"], r["y"], d) for r in placed for d in (r["a"], r["b"])}) < len(placed) / 2
    held = {}
    for doc, h in rows:
        held.setdefault(doc, []).append(set(h))
    for threshold in (0.03, 0.9):
        want = [(r["a"], r["b"], len(x & y) / len(x | y)) for r in placed for x in held.get(r["a"], []) for y in held.get(r["b"], [])]
        assert sorted(map(tuple, D.verified_pairs(pairs, sets, threshold).collect())) == sorted(w for w in want if w[2] >= threshold)
    assert D.verified_pairs(pairs.limit(0), sets, 0.8).count() == 0


def test_decoding_by_a_join_shuffles_about_the_text(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choices("abcdefghij é", k=20_000)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one id, two texts"), (None, "no id"), (None, "no id either"), (30, ""), (31, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    store = spark.sparkContext._jsc.sc()

    def shuffled():
        store.listenerBus().waitUntilEmpty()
        return store.statusStore().executorSummary("driver").totalShuffleWrite()

    before = shuffled()
    got = Counter(map(tuple, token_plans.decode_join(docs).collect()))
    assert shuffled() - before < 1.5 * sum(len(t.encode()) for t in texts)
    assert got == Counter((i, md5(t.encode()).hexdigest()) for i, t in rows if t)


def test_tokens_of_a_join_are_decoded_in_any_order(spark):
    vocabulary = spark.createDataFrame([(1, b"a"), (2, "é".encode()[:1]), (3, "é".encode()[1:]), (4, b"long token"), (5, b""), (6, None)], "token_id int, token binary")
    texts = {"x": [1, 2, 3, 4, 5, 9, 1], "y": [4, 4, 6, 1], None: [2, 3, 1], "z": [5]}
    rows = [(k, p, t) for k, ids in texts.items() for p, t in enumerate(ids)]
    want = {("x", "aélong tokena"), ("y", "long tokenlong tokena"), (None, "éa"), ("z", "")}
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        tokens = spark.createDataFrame(rows, "doc_id string, pos int, token_id int")
        assert {tuple(r) for r in bpe.decode_rows(tokens, vocabulary).collect()} == want
        assert {tuple(r) for r in bpe.decode_rows(tokens.coalesce(1).sort("doc_id", "pos"), vocabulary.hint("broadcast")).collect()} == want


def test_lists_are_decoded_as_their_rows_are(spark):
    vocabulary = spark.createDataFrame([(i, bytes([97 + i % 26]) * (i % 3)) for i in range(40)] + [(40, None)], "token_id int, token binary")
    draw = random.Random(5)
    lists = [(i, i % 7, draw.choices(range(44), k=i)) for i in range(40)] + [(50, 1, [41, 42]), (51, None, [1]), (52, 1, [*range(41, 44)] * 6 + [1]), (53, 1, [40, None, 1]), (54, 1, None)]
    encoded = spark.createDataFrame(lists, "a int, b int, ids array<int>").repartition(3)
    rows = encoded.select("a", "b", F.posexplode("ids").alias("pos", "token_id"))
    want = sorted(map(str, bpe.decode_rows(rows, vocabulary, "a", "b").collect()))
    assert len(want) == 42
    assert sorted(map(str, bpe.decode_lists(encoded, vocabulary, "a", "b").collect())) == want
