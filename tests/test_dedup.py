import random

import pyarrow as pa

from quillmill.operators import dedup as D
from quillmill.operators.graph import connected_components


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_unique_lines(spark):
    docs = frame(spark, "a\nb\n", "b\nc", "d\nd", "")
    got = {r["doc_id"]: r["text"] for r in D.unique_lines(docs).collect()}
    assert got == {0: "a", 1: "c", 2: "", 3: ""}


def test_near_and_exact_copies(spark):
    base = " ".join(f"word{i}" for i in range(200))
    docs = frame(spark, base, base.replace("word7 ", "other "), base, "something else entirely " * 10, "too short", "too short")
    exact = {(r["a"], r["b"]) for r in D.exact_jaccard_pairs(docs).collect()}
    assert exact == {(0, 1), (0, 2)}  # copies meet others through the first of them
    clusters = {r["doc_id"]: r["cluster_id"] for r in D.clusters(D.fuzzy_pairs(docs)).collect()}
    assert clusters == {0: 0, 1: 0, 2: 0}
    kept = {r["doc_id"] for r in D.drop_duplicates_of(docs, D.clusters(D.fuzzy_pairs(docs))).collect()}
    assert kept == {0, 3, 4, 5}  # texts under five words have no n-gram and stay


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (301, 300), (300, 301), (None, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300}
    assert got == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_contamination(spark):
    item = " ".join(f"w{i}" for i in range(20))
    got = D.contaminated(frame(spark, "before " + item + " after", "nothing"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["shared"]) for r in got] == [(0, 7, 8)]


def test_gram_lists(spark):
    """Equal grams and only these have equal hashes, whatever stands around them."""
    from quillmill.functions.grams import gram_lists

    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "b", "ab", "é", "日本", ""]) for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["", None, "a b", " a  b\tc "]
    for n in (1, 2, 3, 5):
        names, hashes = {}, {}
        for text, got in zip(texts, gram_lists(pa.array(texts), n).to_pylist(), strict=True):
            w = (text or "").split()
            grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
            assert (got is None) == (not grams) and len(got or []) == len(grams) and (got or []) == sorted(got or [])
            hashes |= dict.fromkeys(got or [])
            names |= dict.fromkeys(grams)
        assert len(names) == len(hashes)
    both = gram_lists(pa.array(["x y z a b c", "q a b c", "a b c"]), 3).to_pylist()
    assert set(both[2]) < set(both[0]) and set(both[2]) < set(both[1]) and len(set(both[0]) & set(both[1])) == 1


def mutated(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"x{rng.randrange(10**9)}"
    return words


def test_pivot_links_have_the_components_of_all_pairs(spark):
    """Chains around a text, at every distance from the pivot; buckets of more than two members are hot."""
    rng = random.Random(11)
    texts = []
    for _ in range(6):
        chain = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(12):
            texts.append(" ".join(chain))
            texts.append(" ".join(mutated(rng, chain, rng.randint(0, 5))))
            chain = mutated(rng, chain, rng.randint(1, 4))
    rng.shuffle(texts)
    docs = frame(spark, *texts)
    def roots(edges):
        return {r["doc_id"]: r["cluster_id"] for r in D.clusters(edges).collect()}

    want = roots(D.fuzzy_pairs(docs))
    links = D.fuzzy_links(docs, hot=2)
    assert roots(links) == want == roots(D.fuzzy_links(docs)) and len(set(want.values())) < len(want) / 2
    jaccard = {(r["a"], r["b"]): r["jaccard"] for r in D.fuzzy_pairs(docs).collect()}
    assert all(jaccard[r["a"], r["b"]] == r["jaccard"] for r in links.collect())


def test_a_hot_bucket_costs_its_size(spark):
    """Three thousand different near copies of one text: links and comparisons near their number, not its square."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    docs = frame(spark, *(" ".join(mutated(rng, base, 1)) for _ in range(3000))).repartition(4)
    links = D.fuzzy_links(docs).cache()
    assert links.count() < 20 * 3000  # a pivot for each band at most
    assert {r["cluster_id"] for r in D.clusters(links).collect()} == {0} and D.clusters(links).count() == 3000


def test_recall_of_the_bands(spark):
    """Pairs at a Jaccard of about 0.8 and 0.9: of those at or over 0.8, nearly all are found."""
    rng = random.Random(9)
    for changed, least in ((3, 0.97), (6, 0.97), (1, 0.99)):
        texts = []
        for _ in range(300):
            base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
            texts += [" ".join(base), " ".join(mutated(rng, base, changed))]
        docs = frame(spark, *texts)
        exact = {(r["a"], r["b"]) for r in D.exact_jaccard_pairs(docs).collect()}
        found = {(r["a"], r["b"]) for r in D.fuzzy_pairs(docs).collect()}
        assert len(exact) > 100 and found <= exact and len(found) >= least * len(exact)
