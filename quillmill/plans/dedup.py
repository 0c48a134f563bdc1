"""Queries over duplicates: lines, documents, n-grams, MinHash, LSH, clusters, contamination."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.operators import dedup as D
from quillmill.plans.registry import Catalog

query = Catalog()

_LINES = "SELECT doc_id, unnest(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)), 1) AS line_no FROM documents"
_WORDS = r"list_filter(string_split(trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '')"


def _grams(n: int, table: str = "documents", key: str = "doc_id") -> str:
    return f"SELECT {key}, list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS grams FROM (SELECT {key}, {_WORDS} AS w FROM {table}) WHERE len(w) >= {n}"


@query("line_frequency", "documents", sql=f"SELECT md5(line) AS hash, count(*)::BIGINT AS n FROM ({_LINES}) GROUP BY 1")
def line_frequency(docs):
    return D.line_counts(docs)


@query("line_dedup_unique", "documents", sql=f"""
WITH l AS (SELECT *, count(*) OVER (PARTITION BY md5(line)) AS n FROM ({_LINES})),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS t, count(*) AS n_kept FROM l WHERE n = 1 GROUP BY doc_id)
SELECT d.doc_id, md5(coalesce(k.t, '')) AS text_md5, coalesce(k.n_kept, 0)::BIGINT AS n_kept FROM documents d LEFT JOIN k USING (doc_id)""")
def line_dedup_unique(docs):
    return D.unique_lines(docs).select("doc_id", F.md5("text").alias("text_md5"), "n_kept")


@query("exact_doc_dedup", "documents", sql="SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY md5(text)")
def exact_doc_dedup(docs):
    return D.exact_documents(docs).select("doc_id", "copies")


@query("ngram_sets", "documents", sql=f"SELECT doc_id, len(grams)::BIGINT AS n_grams FROM ({_grams(5)})")
def ngram_sets(docs):
    return D.document_grams(docs).select("doc_id", F.size("grams").cast("long").alias("n_grams"))


@query("ngram_counts", "documents", sql=f"SELECT md5(g) AS gram_md5, count(*)::BIGINT AS n_docs FROM (SELECT doc_id, unnest(grams) AS g FROM ({_grams(5)})) GROUP BY 1 HAVING count(*) > 1")
def ngram_counts(docs):
    return D.shared_grams(docs)


_EXACT = f"""
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS g FROM ({_grams(5)})),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) / (min(a.n) + min(b.n) - count(*))::DOUBLE AS jaccard FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
  HAVING count(*) / (min(a.n) + min(b.n) - count(*))::DOUBLE >= 0.8)"""


# documents with the same grams are one class: pairs of their smallest ids, and every other member with its own
_CLASSES = f"""
m AS (SELECT doc_id, grams, min(doc_id) OVER (PARTITION BY md5(array_to_string(list_sort(grams), '|'))) AS low FROM ({_grams(5)})),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS g FROM m WHERE doc_id = low),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) / (min(a.n) + min(b.n) - count(*))::DOUBLE AS jaccard FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
  HAVING count(*) / (min(a.n) + min(b.n) - count(*))::DOUBLE >= 0.8 UNION ALL SELECT low, doc_id, 1.0::DOUBLE FROM m WHERE doc_id <> low)"""


@query("jaccard_pairs", "documents", sql=f"WITH {_CLASSES} SELECT a, b, round(jaccard, 6) AS jaccard FROM p")
def jaccard_pairs(docs):
    return D.exact_jaccard_pairs(docs).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def _minhash_sql(n_hashes: int) -> str:
    rows = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(D.coefficients(n_hashes)))
    return f"""
h AS (SELECT doc_id, ('0x' || substr(md5(g), 1, 8))::BIGINT & {D.PRIME} AS h FROM (SELECT doc_id, unnest(grams) AS g FROM ({_grams(5)}))),
c AS (SELECT * FROM (VALUES {rows}) c(i, a, b)),
m AS (SELECT doc_id, i, min((h * a::BIGINT + b) % {D.PRIME}) AS v FROM h, c GROUP BY 1, 2),
s AS (SELECT doc_id, list(v ORDER BY i) AS sig FROM m GROUP BY 1)"""


@query("minhash_signatures", "documents", sql=f"WITH {_minhash_sql(100)} SELECT doc_id, md5(array_to_string(sig, ',')) AS signature_md5 FROM s")
def minhash_signatures(docs):
    return D.minhash_signatures(docs).select("doc_id", F.md5(F.array_join(F.transform("signature", lambda v: v.cast("string")), ",")).alias("signature_md5"))


@query("lsh_candidates", "documents", sql=f"""WITH {_minhash_sql(100)},
b AS (SELECT doc_id, band, array_to_string(sig[band * 5 + 1:band * 5 + 5], ',') AS key FROM s, (SELECT unnest(range(20)) AS band))
SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM b x JOIN b y ON x.band = y.band AND x.key = y.key AND x.doc_id < y.doc_id""")
def lsh_candidates(docs):
    return D.lsh_candidates(D.minhash_signatures(docs), 20)


@query("lsh_verified_pairs", "documents", sql=f"WITH {_CLASSES} SELECT a, b, round(jaccard, 6) AS jaccard FROM p")
def lsh_verified_pairs(docs):
    return D.fuzzy_pairs(docs, complete=True).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


_CLUSTER = f"""WITH RECURSIVE {_EXACT},
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT a AS doc_id, a AS low FROM e UNION SELECT e.b, r.low FROM r JOIN e ON r.doc_id = e.a WHERE r.low < e.b)"""


@query("dup_clusters", "documents", sql=f"{_CLUSTER} SELECT doc_id, min(low) AS cluster_id FROM r GROUP BY doc_id")
def dup_clusters(docs):
    return D.clusters(D.fuzzy_links(docs))


@query("dedup_kept", "documents", sql=f"{_CLUSTER} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM r WHERE low < doc_id)")
def dedup_kept(docs):
    return D.drop_duplicates_of(docs, D.clusters(D.fuzzy_links(docs))).select("doc_id")


@query("dedup_stats", "documents", sql=f"{_CLUSTER} SELECT count(*)::BIGINT AS n_members, count(DISTINCT low)::BIGINT AS n_clusters, count(CASE WHEN low < doc_id THEN 1 END)::BIGINT AS n_removed FROM (SELECT doc_id, min(low) AS low FROM r GROUP BY doc_id)")
def dedup_stats(docs):
    c = D.clusters(D.fuzzy_links(docs))
    return c.agg(F.count("*").alias("n_members"), F.countDistinct("cluster_id").alias("n_clusters"), F.count(F.when(F.col("cluster_id") < F.col("doc_id"), 1)).alias("n_removed"))


@query("benchmark_contamination", "documents", "benchmark", sql=f"""
WITH d AS (SELECT doc_id, unnest(grams) AS g FROM ({_grams(13)})), i AS (SELECT item_id, unnest(grams) AS g FROM ({_grams(13, "benchmark", "item_id")}))
SELECT doc_id, item_id, count(*)::BIGINT AS shared FROM d JOIN i USING (g) GROUP BY 1, 2""")
def benchmark_contamination(docs, benchmark):
    return D.contaminated(docs, benchmark)
