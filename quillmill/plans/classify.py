"""Queries over labels and trained classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions.rewards import toxic_score
from quillmill.operators import classify as C
from quillmill.operators import quality as Q
from quillmill.operators import sampling as S
from quillmill.plans.registry import Catalog

query = Catalog()


@query("balanced_sample", "labels", sql="""
WITH c AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY quality)),
r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) AS r FROM labels WHERE quality IS NOT NULL)
SELECT doc_id, quality FROM r, c WHERE r <= least""")
def balanced_sample(labels):
    return S.balanced(labels, "quality", "doc_id").select("doc_id", "quality")


@query("random_sample", "documents", sql="SELECT doc_id, source FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50")
def random_sample(docs):
    return S.sample_rows(docs.select("doc_id", "source"), "doc_id", 50)


@query("weighted_reservoir", "documents", sql="""SELECT doc_id, n_chars FROM documents WHERE n_chars > 0
ORDER BY -ln((('0x' || substr(md5('42:' || doc_id), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / n_chars, doc_id LIMIT 50""")
def weighted_reservoir(docs):
    """Fifty documents, drawn by their length."""
    return S.reservoir(docs.select("doc_id", "n_chars"), "doc_id", 50, F.col("n_chars")).select("doc_id", "n_chars")


@query("batch_numbers", "labels", sql="SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 32)::BIGINT AS batch FROM labels")
def batch_numbers(labels):
    return S.batches(labels.select("doc_id"), "doc_id", 32)


@query("label_join_stats", "documents", "labels", sql="""SELECT lang, quality, toxic, count(*)::BIGINT AS n, round(avg(n_chars), 6) AS avg_chars FROM documents JOIN labels USING (doc_id) GROUP BY ALL""")
def label_join_stats(docs, labels):
    return docs.join(labels, "doc_id").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("avg_chars"))


@query("langid_predict", "documents")
def langid_predict(docs):
    profiles = C.language_profiles(docs.where(~C.held_out("doc_id")))
    return C.identify_language(docs, profiles)


@query("language_profiles", "documents", sql=r"""
WITH p AS (SELECT lang, ' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ' AS t FROM documents WHERE lang IS NOT NULL),
g AS (SELECT lang, t[i:i + 2] AS gram FROM (SELECT lang, t, unnest(range(1, length(t) - 1)) AS i FROM p)),
c AS (SELECT lang, gram, count(*) AS n FROM g GROUP BY ALL), s AS (SELECT lang, sum(n) AS total, count(*) AS kinds FROM c GROUP BY lang),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS r FROM c)
SELECT gram, r.lang, round(ln((n + 1) / (total + kinds)::DOUBLE), 6) AS logp FROM r JOIN s ON r.lang = s.lang WHERE r <= 400""")
def language_profiles(docs):
    return C.language_profiles(docs).withColumn("logp", F.round("logp", 6))


@query("quality_predict", "documents", "labels")
def quality_predict(docs, labels):
    return C.train_and_predict(docs, labels, "quality")


@query("toxic_predict", "documents", "labels")
def toxic_predict(docs, labels):
    return C.train_and_predict(docs, labels, "toxic")


@query("classifier_confusion", "documents", "labels")
def classifier_confusion(docs, labels):
    return C.confusion(C.train_and_predict(docs, labels, "quality"))


_LABELLED = """SELECT d.doc_id, CASE WHEN quality = 1 THEN 'wiki' WHEN quality = 0 THEN 'cc' END AS label, (50 + d.doc_id % 50) / 100.0::DOUBLE AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def _labelled(docs, labels):
    name = F.when(F.col("quality") == 1, "wiki").when(F.col("quality") == 0, "cc")
    return docs.select("doc_id").join(labels, "doc_id", "left").select("doc_id", name.alias("label"), ((50 + F.col("doc_id") % 50) / 100.0).alias("score"))


@query("label_filter", "documents", "labels", sql=f"SELECT doc_id, label, round(score, 6) AS score FROM ({_LABELLED}) WHERE label = 'wiki' AND score >= 0.7")
def label_filter(docs, labels):
    return C.filter_by_label(_labelled(docs, labels), "wiki", 0.7).select("doc_id", "label", F.round("score", 6).alias("score"))


@query("label_filter_inverse", "documents", "labels", sql=f"SELECT doc_id, label, round(score, 6) AS score FROM ({_LABELLED}) WHERE NOT coalesce(label = 'wiki' AND score >= 0.7, false)")
def label_filter_inverse(docs, labels):
    return C.filter_by_label(_labelled(docs, labels), "wiki", 0.7, inverse=True).select("doc_id", "label", F.round("score", 6).alias("score"))


@query("language_folding", "documents", sql="""SELECT label, CASE WHEN label LIKE 'zh%' THEN 'zh' WHEN label LIKE 'en%' THEN 'en' ELSE label END AS folded, count(*)::BIGINT AS n
FROM (SELECT lang || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '_Latn' ELSE '-GB' END AS label FROM documents UNION ALL SELECT 'zho_Hans' FROM documents) GROUP BY ALL""")
def language_folding(docs):
    variant = F.concat("lang", F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "_Latn").otherwise("-GB"))
    labels = docs.select(variant.alias("label")).unionByName(docs.select(F.lit("zho_Hans").alias("label")))
    return labels.groupBy("label", C.fold_language(F.col("label")).alias("folded")).agg(F.count("*").alias("n"))


@query("filter_cascade_trained", "documents", "labels")
def filter_cascade_trained(docs, labels):
    """The cascade on scores of models trained here: language profiles, toxicity and quality. No table labels NSFW, so its gate is open."""
    language = C.identify_language(docs, C.language_profiles(docs)).select("doc_id", F.col("label").alias("lang"), F.col("score").alias("lang_score"))
    toxic = C.score_documents(docs, labels, "toxic").select("doc_id", F.col("score").alias("toxic_score"))
    quality = C.score_documents(docs, labels, "quality").select("doc_id", F.when(F.col("pred") == 1, "high").otherwise("low").alias("quality"), F.greatest("score", 1 - F.col("score")).alias("quality_score"))
    scored = docs.drop("lang").join(language, "doc_id").join(toxic, "doc_id").join(quality, "doc_id").withColumn("nsfw_score", F.lit(0.0))
    return Q.discard_reason(scored).select("doc_id", "discard_reason")


@query("toxic_score_map", "labels", sql="SELECT doc_id, round(CASE WHEN toxic = 1 THEN 0.9 ELSE 1 - 0.9 END::DOUBLE, 6) AS score FROM labels")
def toxic_score_map(labels):
    label = F.when(F.col("toxic") == 1, "toxic").otherwise("non-toxic")
    return labels.select("doc_id", F.round(toxic_score(label, F.lit(0.9)), 6).alias("score"))
