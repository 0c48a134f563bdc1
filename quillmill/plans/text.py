"""Queries over texts: masking, normalising, quality rules, the cascade, HTML."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.functions.html import extract_text_udf
from quillmill.functions.tokens import treebank_tokens
from quillmill.operators import quality as Q
from quillmill.plans.registry import Catalog
from quillmill.session import shared_folder
from quillmill.sources import sinks as S

query = Catalog()

_EMAIL, _IP = T.EMAIL, T.IP
_PHONE = rf"(^|[^\p{{L}}\p{{N}}_])({T.PHONE_CORE})\b"


def _masked(column, f):
    return column.select("doc_id", f(F.col("text")).alias("m")).select("doc_id", F.md5("m.text").alias("masked_md5"), F.col("m.n").alias("n"))


def _masked_sql(pattern: str, mark: str, group: str = "") -> str:
    return f"SELECT doc_id, md5(regexp_replace(text, '{pattern}', '{group}{mark}', 'g')) AS masked_md5, len(regexp_extract_all(text, '{pattern}'))::BIGINT AS n FROM documents"


@query("pii_email_mask", "documents", sql=_masked_sql(_EMAIL, T.EMAIL_MARK))
def pii_email_mask(docs):
    return _masked(docs, T.mask_emails)


@query("pii_phone_mask", "documents", sql=_masked_sql(_PHONE, T.PHONE_MARK, r"\1"))
def pii_phone_mask(docs):
    return _masked(docs, T.mask_phone_numbers)


@query("pii_ip_mask", "documents", sql=_masked_sql(_IP, T.IP_MARK))
def pii_ip_mask(docs):
    return _masked(docs, T.mask_ips)


@query("pii_mask_all_counts", "documents", sql=rf"""
WITH e AS (SELECT doc_id, text, regexp_replace(text, '{_EMAIL}', '{T.EMAIL_MARK}', 'g') AS t1 FROM documents),
p AS (SELECT *, regexp_replace(t1, '{_PHONE}', '\1{T.PHONE_MARK}', 'g') AS t2 FROM e)
SELECT doc_id, md5(regexp_replace(t2, '{_IP}', '{T.IP_MARK}', 'g')) AS masked_md5, len(regexp_extract_all(text, '{_EMAIL}'))::BIGINT AS n_email,
  len(regexp_extract_all(t1, '{_PHONE}'))::BIGINT AS n_phone, len(regexp_extract_all(t2, '{_IP}'))::BIGINT AS n_ip FROM p""")
def pii_mask_all_counts(docs):
    return docs.select("doc_id", T.mask_pii(F.col("text")).alias("m")).select("doc_id", F.md5("m.text").alias("masked_md5"), "m.n_email", "m.n_phone", "m.n_ip")


@query("length_filter_scalar", "documents", sql=r"SELECT doc_id, n_chars FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 50")
def length_filter_scalar(docs):
    return docs.where(~Q.SCALAR.too_short(F.col("text"))).select("doc_id", "n_chars")


@query("length_filter_batched", "documents", sql="SELECT doc_id, n_chars FROM documents WHERE length(text) > 50")
def length_filter_batched(docs):
    return docs.where(~Q.BATCHED.too_short(F.col("text"))).select("doc_id", "n_chars")


@query("sample_length_filter", "documents", sql=r"SELECT doc_id, n_chars FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 200")
def sample_length_filter(docs):
    return docs.where(F.length(F.btrim("text", F.lit(Q.BLANKS))) >= 200).select("doc_id", "n_chars")


_NORMAL = r"trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"


@query("text_normalize", "documents", sql=f"SELECT doc_id, md5({_NORMAL}) AS normal_md5, length({_NORMAL})::BIGINT AS n FROM documents")
def text_normalize(docs):
    return docs.select("doc_id", T.normalize_text(F.col("text")).alias("t")).select("doc_id", F.md5("t").alias("normal_md5"), F.length("t").cast("long").alias("n"))


@query("collapse_ws", "documents", sql=r"SELECT doc_id, md5(substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 10000)) AS text_md5 FROM documents")
def collapse_ws(docs):
    return docs.select("doc_id", F.md5(T.collapse_ws(F.col("text"))).alias("text_md5"))


@query("one_line", "documents", sql=r"SELECT doc_id, md5(regexp_replace(replace(text, chr(10), ' '), '^\s+|\s+$', '', 'g')) AS text_md5 FROM documents")
def one_line(docs):
    return docs.select("doc_id", F.md5(T.one_line(F.col("text"))).alias("text_md5"))


@query("fasttext_lines", "documents", "labels", sql=r"""SELECT md5('__label__' || CASE WHEN quality = 1 THEN 'wiki' ELSE 'cc' END || ' ' || regexp_replace(replace(text, chr(10), ' '), '^\s+|\s+$', '', 'g')) AS line_md5
FROM documents JOIN labels USING (doc_id) WHERE length(text) > 100""")
def fasttext_lines(docs, labels):
    rows = docs.where(F.length("text") > 100).join(labels, "doc_id")
    return rows.select(F.md5(T.fasttext_line(F.when(F.col("quality") == 1, "wiki").otherwise("cc"), F.col("text"))).alias("line_md5"))


@query("line_hashes", "documents", sql="SELECT doc_id, unnest(list_transform(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)), lambda x: md5(x))) AS line_hash FROM documents")
def line_hashes(docs):
    from quillmill.operators.dedup import exploded_lines

    return exploded_lines(docs).select("doc_id", T.line_hash(F.col("line")).alias("line_hash"))


_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"
_LINES = "string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))"
_METRICS = rf"""SELECT doc_id, text, lang, len({_WORDS})::BIGINT AS n_words,
 CASE WHEN len({_WORDS}) > 0 THEN length(regexp_replace(text, '\s+', '', 'g')) / len({_WORDS})::DOUBLE ELSE 0 END AS mean_word_len,
 len(list_filter({_LINES}, lambda x: regexp_matches(x, '\.\.\.\s*$'))) / len({_LINES})::DOUBLE AS ellipsis_ratio,
 CASE WHEN len({_WORDS}) > 0 THEN len(list_filter({_WORDS}, lambda x: regexp_matches(x, '\p{{L}}'))) / len({_WORDS})::DOUBLE ELSE 0 END AS alpha_ratio FROM documents"""
_PASS = "(n_words BETWEEN 50 AND 100000 AND mean_word_len BETWEEN 3 AND 10 AND ellipsis_ratio <= 0.3 AND alpha_ratio >= 0.8)"

for _name, _digits in (("n_words", None), ("mean_word_len", 6), ("ellipsis_ratio", 6), ("alpha_ratio", 6)):
    _value = _name if _digits is None else f"round({_name}, {_digits})"

    @query({"n_words": "gopher_word_count", "mean_word_len": "gopher_mean_word_len", "ellipsis_ratio": "gopher_ellipsis_ratio", "alpha_ratio": "gopher_alpha_ratio"}[_name], "documents", sql=f"SELECT doc_id, {_value} AS {_name} FROM ({_METRICS})")
    def _metric(docs, name=_name, digits=_digits):
        scored = Q.with_quality(docs)
        return scored.select("doc_id", name if digits is None else F.round(name, digits).alias(name))


@query("gopher_pass", "documents", sql=f"SELECT doc_id, {_PASS} AS gopher_pass FROM ({_METRICS})")
def gopher_pass(docs):
    return Q.with_quality(docs).select("doc_id", "gopher_pass")


# RE2 looks neither ahead nor back: marks are set apart by replacements, one after the other
_SPACED = "text"
for _pattern, _with in (
    (r"(^|[^\p{Lu}]|[\p{L}\p{N}]\p{Lu})\.([\])}>\"'']*)(\s*$|\s+[^\s\p{Ll}])", r"\1 . \2\3"), (r"\.\.\.", " ... "), ("--", " -- "), (r"([;@#$%&?!()\[\]{}<>\"])", r" \1 "), (r"([,:])([^\p{N}]|$)", r" \1 \2"), (r"([,:])([^\p{N}]|$)", r" \1 \2"),
    (r"([nN]''[tT])([^\p{L}\p{N}_]|$)", r" \1\2"), (r"(''(?:ll|LL|re|RE|ve|VE|[sSmMdD]))([^\p{L}\p{N}_]|$)", r" \1 \2"), (r"''(\s|$)", r" '' \1"),
):
    _SPACED = f"regexp_replace({_SPACED}, '{_pattern}', '{_with}', 'g')"
_TREE = rf"list_filter(string_split_regex({_SPACED}, '\s+'), lambda x: x <> '')"


@query("gopher_tokens", "documents", sql=rf"""SELECT doc_id, len(w)::BIGINT AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5, round(length(array_to_string(w, '')) / len(w)::DOUBLE, 6) AS mean_word_len,
 round(len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) / len(w)::DOUBLE, 6) AS alpha_ratio FROM (SELECT doc_id, {_TREE} AS w FROM documents) WHERE len(w) > 0""")
def gopher_tokens(docs):
    """The metrics over treebank tokens."""
    scored = Q.with_quality(docs.withColumn("_w", treebank_tokens(F.col("text"))), treebank=True).where("n_words > 0")
    return scored.select("doc_id", F.col("n_words").alias("n_tokens"), F.md5(F.array_join("_w", " ")).alias("tokens_md5"), F.round("mean_word_len", 6).alias("mean_word_len"), F.round("alpha_ratio", 6).alias("alpha_ratio"))


def _scored(docs, labels):
    """Labels stand in for model scores: toxic 1 scores 0.9; quality 0 is low."""
    marks = labels.select("doc_id", F.when(F.col("toxic") == 1, 0.9).otherwise(0.1).alias("toxic_score"), F.when(F.col("quality") == 0, "low").otherwise("high").alias("quality"))
    return docs.join(marks, "doc_id", "left").withColumns({"lang_score": F.lit(1.0), "nsfw_score": F.lit(0.0), "quality_score": F.lit(1.0)})


_REASON = rf"""SELECT m.doc_id, m.text, CASE WHEN length(regexp_replace(m.text, '^\s+|\s+$', '', 'g')) < 50 THEN 'short' WHEN lang <> 'en' THEN 'language'
 WHEN NOT {_PASS} THEN 'gopher' WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 0 THEN 'quality' END AS reason FROM ({_METRICS}) m LEFT JOIN labels l ON m.doc_id = l.doc_id"""


_BATCHED_REASON = rf"""SELECT m.doc_id, CASE WHEN length(m.text) <= 50 THEN 'short' WHEN lang <> 'en' THEN 'language'
 WHEN NOT {_PASS} THEN 'gopher' WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 0 THEN 'quality' END AS reason FROM ({_METRICS}) m LEFT JOIN labels l ON m.doc_id = l.doc_id"""


@query("filter_cascade_kept", "documents", "labels", sql=rf"""
WITH k AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{_EMAIL}', '{T.EMAIL_MARK}', 'g'), '{_PHONE}', '\1{T.PHONE_MARK}', 'g'), '{_IP}', '{T.IP_MARK}', 'g') AS t FROM ({_REASON}) WHERE reason IS NULL)
SELECT doc_id, md5(t) AS text_md5 FROM k""")
def filter_cascade_kept(docs, labels):
    return Q.kept_and_masked(Q.discard_reason(_scored(docs, labels))).select("doc_id", F.md5("text").alias("text_md5"))


@query("filter_funnel", "documents", "labels", sql=f"SELECT coalesce(reason, 'kept') AS reason, count(*)::BIGINT AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS pct FROM ({_REASON}) GROUP BY 1")
def filter_funnel(docs, labels):
    return Q.funnel(Q.discard_reason(_scored(docs, labels))).select("reason", "n", F.round("pct", 6).alias("pct"))


@query("funnel_written", "documents", "labels", sql=f"""SELECT coalesce(reason, 'kept') AS reason, count(*)::BIGINT AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS pct,
 CASE WHEN reason IS NULL THEN count(*)::BIGINT END AS written FROM ({_REASON}) GROUP BY reason""")
def funnel_written(docs, labels):
    """The funnel as it is counted by the pass that writes what is kept, beside the number of rows then found there."""
    spark, path = docs.sparkSession, f"{shared_folder(docs.sparkSession)}/funnel-{uuid.uuid4().hex}"
    report = S.write_kept(Q.discard_reason(_scored(docs, labels)), path)
    n = spark.read.json(path).agg(F.count("*").alias("k"))
    return report.join(n).select("reason", "n", F.round("pct", 6).alias("pct"), F.when(F.col("reason") == "kept", F.col("k")).alias("written"))


@query("filter_funnel_batched", "documents", "labels", sql=f"SELECT coalesce(reason, 'kept') AS reason, count(*)::BIGINT AS n FROM ({_BATCHED_REASON}) GROUP BY 1")
def filter_funnel_batched(docs, labels):
    return Q.funnel(Q.discard_reason(_scored(docs, labels), Q.BATCHED)).select("reason", "n")


@query("lang_gate", "documents", sql="SELECT lang, count(*)::BIGINT AS n, count(CASE WHEN lang = 'en' THEN 1 END)::BIGINT AS kept FROM documents GROUP BY lang")
def lang_gate(docs):
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.count(F.when(F.col("lang") == "en", 1)).alias("kept"))


@query("training_text_filter", "documents", "labels", sql=r"""SELECT doc_id, quality FROM documents JOIN labels USING (doc_id)
WHERE (quality = 1 AND length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 100) OR (quality = 0 AND length(text) > 100)""")
def training_text_filter(docs, labels):
    size = F.when(F.col("quality") == 1, F.length(F.btrim("text", F.lit(Q.BLANKS)))).otherwise(F.length("text"))
    return docs.join(labels, "doc_id").where(size > 100).select("doc_id", "quality")


@query("html_title", "pages", sql=r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def html_title(pages):
    return pages.select("page_id", T.html_title(F.col("html")).alias("title"))


def _html_sql() -> str:
    x = "regexp_replace(html, '(?is)<!--.*?-->|<(script|style|head|noscript)\\b.*?</(script|style|head|noscript)>', ' ', 'g')"
    x = f"regexp_replace(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '(?i)</?(?:{T._BLOCKS})\\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    x = f"regexp_replace(regexp_replace({x}, ' *\\n *', chr(10), 'g'), '\\n+', chr(10), 'g')"
    return f"SELECT page_id, md5(regexp_replace({x}, '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM pages"


@query("html_text_native", "pages", sql=_html_sql())
def html_text_native(pages):
    return pages.select("page_id", F.md5(T.html_text(F.col("html"))).alias("text_md5"))


@query("html_extract", "pages")
def html_extract(pages):
    return pages.select("page_id", extract_text_udf("html").alias("text"))


@query("url_host", "pages", sql=r"SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)) AS host, count(*)::BIGINT AS n FROM pages GROUP BY 1")
def url_host(pages):
    return pages.groupBy(T.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("change_snippets", "documents", sql=rf"""WITH m AS (SELECT doc_id, text, regexp_replace(text, '{_IP}', '{T.IP_MARK}', 'g') AS masked FROM documents),
p AS (SELECT *, instr(text, regexp_extract(text, '{_IP}')) - 1 AS i FROM m WHERE text <> masked)
SELECT doc_id, md5(text[greatest(i - 120, 0) + 1:least(i + 120, length(masked))]) AS before_md5, md5(masked[greatest(i - 120, 0) + 1:least(i + 120, length(masked))]) AS after_md5 FROM p""")
def change_snippets(docs):
    """Around the first character that masking changed."""
    rows = docs.select("doc_id", "text", T.mask_ips(F.col("text"))["text"].alias("masked"))
    cut = rows.where("text != masked").select("doc_id", T.snippet_around_change(F.col("text"), F.col("masked")).alias("s"))
    return cut.select("doc_id", F.md5("s.before").alias("before_md5"), F.md5("s.after").alias("after_md5"))


@query("pii_snippets", "documents", sql=rf"""WITH m AS (SELECT doc_id, text, instr(text, regexp_extract(text, '{_IP}')) AS p FROM documents WHERE regexp_matches(text, '{_IP}'))
SELECT doc_id, md5(substring(text, greatest(p - 120, 1), p + 120 - greatest(p - 120, 1))) AS snippet_md5 FROM m""")
def pii_snippets(docs):
    return docs.select("doc_id", T.snippet_around(F.col("text"), _IP).alias("s")).where(F.col("s").isNotNull()).select("doc_id", F.md5("s").alias("snippet_md5"))
