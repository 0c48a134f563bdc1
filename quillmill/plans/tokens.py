"""Queries over tokens: pre-tokens, pairs, learnt vocabularies, streams, windows, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmill.functions.text import pretokens
from quillmill.operators import bpe, tokens
from quillmill.plans.registry import Catalog
from quillmill.session import shared_folder

query = Catalog()

# RE2 has no look-ahead; on text whose white-space runs are single this is the same split
_PRETOKEN = r"''(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
_PRE = f"SELECT doc_id, unnest(regexp_extract_all(text, '{_PRETOKEN}')) AS pretoken FROM documents"


@query("pretoken_counts", "documents", sql=f"SELECT pretoken, count(*)::BIGINT AS n FROM ({_PRE}) GROUP BY 1")
def pretoken_counts(docs):
    return bpe.pretoken_counts(docs)


@query("pretoken_top", "documents", sql=f"SELECT pretoken, count(*)::BIGINT AS n FROM ({_PRE}) GROUP BY 1 ORDER BY n DESC, pretoken LIMIT 50")
def pretoken_top(docs):
    return bpe.pretoken_counts(docs).orderBy(F.desc("n"), "pretoken").limit(50)


_PAIRS = f"""SELECT substr(h, i * 2 + 1, 4) AS pair, sum(n)::BIGINT AS n FROM (SELECT h, n, unnest(range(len(h) // 2 - 1)) AS i FROM
 (SELECT hex(encode(pretoken)) AS h, count(*) AS n FROM ({_PRE}) GROUP BY pretoken)) GROUP BY 1"""


@query("byte_pair_stats", "documents", sql=_PAIRS)
def byte_pair_stats(docs):
    return bpe.byte_pairs(bpe.pretoken_counts(docs))


@query("best_pair", "documents", sql=f"SELECT pair, n FROM ({_PAIRS}) ORDER BY n DESC, pair DESC LIMIT 1")
def best_pair(docs):
    return bpe.byte_pairs(bpe.pretoken_counts(docs)).agg(F.max(F.struct("n", "pair")).alias("x")).select("x.pair", "x.n")


@query("bpe_vocab", "documents")
def bpe_vocab(docs):
    v = bpe.train_bpe(docs, 400, ("<|endoftext|>",))
    return docs.sparkSession.createDataFrame([(i, t.hex()) for i, t in v.tokens.items()], "token_id int, token_hex string")


#: A fixed vocabulary for the queries about ids: the bytes, these merges in order, and a mark that ends a document.
MERGES = tuple((a.encode(), b.encode()) for a, b in (
    (" ", "t"), ("h", "e"), ("i", "n"), ("r", "e"), (" ", "a"), ("o", "n"), (" t", "he"), ("e", "r"), ("n", "d"), ("a", "t"), ("e", "s"), (" ", "s"),
    ("e", "n"), ("o", "r"), (" a", "nd"), ("i", "t"), ("l", "e"), ("a", "n"), ("i", "on"), ("t", "ion"), (" ", "c"), ("l", "l"), ("s", "s"), ("in", "g"),
    ("o", "u"), (" ", "d"), ("u", "n"), (" d", "e"), ("e", "l"), ("el", "le"), ("m", "en"), ("men", "t"), ("a", "a"),
))
END_MARK = "<|endoftext|>"


def _vocabulary() -> bpe.Vocabulary:
    tokens = [*(bytes([b]) for b in range(256)), *(a + b for a, b in MERGES)]
    return bpe.Vocabulary(dict(enumerate(tokens)), list(MERGES), (END_MARK,))


END = 256 + len(MERGES)


def _ids_sql(table: str, *keys: str) -> str:
    """Ids of every text: pre-tokens as hex bytes with blanks of their own, in which each merge in turn is a replacement."""
    merged = r"regexp_replace(hex(encode(pre)), '(..)', ' \1 ', 'g')"
    for a, b in MERGES:
        x, y = a.hex().upper(), b.hex().upper()
        merged = f"replace({merged}, ' {x}  {y} ', ' {x}{y} ')"
    longer = ", ".join(f"'{(a + b).hex().upper()}'" for a, b in MERGES)
    key = ", ".join(keys)
    return f"""SELECT {key}, coalesce(ids, []) AS ids FROM (SELECT {key} FROM {table}) LEFT JOIN (
 SELECT {key}, flatten(list(ids ORDER BY k)) AS ids FROM (SELECT {key}, unnest(regexp_extract_all(text, '{_PRETOKEN}')) AS pre, generate_subscripts(regexp_extract_all(text, '{_PRETOKEN}'), 1) AS k FROM {table})
 JOIN (SELECT pre, list_transform(string_split_regex(trim({merged}), ' +'), lambda y: CASE WHEN length(y) = 2 THEN ('0x' || y)::INTEGER ELSE 255 + list_position([{longer}], y) END) AS ids
  FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '{_PRETOKEN}')) AS pre FROM {table})) USING (pre) GROUP BY {key}) USING ({key})"""


def _ids(docs, *keys):
    return docs.select(*keys, bpe.encode_udf(docs.sparkSession, _vocabulary())("text").alias("ids"))


def _with_end(docs):
    return _ids(docs, "doc_id").select("doc_id", tokens.with_end(F.col("ids"), END).alias("ids"))


def _joined(ids):
    return F.array_join(F.col(ids).cast("array<string>") if isinstance(ids, str) else ids.cast("array<string>"), " ")


_IDS = _ids_sql("documents", "doc_id")
_STREAM = f"SELECT doc_id, list_concat(ids, [{END}]) AS ids FROM ({_IDS})"


@query("encode_ids", "documents", sql=f"SELECT doc_id, len(ids)::BIGINT AS n_ids, md5(array_to_string(ids, ' ')) AS ids_md5 FROM ({_IDS})")
def encode_ids(docs):
    return _ids(docs, "doc_id").select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.md5(_joined("ids")).alias("ids_md5"))


@query("token_frequency", "documents", sql=f"SELECT id AS token_id, count(*)::BIGINT AS n FROM (SELECT unnest(ids) AS id FROM ({_IDS})) GROUP BY 1")
def token_frequency(docs):
    return _ids(docs, "doc_id").select(F.explode("ids").alias("token_id")).groupBy("token_id").agg(F.count("*").alias("n"))


@query("encode_roundtrip", "documents", sql="SELECT doc_id, md5(text) AS text_md5 FROM documents")
def encode_roundtrip(docs):
    return _ids(docs, "doc_id").select("doc_id", F.md5(bpe.decode_udf(docs.sparkSession, _vocabulary())("ids")).alias("text_md5"))


@query("decode_join", "documents", sql="SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text <> ''")
def decode_join(docs):
    vocabulary = docs.sparkSession.createDataFrame([(i, bytearray(t)) for i, t in _vocabulary().tokens.items()], "token_id int, token binary")
    numbered = docs.withColumn("row", F.monotonically_increasing_id())  # rows that share an id are two texts
    return bpe.decode_lists(_ids(numbered, "row", "doc_id"), vocabulary, "row", "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


@query("token_stream_stats", "documents", sql=f"SELECT doc_id, (sum(len(ids)) OVER (ORDER BY doc_id) - len(ids))::BIGINT AS start, len(ids)::BIGINT AS n FROM ({_STREAM})")
def token_stream_stats(docs):
    return tokens.token_stream(_with_end(tokens.in_order(docs.select("doc_id", "text"))), ordered=True).select("doc_id", "start", F.size("ids").cast("long").alias("n"))


@query("total_tokens", "documents", sql=f"SELECT count(*)::BIGINT AS n_docs, sum(len(ids))::BIGINT AS n_tokens FROM ({_STREAM})")
def total_tokens(docs):
    return _with_end(docs).agg(F.count("*").alias("n_docs"), F.sum(F.size("ids")).cast("long").alias("n_tokens"))


@query("packed_sequences", "documents", sql=f"""
WITH t AS (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, token FROM (SELECT doc_id, unnest(ids) AS token, generate_subscripts(ids, 1) AS i FROM ({_STREAM}))),
s AS (SELECT pos // 256 AS sequence_id, list(token ORDER BY pos) AS x FROM t GROUP BY 1),
w AS (SELECT a.sequence_id, a.x, list_concat(a.x[2:], [b.x[1]]) AS y FROM s a JOIN s b ON b.sequence_id = a.sequence_id + 1)
SELECT sequence_id::BIGINT AS sequence_id, md5(array_to_string(x, ' ')) AS input_md5, md5(array_to_string(y, ' ')) AS label_md5 FROM w WHERE len(x) = 256""")
def packed_sequences(docs):
    packed = tokens.packed_sequences(tokens.token_stream(_with_end(tokens.in_order(docs.select("doc_id", "text"))), ordered=True), 256)
    return packed.select("sequence_id", F.md5(_joined("input_ids")).alias("input_md5"), F.md5(_joined("labels")).alias("label_md5"))


@query("context_windows", "documents", sql=f"""
WITH s AS (SELECT doc_id, ids, (('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT % (len(ids) - 32))::INTEGER AS k FROM ({_STREAM}) WHERE len(ids) > 32)
SELECT doc_id, k AS start, array_to_string(ids[k + 1:k + 32], ' ') AS x, array_to_string(ids[k + 2:k + 33], ' ') AS y FROM s""")
def context_windows(docs):
    rows = _with_end(docs).where(F.size("ids") > 32).withColumn("start", tokens.random_start(F.col("doc_id"), F.size("ids"), 32))
    w = tokens.context_windows(F.col("ids"), F.col("start"), 32)
    return rows.select("doc_id", "start", _joined(w["x"]).alias("x"), _joined(w["y"]).alias("y"))


@query("prompt_and_output", "conversations", sql=f"""
WITH i AS (SELECT c.conv_id, c.turn, c.role, x.ids FROM conversations c JOIN ({_ids_sql("conversations", "conv_id", "turn")}) x USING (conv_id, turn)),
r AS (SELECT a.conv_id, a.turn, a.ids AS p, b.ids AS o FROM i a JOIN i b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
b AS (SELECT *, (max(len(p) + len(o)) OVER (PARTITION BY conv_id))::INTEGER AS n FROM r),
y AS (SELECT *, list_resize(list_concat(p, o), n, {END}) AS x FROM b)
SELECT conv_id, turn, n - 1 AS width, md5(array_to_string(x[1:n - 1], ' ')) AS input_md5, md5(array_to_string(x[2:n], ' ')) AS label_md5,
 md5(array_to_string(list_transform(range(n - 1), lambda i: CASE WHEN i >= len(p) - 1 AND i < len(p) + len(o) - 1 THEN 1 ELSE 0 END), ' ')) AS mask_md5 FROM y""")
def prompt_and_output(conversations):
    ids = _ids(conversations, "conv_id", "turn", "role")
    prompts = ids.where("role = 'user'").select("conv_id", "turn", F.col("ids").alias("p"))
    outputs = ids.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ids").alias("o"))
    width = F.max(F.size("p") + F.size("o")).over(Window.partitionBy("conv_id"))
    rows = prompts.join(outputs, ["conv_id", "turn"]).withColumn("n", width).where("n > 1")
    x = tokens.prompt_and_output(F.col("p"), F.col("o"), F.col("n"), END)
    digest = lambda c: F.md5(_joined(x[c]))
    return rows.select("conv_id", "turn", (F.col("n") - 1).alias("width"), digest("input_ids").alias("input_md5"), digest("labels").alias("label_md5"), digest("response_mask").alias("mask_md5"))


@query("compression_ratio", "documents", sql=f"""SELECT count(*)::BIGINT AS n_docs, sum(octet_length(encode(text)))::BIGINT AS n_bytes, sum(len(ids))::BIGINT AS n_tokens,
 round(sum(octet_length(encode(text))) / sum(len(ids))::DOUBLE, 6) AS ratio FROM documents JOIN ({_IDS}) USING (doc_id)""")
def compression_ratio(docs):
    return tokens.compression(_ids(docs, "text")).withColumn("ratio", F.round("ratio", 6))


@query("vocabulary_files", "documents", sql=f"SELECT doc_id, len(ids)::BIGINT AS n_ids, md5(array_to_string(ids, ' ')) AS ids_md5 FROM ({_IDS})")
def vocabulary_files(docs):
    """Ids of the texts by the vocabulary as it comes back from files of either form."""
    spark, v = docs.sparkSession, _vocabulary()
    for latin in (False, True):
        path = f"{shared_folder(spark)}/vocabulary-{uuid.uuid4().hex}"
        bpe.write_vocabulary(spark, v, path, latin)
        v = bpe.read_vocabulary(spark, path, (END_MARK,), latin)
    if tuple(v.merges) != MERGES:
        raise ValueError("merges changed on their way")
    return docs.select("doc_id", bpe.encode_udf(spark, v)("text").alias("ids")).select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.md5(_joined("ids")).alias("ids_md5"))


@query("embedding_lookup", "documents", "embeddings", sql="""SELECT d.doc_id, round(list_sum(list_transform(e.embedding, lambda v, i: v::DOUBLE * i)), 6) AS weighted
 FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings)""")
def embedding_lookup(docs, embeddings):
    """Each document's id as a token of the table, all of which can come up."""
    size = embeddings.count()
    rows = bpe.embed(docs.select("doc_id", (F.col("doc_id") % size).alias("vec_id")), embeddings, "vec_id")
    weighted = F.aggregate(F.transform("embedding", lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return rows.select("doc_id", F.round(weighted, 6).alias("weighted"))


@query("longest_token", "documents", sql=f"SELECT pretoken, length(pretoken)::BIGINT AS n_chars, octet_length(encode(pretoken))::BIGINT AS n_bytes FROM (SELECT DISTINCT pretoken FROM ({_PRE})) ORDER BY 3 DESC, 1 LIMIT 1")
def longest_token(docs):
    x = bpe.pretoken_counts(docs).agg(F.min(F.struct((-F.octet_length("pretoken")).alias("k"), "pretoken")).alias("x")).select("x.pretoken")
    return x.select("pretoken", F.length("pretoken").cast("long").alias("n_chars"), F.octet_length("pretoken").cast("long").alias("n_bytes"))


@query("vocab_jaccard", "documents", sql=f"""
WITH a AS (SELECT DISTINCT pretoken FROM ({_PRE}) WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT pretoken FROM ({_PRE}) WHERE doc_id % 2 = 1),
i AS (SELECT * FROM a INTERSECT SELECT * FROM b), u AS (SELECT * FROM a UNION SELECT * FROM b)
SELECT (SELECT count(*) FROM a)::BIGINT AS n_a, (SELECT count(*) FROM b)::BIGINT AS n_b, (SELECT count(*) FROM i)::BIGINT AS n_both, (SELECT count(*) FROM u)::BIGINT AS n_either""")
def vocab_jaccard(docs):
    side = F.col("doc_id") % 2
    seen = docs.select(side.alias("s"), F.explode(pretokens(F.col("text"))).alias("pretoken")).groupBy("pretoken").agg(F.max((F.col("s") == 0).cast("long")).alias("a"), F.max((F.col("s") == 1).cast("long")).alias("b"))
    return seen.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * F.col("b")).alias("n_both"), F.count("*").alias("n_either"))


@query("bpe_compression", "documents")
def bpe_compression(docs):
    """Of a vocabulary learnt from the documents themselves."""
    v = bpe.train_bpe(docs, 400, (END_MARK,))
    return tokens.compression(docs.select("text", bpe.encode_udf(docs.sparkSession, v)("text").alias("ids"))).withColumn("ratio", F.round("ratio", 6))


@query("vocab_overlap", "documents")
def vocab_overlap(docs):
    even, odd = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    return bpe.vocabulary_overlap(docs.sparkSession, bpe.train_bpe(even, 350), bpe.train_bpe(odd, 350), drop_bytes=True)
