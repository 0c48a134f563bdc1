"""Phrase collocations: counts from suffix automata of shards, scores and subsumption from their global sums.

1. A shard is a few megabytes of texts. Its generalised suffix automaton, cut off at a depth, is built by splitting
   classes of end positions: words that end alike, then pairs, then longer phrases. A class that has as many ends as
   its suffix is the same state, so a state is a range of lengths over one set of ends, and its suffix link leads to the
   state of the next shorter range. Its count is the number of its ends.
2. Each state is enumerated: one row for each of its lengths, with the count. Words and pairs come first; Spark
   adds them up. A longer phrase can't be frequent if a pair in it isn't, so a second pass cuts the texts between
   infrequent pairs before it builds its automata. If the frequent pairs are too many to be sent to every task, nothing
   is cut, and the same counts come from more rows.
3. Cuts of a phrase look up the counts of their two sides; every side of a frequent phrase is frequent itself.
4. A phrase passes its count down the suffix links and from its heads down theirs; whatever lies inside learns the
   count of the most frequent longer phrase around it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import as_bytes
from quillmill.session import cut_lineage

MOST_WORDS = 3
LEAST_COUNT = 10
#: A phrase goes if a longer one has this many hundredths of its count.
INSIDE_PERCENT = 50
TOP = 2000
#: Bytes of text in a shard.
SHARD_BYTES = 4 << 20
#: Frequent pairs that are sent to every task, 8 bytes each.
MOST_PAIRS = 4_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_BLANK = _BREAK.copy()
_BLANK[[32, 9]] = True


class PhraseAutomaton:
    """Suffix automaton of depth ``depth`` over word sequences: ``ids`` of words, ``piece`` tells the sequences apart.

    ``levels[d - 1]`` is, for each position, the class of the d words that end there (-1 if there are fewer);
    per class: ``count`` of ends, ``link`` to the class of its longest proper suffix, one ``end``.
    """

    def __init__(self, ids: np.ndarray, piece: np.ndarray, depth: int) -> None:
        self.ids = ids
        begins = np.flatnonzero(np.diff(piece, prepend=-1))
        inside = np.arange(len(ids), dtype=np.int32) - np.repeat(begins, np.diff(np.append(begins, len(ids)))).astype(np.int32)  # words before it in its piece
        self.count, self.link, self.end = [], [], []
        level = ids.astype(np.int32)
        for d in range(depth):
            if d:
                at = np.flatnonzero(inside >= d)
                key = level[at].astype(np.int64) << 32 | ids[at - d]
            else:
                at, key = np.arange(len(ids)), level
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(at) else np.empty(0, np.int64)
            self.count.append(np.diff(np.append(first, len(at))))
            self.end.append(at[order[first]])
            self.link.append(level[self.end[-1]])
            below = np.full(len(ids), -1, np.int32)
            below[at[order]] = np.repeat(np.arange(len(first), dtype=np.int32), self.count[-1])
            level = below
            del at, key, order, ordered

    def states(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Longest length, shortest length, count and an end of each state, by longest length."""
        deepest = len(self.count)
        shortest = [np.full(len(c), d + 1) for d, c in enumerate(self.count)]
        absorbed = [np.zeros(len(c), bool) for c in self.count]
        for d in range(1, deepest):  # a class with its suffix's ends takes over the lengths of that state
            same = self.count[d] == self.count[d - 1][self.link[d]]
            shortest[d][same] = shortest[d - 1][self.link[d][same]]
            absorbed[d - 1][self.link[d][same]] = True
        for d in range(deepest):
            own = ~absorbed[d]
            yield np.full(int(own.sum()), d + 1), shortest[d][own], self.count[d][own], self.end[d][own]

    def substrings(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Ends and counts of the distinct phrases of that length."""
        found = [(end[at], count[at]) for longest, shortest, count, end in self.states() for at in [(shortest <= length) & (length <= longest)]]
        return np.concatenate([e for e, _ in found]), np.concatenate([c for _, c in found])


def _words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The shard's distinct words, each word's number among them and the piece it is in."""
    data = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    blank = _BLANK[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~blank])]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), np.searchsorted(np.flatnonzero(_BREAK[data]), starts).astype(np.int32)


def _phrase(names: pa.Array, ids: np.ndarray, ends: np.ndarray, length: int) -> pa.Array:
    parts = [names.take(pa.array(ids[ends - back])) for back in range(length - 1, -1, -1)]
    return pc.binary_join_element_wise(*parts, b" ") if length > 1 else parts[0]


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = left * np.uint64(0x9E3779B97F4A7C15) ^ (right + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return h ^ h >> np.uint64(29)


def _name_hashes(names: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same in every task."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names.to_pylist()), np.uint64, len(names))


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language at a time, up to the limit; a text above it is a shard of its own."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text")), strict=True):
            if size and size + len(text) > limit:
                yield from held.items()
                held, size = {}, 0
            held.setdefault(lang, []).append(text)
            size += len(text) + 1
    yield from held.items()


def _counted(batches: Iterator[pa.RecordBatch], limit: int, lengths: tuple[int, int], frequent: dict[str, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """Phrases of the lengths with their counts in a shard. ``frequent``: sorted hashes of the pairs not to be cut between."""
    for lang, texts in _shards(batches, limit):
        names, ids, piece = _words(texts)
        if not len(ids):
            continue
        if frequent is not None:
            hashes = _name_hashes(names)[ids]
            pairs, known = pair_hashes(hashes[:-1], hashes[1:]), frequent.get(lang, np.empty(0, np.uint64))
            at = np.searchsorted(known, pairs)
            stays = (known[np.minimum(at, max(len(known) - 1, 0))] == pairs if len(known) else np.zeros(len(pairs), bool)) & (piece[1:] == piece[:-1])
            piece = np.concatenate([[0], np.cumsum(~stays)]).astype(np.int32)
        automaton = PhraseAutomaton(ids, piece, lengths[1])
        for length in range(lengths[0], lengths[1] + 1):
            ends, count = automaton.substrings(length)
            for at in range(0, len(ends), 1 << 18):
                phrase = _phrase(names, ids, ends[at : at + (1 << 18)], length).cast(pa.string())
                n = len(phrase)
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(n, np.int32))), pa.array(np.full(n, length, np.int32)), phrase, pa.array(count[at : at + (1 << 18)].astype(np.int64))], ["lang", "length", "phrase", "n"])


_ROWS = "lang string, length int, phrase string, n long"


def _pair_table(pairs: DataFrame, most: int) -> dict[str, np.ndarray] | None:
    """Hashes of the frequent pairs by language, if there are at most so many."""
    if pairs.limit(most + 1).count() > most:
        return None

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves = [_name_hashes(pa.array([p.split(" ")[i].encode() for p in batch.column("phrase").to_pylist()], pa.binary())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(pair_hashes(*halves).view(np.int64))], ["lang", "h"])

    table = pairs.select("lang", "phrase").mapInArrow(hashed, "lang string, h long").toArrow()
    langs, h = table.column("lang").to_numpy(), table.column("h").to_numpy().view(np.uint64)
    return {lang: np.sort(h[langs == lang]) for lang in set(langs.tolist())}


def phrase_counts(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT, most_pairs: int = MOST_PAIRS, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """``lang, length, phrase, f`` of every word, and of all phrases of 2 to ``most_words`` words that occur ``least`` times.

    A null lang is ``und``, a null text is empty; a text has no part in another's phrases.
    """
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = own.mapInArrow(lambda it: _counted(it, shard_bytes, (1, 2), None), _ROWS)
    short = rows.groupBy("lang", "length", "phrase").agg(F.sum("n").alias("f"))
    short = cut_lineage(short.where(f"length = 1 or f >= {int(least)}"))
    words, pairs = short.where("length = 1"), short.where("length = 2")
    if most_words < 3:
        return words, pairs
    known = _pair_table(pairs, most_pairs)
    sent = None if known is None else docs.sparkSession.sparkContext.broadcast(known)
    rows = own.mapInArrow(lambda it: _counted(it, shard_bytes, (3, most_words), None if sent is None else sent.value), _ROWS)
    long = rows.groupBy("lang", "length", "phrase").agg(F.sum("n").alias("f")).where(f"f >= {int(least)}")
    return words, cut_lineage(pairs.unionByName(long))


def mine_phrases(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT, top: int = TOP, inside_percent: int = INSIDE_PERCENT, most_pairs: int = MOST_PAIRS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Each language's best phrases: ``lang, rank, phrase, a, l, r, n, score``.

    A-Z are lower-cased, texts fall into pieces at ``[.,;:!?]`` and line ends and those into words at blanks and tabs.
    ``a`` is the phrase's count; its lowest-scoring cut (of equals the first) gives ``l``, ``r`` and the score; ``n`` is the
    number of the language's words. Ties in the order are settled by count, then by phrase. A null lang is ``und``, null and
    empty texts have no words, repeated rows count each time, very long texts are read whole; an empty table gives no rows;
    other columns are not looked at.
    """
    if most_words < 2 or least < 1:
        raise ValueError("most_words has to be 2 at least and least 1")
    words, phrases = phrase_counts(docs, most_words, least, most_pairs, shard_bytes)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    parts = words.where(f"f >= {int(least)}").select("lang", "phrase", "f")
    if most_words > 2:
        parts = parts.unionByName(phrases.where(f"length < {int(most_words)}").select("lang", "phrase", "f"))

    cuts = phrases.select("lang", "length", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cuts = cuts.select("lang", "length", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("first"), F.expr("array_join(slice(w, k + 1, length - k), ' ')").alias("rest"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = [f"cast({c} as decimal(19, 0))" for c in ("a", "l", "r")]
    score = F.expr(f"(1000000 * {wide[0]} * {wide[0]}) div ({wide[1]} * {wide[2]})")
    best = cuts.groupBy("lang", "length", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    # a longer phrase's suffixes are reached by its suffix links, what else lies inside by the links of its heads
    inside = phrases.where("length > 2").select("lang", F.col("f").alias("longer"), F.split("phrase", " ").alias("w"), "length")
    inside = inside.select("lang", "longer", "w", "length", F.explode(F.expr("sequence(2, length)")).alias("head"))
    inside = inside.select("lang", "longer", "w", "length", "head", F.explode(F.expr("sequence(0, head - 2)")).alias("link")).where("head - link < length")
    inside = inside.groupBy("lang", F.expr("array_join(slice(w, link + 1, head - link), ' ')").alias("phrase")).agg(F.max("longer").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(f"longer is null or cast(100 as decimal(20, 0)) * longer < cast({int(inside_percent)} as decimal(20, 0)) * a")

    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(f"rank <= {int(top)}")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))


#: The same by counting every phrase.
PHRASES_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, len AS m, unnest(list_transform(range(1, len(w) - len + 2), lambda i: array_to_string(w[i:i + len - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) AS v(len) WHERE len(w) >= len),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM t GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
h AS (SELECT lang, phrase, w, m, f AS a, unnest(range(1, m)) AS k FROM c),
x AS MATERIALIZED (SELECT *, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest FROM h),
y AS MATERIALIZED (SELECT x.*, f.f AS l FROM x JOIN f ON f.lang = x.lang AND f.phrase = x.first),
k AS MATERIALIZED (SELECT y.*, f.f AS r, (1000000::HUGEINT * y.a * y.a) // (y.l::HUGEINT * f.f) AS score FROM y JOIN f ON f.lang = y.lang AND f.phrase = y.rest),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(w[s:s + 1], ' ') AS phrase, max(f) AS longer FROM c, (VALUES (1), (2)) AS v(s) WHERE m = 3 GROUP BY ALL),
g AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase AND b.m = 2 WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM g JOIN n USING (lang) WHERE rank <= 2000
"""
