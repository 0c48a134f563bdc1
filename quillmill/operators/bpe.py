"""Byte-level BPE: pre-token counting in Spark, a vocabulary-sized merge loop, encode and decode."""

from __future__ import annotations

import ast
import heapq
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions.text import PRETOKEN, let, pretokens
from quillmill.session import cut_lineage


def split_on_specials(text: Column, specials: tuple[str, ...]) -> Column:
    """Pieces between special tokens, which are dropped."""
    return F.split(text, "|".join(re.escape(s) for s in specials)) if specials else F.array(text)


def pretoken_counts(docs: DataFrame, specials: tuple[str, ...] = ()) -> DataFrame:
    """``pretoken, n`` over all documents."""
    pieces = docs.select(F.explode(split_on_specials(F.col("text"), specials)).alias("piece"))
    return pieces.select(F.explode(pretokens(F.col("piece"))).alias("pretoken")).groupBy("pretoken").agg(F.count("*").alias("n"))


def byte_pairs(counts: DataFrame) -> DataFrame:
    """``pair, n``: adjacent byte pairs (hex) weighted by pre-token counts."""
    digits = F.hex(F.encode("pretoken", "UTF-8"))
    pairs = lambda h: F.transform(F.sequence(F.lit(0), (F.length(h) / 2 - 2).cast("int")), lambda i: F.substring(h, i * 2 + 1, 4))
    long_enough = counts.where(F.octet_length("pretoken") >= 2)
    return long_enough.select("n", F.explode(let(digits, pairs)).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """tokens by id, merges by rank, special tokens."""

    tokens: dict[int, bytes]
    merges: list[tuple[bytes, bytes]]
    specials: tuple[str, ...] = ()
    ids: dict[bytes, int] = field(init=False)

    def __post_init__(self) -> None:
        for s in self.specials:
            if s.encode() not in set(self.tokens.values()):
                self.tokens[len(self.tokens)] = s.encode()
        self.ids = {t: i for i, t in self.tokens.items()}
        if missing := [b for b in range(256) if bytes([b]) not in self.ids]:
            raise ValueError(f"{len(missing)} single bytes have no token")


class MergeLoop:
    """Repeated merging of the most frequent pair, ties to the larger bytes, with incremental counts."""

    def __init__(self, counts: dict[str, int]):
        self.words = [list(w.encode()) for w in counts]
        self.weight = list(counts.values())
        self.tokens = {b: bytes([b]) for b in range(256)}
        self.stats: Counter = Counter()
        self.where: dict[tuple[int, int], set[int]] = defaultdict(set)
        for i, word in enumerate(self.words):
            self._count(i, word, 1)
        self.heap = [self._entry(p) for p in self.stats]
        heapq.heapify(self.heap)

    def add(self, more: dict[tuple[int, int], int]) -> None:
        """Counts from elsewhere on top of those of the words."""
        for pair, n in more.items():
            if n:
                self.stats[pair] += n
                heapq.heappush(self.heap, self._entry(pair))

    def best(self) -> tuple[int, int] | None:
        """The pair that the next step merges."""
        while self.heap:
            total, *_, pair = self.heap[0]
            if self.stats.get(pair, 0) == -total and total < 0:
                return pair
            heapq.heappop(self.heap)
        return None

    def _count(self, i: int, word: list[int], sign: int) -> None:
        for pair in zip(word, word[1:]):
            self.stats[pair] += sign * self.weight[i]
            if sign > 0:
                self.where[pair].add(i)

    def _entry(self, pair: tuple[int, int]):
        return (-self.stats[pair], _Descending(self.tokens[pair[0]]), _Descending(self.tokens[pair[1]]), pair)

    def step(self) -> tuple[bytes, bytes] | None:
        if (pair := self.best()) is None:
            return None
        left, right = pair
        new = len(self.tokens)
        self.tokens[new] = self.tokens[left] + self.tokens[right]
        changed: set[tuple[int, int]] = set()
        for i in self.where.pop(pair, ()):
            word = self.words[i]
            out: list[int] = []
            for t in word:
                if out and t == right and out[-1] == left:
                    out[-1] = new
                else:
                    out.append(t)
            if left == right:  # left to right, without overlaps
                out = _merge(word, left, right, new)
            if len(out) == len(word):
                continue
            self._count(i, word, -1)
            self._count(i, out, 1)
            changed |= set(zip(word, word[1:])) | set(zip(out, out[1:]))
            self.words[i] = out
        self.stats.pop(pair, None)
        for p in changed - {pair}:
            if self.stats[p] > 0:
                heapq.heappush(self.heap, self._entry(p))
        return self.tokens[left], self.tokens[right]


class _Descending(bytes):
    """Bytes that sort the other way round."""

    def __lt__(self, other):
        return bytes.__gt__(self, other)

    def __gt__(self, other):
        return bytes.__lt__(self, other)


def _merge(word: list[int], left: int, right: int, new: int) -> list[int]:
    out, i = [], 0
    while i < len(word):
        if i + 1 < len(word) and word[i] == left and word[i + 1] == right:
            out.append(new)
            i += 2
        else:
            out.append(word[i])
            i += 1
    return out


def _merge_all(flat: np.ndarray, word: np.ndarray, merges: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of many words, one after the other, and the word of each, after ``left, right, new`` one by one."""
    for left, right, new in merges:
        hit = np.flatnonzero((flat[:-1] == left) & (flat[1:] == right) & (word[:-1] == word[1:]))
        if not len(hit):
            continue
        if left == right:  # left to right, without overlaps: every other one of a run
            first = np.concatenate([[True], np.diff(hit) != 1])
            begin = hit[first][np.cumsum(first) - 1]
            hit = hit[(hit - begin) % 2 == 0]
        flat[hit] = new
        stays = np.ones(len(flat), bool)
        stays[hit + 1] = False
        flat, word = flat[stays], word[stays]
    return flat, word


class _Tail:
    """The rarer words, which stay in Spark: symbols of each as bytes, and its count.

    ``counts`` has their pairs as of the last look, which is at most ``size`` squared numbers. A merge of a pair that no rare word has leaves
    them right. After another one the pairs beside it are only bounded from above (``loose``), until the next look.
    """

    #: Merges after which the words are written down anew.
    KEPT = 16

    def __init__(self, words: DataFrame) -> None:
        self.words = words
        self.pending: list[tuple[int, int, int]] = []
        self.loose: set[tuple[int, int]] = set()
        self.counts: dict[tuple[int, int], int] = {}

    def merged(self, pair: tuple[int, int], new: int) -> dict[tuple[int, int], int]:
        """Notes a merge; returns bounds of the pairs that it makes."""
        left, right = pair
        self.pending.append((left, right, new))
        times = self.counts.pop(pair, 0)
        self.loose.discard(pair)
        made: dict[tuple[int, int], int] = {}
        if not times:
            return made
        most = lambda p, n: made.__setitem__(p, max(made.get(p, 0), min(times, n)))
        for (a, b), n in self.counts.items():
            if b == left:
                most((a, new), n)
                self.loose.add((a, b))
            if a == right:
                most((new, b), n)
                self.loose.add((a, b))
            if (a, b) == (right, left):
                most((new, new), n)
        if left == right:
            for p in ((new, left), (new, new)):
                made[p] = times
        self.counts |= made
        self.loose |= set(made)
        return made

    def look(self) -> dict[tuple[int, int], int]:
        """The pairs as they are; returns by how much they differ from what was known."""
        merges = list(self.pending)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 50_000):
                    part = batch.slice(at, 50_000)
                    symbols = [np.frombuffer(x, "<i4") for x in part.column("symbols").to_pylist()]
                    word = np.repeat(np.arange(len(symbols)), [len(x) for x in symbols])
                    yield part, *_merge_all(np.concatenate(symbols), word, merges)

        if len(merges) >= self.KEPT:
            def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for part, flat, word in read(batches):
                    ends = np.cumsum(np.bincount(word, minlength=part.num_rows))
                    data = [flat[a:b].astype("<i4").tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), part.column("n")], ["symbols", "n"])

            self.words, self.pending = cut_lineage(self.words.mapInArrow(written, "symbols binary, n long")), []
            merges = []

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, flat, word in read(batches):
                inside = np.flatnonzero(word[:-1] == word[1:])
                pairs, at = np.unique(flat[inside].astype(np.int64) << 32 | flat[inside + 1], return_inverse=True)
                n = np.zeros(len(pairs), np.int64)
                np.add.at(n, at, part.column("n").to_numpy()[word[inside]])
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

        found = self.words.mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
        now = {(p >> 32, p & 0xFFFFFFFF): n for p, n in zip(found.column("pair").to_pylist(), found.column("n").to_pylist(), strict=True)}
        change = {p: now.get(p, 0) - self.counts.get(p, 0) for p in now.keys() | self.counts.keys()}
        self.counts, self.loose = now, set()
        return change


#: Distinct pre-tokens that the merge loop holds on the driver, the most frequent ones.
MOST_WORDS = 100_000


def _head_and_tail(counts: DataFrame, most: int) -> tuple[dict[str, int], DataFrame | None]:
    """The most frequent words, some ``most`` of them, and the others as symbols."""
    if counts.count() <= most:
        head, rest = counts, None
    else:
        n, above, least = 0, None, None
        for row in counts.groupBy(F.floor(F.log2("n") * 8).alias("size")).agg(F.count("*").alias("k"), F.min("n").alias("least")).orderBy(F.desc("size")).collect():  # a few hundred rows
            n += row["k"]
            if n > most:
                above = least
                break
            least = row["least"]
        few = F.lit(False) if above is None else F.col("n") >= above
        head, rest = counts.where(few), counts.where(~few)
    table = head.toArrow()
    words = dict(zip(table.column("pretoken").to_pylist(), table.column("n").to_pylist(), strict=True))
    if rest is None:
        return words, None

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.frombuffer(w.encode(), np.uint8).astype("<i4").tobytes() for w in batch.column("pretoken").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), batch.column("n")], ["symbols", "n"])

    return words, cut_lineage(rest.where("pretoken != ''").mapInArrow(symbols, "symbols binary, n long"))


def train_bpe(docs: DataFrame, vocab_size: int, specials: tuple[str, ...] = (), most_words: int = MOST_WORDS) -> Vocabulary:
    """Learn ``vocab_size - 256 - len(specials)`` merges; specials get the last ids.

    The corpus is reduced to distinct pre-tokens with counts in Spark. The loop, sequential by nature, works on the driver on the
    ``most_words`` most frequent ones; the others stay in Spark, which counts their pairs anew when a merge depends on what isn't known of
    them. So the driver's memory doesn't follow the number of distinct words, and the merges are those of all. Ties between pairs go by
    their bytes, so the order in which words come in doesn't matter.
    """
    words, rest = _head_and_tail(cut_lineage(pretoken_counts(docs, specials)), most_words)
    loop, tail = MergeLoop(words), None if rest is None else _Tail(rest)
    if tail:
        loop.add(tail.look())
    merges = []
    for _ in range(max(0, vocab_size - 256 - len(specials))):
        pair = loop.best()
        while tail and pair in tail.loose:  # of all upper bounds the largest, but itself not known
            loop.add(tail.look())
            pair = loop.best()
        if pair is None:
            break
        new = len(loop.tokens)
        merges.append(loop.step())
        if tail:
            loop.add(tail.merged(pair, new))
    return Vocabulary(dict(loop.tokens), merges, specials)


class Codec:
    """Encoder and decoder of a vocabulary, with a cache of pre-tokens and their ids as bytes."""

    #: Characters of a pre-token that is cached.
    LONGEST = 64

    def __init__(self, vocabulary: Vocabulary, cached: int = 400_000):
        import regex

        self.v = vocabulary
        self.rank = {p: i for i, p in enumerate(vocabulary.merges)}
        self.pattern = regex.compile(PRETOKEN)
        ordered = sorted(vocabulary.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, ordered)) + ")") if ordered else None
        self.cache: dict[str, bytes] = {}
        self.cached = cached  # bounds memory, not results

    def _word(self, word: str) -> bytes:
        """Merges in order of rank until none applies."""
        parts = [bytes([b]) for b in word.encode()]
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(parts, parts[1:])]
            low = min(ranks)
            if low == 1 << 60:
                break
            left, right = self.v.merges[low]
            merged, i = [], 0
            while i < len(parts):
                if i < len(ranks) and ranks[i] == low:
                    merged.append(left + right)
                    i += 2
                else:
                    merged.append(parts[i])
                    i += 1
            parts = merged
        got = np.array([self.v.ids[p] for p in parts], "<i4").tobytes()
        if len(word) <= self.LONGEST:
            if len(self.cache) >= self.cached:
                self.cache.clear()
            self.cache[word] = got
        return got

    def _plain(self, text: str) -> bytes:
        cache = self.cache
        return b"".join([cache.get(w) or self._word(w) for w in self.pattern.findall(text)])

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers; special tokens, the longest first, stay whole."""
        if not self.special:
            return self._plain(text)
        pieces = self.special.split(text)
        return b"".join([self.v.ids[p.encode()].to_bytes(4, "little") if i % 2 else self._plain(p) for i, p in enumerate(pieces)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    def encode_iterable(self, texts):
        """Ids one by one; nothing merges across items."""
        for text in texts:
            yield from self.encode(text)

    def decode(self, ids) -> str:
        """Unknown ids are skipped, broken UTF-8 is replaced."""
        return b"".join(self.v.tokens.get(int(i), b"") for i in ids).decode("utf-8", "replace")


#: Bytes of texts, or of ids, that are unpacked at a time.
SLICE_BYTES = 1 << 20


def _pieces(column: pa.Array) -> Iterator[pa.Array]:
    step = max(1, len(column) * SLICE_BYTES // max(1, column.nbytes))
    for at in range(0, len(column), step):
        yield column.slice(at, step)


def encode_udf(spark: SparkSession, vocabulary: Vocabulary):
    """A vectorised column function text -> ids, on Arrow arrays. Ids go on piece by piece, so a worker never holds those of a whole batch."""
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(shared.value)
        for whole in texts:
            for text in _pieces(whole):
                ids = [None if t is None else codec.encode_bytes(t) for t in text.to_pylist()]
                ends = np.cumsum([0, *(len(x or b"") // 4 for x in ids)])
                mask = pa.array([x is None for x in ids], pa.bool_())
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(x or b"" for x in ids), "<i4")), mask=mask)

    return encode


def decode_udf(spark: SparkSession, vocabulary: Vocabulary):
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf(T.StringType())
    def decode(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(shared.value, 0)
        for whole in lists:
            for ids in _pieces(whole):
                yield pa.array([None if x is None else codec.decode(x) for x in ids.to_pylist()], pa.string())

    return decode


def _token_runs(joined: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``keys, pos, data``: the bytes of tokens that stand next to one another in a batch as well as in their text, a row each such run."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            *key, pos, token = batch.columns
            goes_on = np.diff(pos.to_numpy(zero_copy_only=False)) == 1
            for k in key:  # nulls begin a run
                goes_on &= pc.equal(k[1:], k[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], ~goes_on]))
            ends = np.frombuffer(token.buffers()[1], "<i4")[token.offset :][[*first, n]]
            data = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), token.buffers()[2]])
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(first)) for c in (*key, pos)), data], [*keys, "pos", "data"])

    kinds = [f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in (*keys, "pos")]
    return joined.select(*keys, "pos", "token").mapInArrow(runs, ", ".join([*kinds, "data binary"]))


def _put_together(joined: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``keys, text`` from ``keys, pos, token``."""
    sent = _token_runs(joined, keys).repartition(*keys)
    whole = sent.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("data").alias("h")))).alias("x"))
    return whole.select(*keys, F.decode(F.unhex(F.array_join(F.transform("x", lambda t: t["h"]), "")), "UTF-8").alias("text"))


def decode_rows(tokens: DataFrame, vocabulary: DataFrame, *keys: str) -> DataFrame:
    """``keys, text`` from ``keys, pos, token_id`` by a join with ``token_id, token``; unknown ids drop out. A place comes up once a key.

    Rows may come in any order. Those that come as they stand in their text, as exploded ids joined with a broadcast vocabulary do, are
    sent to their text's other rows in runs, so about the text is shuffled and not a row for each token.
    """
    return _put_together(tokens.join(vocabulary, "token_id"), keys or ("doc_id",))


#: Ids of a list that are looked up side by side.
PIECE = 8


def decode_lists(encoded: DataFrame, vocabulary: DataFrame, *keys: str) -> DataFrame:
    """``decode_rows`` of ``keys, ids``. A row is a piece of a list, joined with ``vocabulary`` once for each of its places, so there
    are fewer rows to put together. Ids are unknown or come up once in the vocabulary, a small table.
    """
    keys = keys or ("doc_id",)
    begins = F.sequence(F.lit(1), F.greatest(F.size("ids"), F.lit(1)), F.lit(PIECE))
    # outer: else a filter on ids is made up, for which they are encoded a second time
    rows = encoded.select(*keys, F.posexplode_outer(F.transform(begins, lambda at: F.slice("ids", at, PIECE))).alias("pos", "piece"))
    rows = rows.select(*keys, "pos", *(F.get("piece", F.lit(k)).alias(f"_id{k}") for k in range(PIECE)))
    for k in range(PIECE):
        known = F.broadcast(vocabulary.select(F.col("token_id").alias(f"_known{k}"), F.col("token").alias(f"_token{k}")))
        rows = rows.join(known, F.col(f"_id{k}") == F.col(f"_known{k}"), "left")
    rows = rows.where(F.coalesce(*(F.col(f"_known{k}") for k in range(PIECE))).isNotNull())
    return _put_together(rows.select(*keys, "pos", F.concat(*(F.coalesce(f"_token{k}", F.lit(b"")) for k in range(PIECE))).alias("token")), keys)


def printable_bytes() -> dict[int, str]:
    """Byte to printable character: visible Latin-1 as itself, the rest from U+0100 on, by rule."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def to_printable(token: bytes) -> str:
    table = printable_bytes()
    return "".join(table[b] for b in token)


def from_printable(token: str) -> bytes:
    table = {c: b for b, c in printable_bytes().items()}
    return bytes(table[c] for c in token)


def load_vocabulary(vocab_json: str, merges: str, specials: tuple[str, ...] = ()) -> Vocabulary:
    """From the printable form: a JSON map of token to id, and ``left right`` lines by rank."""
    tokens = {i: from_printable(t) for t, i in json.loads(vocab_json).items()}
    pairs = [tuple(map(from_printable, line.split(" "))) for line in merges.splitlines() if line.count(" ") == 1 and not line.startswith("#version")]
    return Vocabulary(tokens, pairs, specials)


def dump_vocabulary(v: Vocabulary) -> tuple[str, str]:
    """The same as text: (vocab JSON, merges lines)."""
    return json.dumps({to_printable(t): i for i, t in v.tokens.items()}, ensure_ascii=False), "\n".join(f"{to_printable(a)} {to_printable(b)}" for a, b in v.merges)


def load_latin_vocabulary(vocab_json: str, merges: str, specials: tuple[str, ...] = ()) -> Vocabulary:
    """From the Latin-1 form: a JSON map of id to token, a character a byte, and a line for each merge with two bytes literals."""
    tokens = {int(i): t.encode("latin-1") for i, t in json.loads(vocab_json).items()}
    literal = r"b'(?:[^'\\]|\\.)*'|b\"(?:[^\"\\]|\\.)*\""
    pairs = [tuple(map(ast.literal_eval, re.findall(literal, line))) for line in merges.splitlines() if line.strip()]
    return Vocabulary(tokens, pairs, specials)


def dump_latin_vocabulary(v: Vocabulary) -> tuple[str, str]:
    return json.dumps({i: t.decode("latin-1") for i, t in v.tokens.items()}), "\n".join(f"{a!r} {b!r}" for a, b in v.merges)


def write_vocabulary(spark: SparkSession, v: Vocabulary, path: str, latin: bool = False) -> None:
    """``vocab`` and ``merges`` below ``path``, in a folder that Spark's writers reach."""
    vocab, merges = dump_latin_vocabulary(v) if latin else dump_vocabulary(v)
    for name, text in (("vocab", vocab), ("merges", merges)):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def read_vocabulary(spark: SparkSession, path: str, specials: tuple[str, ...] = (), latin: bool = False) -> Vocabulary:
    """What ``write_vocabulary`` wrote, or files of that form; a vocabulary is of bounded size and lives on the driver."""
    whole = lambda name: "\n".join(r["value"] for r in spark.read.option("wholetext", "true").text(f"{path}/{name}").collect())
    return (load_latin_vocabulary if latin else load_vocabulary)(whole("vocab"), whole("merges"), specials)


def _overlap(spark: SparkSession, x: list[str], y: list[str]) -> tuple[int, int, int, int, float]:
    a, b = (spark.createDataFrame([(t,) for t in rows], "token string").distinct() for rows in (x, y))
    both, either = a.intersect(b).count(), a.union(b).distinct().count()
    return a.count(), b.count(), both, either, both / either if either else 1.0


def vocabulary_overlap(spark: SparkSession, a: Vocabulary, b: Vocabulary, drop_bytes: bool = False) -> DataFrame:
    """Sizes, intersection, union and Jaccard (1 for two empty sets) of tokens and of merges, a row each."""
    tokens = lambda v: [t.hex() for t in v.tokens.values() if not (drop_bytes and len(t) == 1)]
    merges = lambda v: [f"{left.hex()} {right.hex()}" for left, right in v.merges]
    rows = [(what, *_overlap(spark, of(a), of(b))) for what, of in (("tokens", tokens), ("merges", merges))]
    return spark.createDataFrame(rows, "what string, n_a long, n_b long, n_both long, n_either long, jaccard double")


def embed(tokens: DataFrame, table: DataFrame, token: str = "token_id", vector: str = "embedding") -> DataFrame:
    """Embedding lookup as a join: every row of ``tokens`` with the vector of its token; unknown tokens drop out."""
    return tokens.join(table.select(token, vector), token)
