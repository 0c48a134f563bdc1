"""Packing token pieces into training windows by non-negative least squares on the length histogram.

Documents are tokenised once and cut at multiples of the window; only each document's last piece
is shorter. Lengths are rounded up to ``GRAIN`` tokens, which gives a histogram of at most
``WINDOW / GRAIN`` bins. All combinations of up to ``DEPTH`` lengths that fill a window exactly are
enumerated, non-negative least squares finds how often each should repeat to use up the histogram,
the counts are rounded and clipped to what is there, and what is left goes greedily, longest first,
into windows of any depth. The plan depends on the histogram alone, so it is of fixed size whatever
the corpus; pieces find their places by their rank among the pieces of their bin.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import slices
from quillmill.session import cut_lineage

WINDOW = 4096
GRAIN = 16
DEPTH = 3
END_ID = 2
BUCKET_ROWS = 200_000
#: Words and pieces that a generation of a worker's cache holds; it bounds memory, not results.
CACHE_WORDS = 400_000

#: Latin-1 bytes whose words tokenise alike alone and in context: printable, or plain white space.
_PLAIN = bytes([9, 10, 11, 12, 13, *range(0x20, 0x7F), *range(0xA1, 0x100)])


#: The tokenizer's own split into pieces, over lower-cased plain Latin-1 (fixed values: its contractions and classes).
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\\s0-9²³¹¼½¾a-zªµºß-öø-ÿ]+")


#: Bytes that the tokenizer's byte alphabet shows as another character: those without a visible one, from U+0100 on, by rule.
_SHOWN = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if not (0x21 <= b < 0x7F or 0xA1 <= b < 0xAD or b >= 0xAE))}


class _Words(dict):
    """Ids of words as bytes; a word that isn't there is learnt when it is asked for."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.learn(word)
        return ids


class WordTokenizer:
    """Token ids as little-endian bytes, by way of caches of words and of their pieces.

    The tokenizer drops white space and never merges across it or across its own pieces, so
    plain Latin-1 text is looked up word by word; a piece not seen before goes to the tokenizer's model alone. Texts with
    anything else (other scripts, control characters, the marks of special tokens) go through the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words = _Words(self._word)  # a piece is a word, too
        self.old_words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if (known := self.old_words.get(word)) is not None:
            return known
        pieces = [word] if word.isalpha() else _PIECES.findall(word)
        if len(pieces) > 1:
            return b"".join([self.words[p] for p in pieces])
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(_SHOWN)
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > CACHE_WORDS:
            self.words, self.old_words = _Words(self._word), self.words
        look = self.words.__getitem__
        return [b"".join(map(look, t.lower().split())) if _is_plain(t) else self.whole(t) for t in texts]


def _is_plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, _PLAIN) and "<|" not in text
    except UnicodeEncodeError:
        return False


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker process."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def token_pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` of every piece; null texts are just the end id."""
    path = path or default_tokenizer_path()
    tail = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        for part in slices(batches):
            rows: list[list] = [[], [], [], [], []]
            texts = [t or "" for t in part.column("text").to_pylist()]
            for doc, ids in zip(part.column("doc_id").to_pylist(), words.encode_all(texts), strict=True):
                ids += tail
                total = len(ids) // 4
                for at in range(0, total, window):
                    length = min(window, total - at)
                    for column, value in zip(rows, (doc, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), total), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], _NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, ", ".join(f"{c} long" for c in _NAMES)
    )


def fillings(present: list[int], units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Combinations of up to ``depth`` present lengths that sum to exactly ``units``, longest first."""
    there = set(present)
    out: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) + 1 == depth:
            if left in there and (not head or left <= head[-1]):
                out.append((*head, left))
        elif len(head) < depth:
            for x in sorted(there, reverse=True):
                if x <= left and (not head or x <= head[-1]):
                    extend((*head, x), left - x)

    extend((), units)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Lawson-Hanson active-set solution of min |ax - b|, x >= 0."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, np.abs(a.T @ b).max(initial=0))
    for _ in range(rounds or 3 * a.shape[0] + 10):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        j = int(w.argmax())
        if w[j] <= tol:
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            own = a[:, at]
            z = np.linalg.solve(own.T @ own + 1e-10 * np.eye(len(at)), own.T @ b)
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            down = z <= 0
            step = (x[at][down] / np.maximum(x[at][down] - z[down], 1e-300)).min()
            x[at] += step * (z - x[at])
            drop = at[(x[at] <= 1e-12)]
            x[drop] = 0
            passive[drop] = False
            if not passive.any():
                break
    return x


def plan(histogram: dict[int, int], units: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (bins, longest first) with repeat counts that use up the histogram exactly."""
    left = {b: int(n) for b, n in histogram.items() if n}
    out: list[tuple[tuple[int, ...], int]] = []
    if left.get(units):
        out.append(((units,), left.pop(units)))
    present = sorted(left)
    combos = fillings(present, units, depth) if present else []
    if combos:
        row = {b: i for i, b in enumerate(present)}
        a = np.zeros((len(present), len(combos)))
        for j, combo in enumerate(combos):
            for b in combo:
                a[row[b], j] += 1
        # short lengths are easily packed later, so missing them weighs less
        weight = np.array([0.3 if b < units // 8 else 1.0 for b in present])
        x = nnls(a * weight[:, None], weight * np.array([left[b] for b in present], float))
        for j in sorted(np.flatnonzero(x > 0), key=lambda j: (-x[j], combos[j])):
            need = {b: combos[j].count(b) for b in combos[j]}
            times = min([int(round(x[j])), *(left[b] // m for b, m in need.items())])
            if times > 0:
                out.append((combos[j], times))
                for b, m in need.items():
                    left[b] -= m * times
    left = {b: n for b, n in left.items() if n}
    while left:
        space, pattern, used = units, [], {}
        for b in sorted(left, reverse=True):
            take = min(left[b], space // b)
            if take:
                pattern += [b] * take
                used[b] = take
                space -= b * take
        times = min(left[b] // m for b, m in used.items())
        out.append((tuple(pattern), times))
        for b, m in used.items():
            left[b] -= m * times
            if not left[b]:
                del left[b]
    return out


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length``.

    Offsets in a sequence are gapless from 0. Repeated rows are packed one by one, a null or empty text is
    one piece of the end id, a very long one as many whole windows as it fills and a rest; rows with a null doc_id are
    packed too. Pieces that tie in all columns are the same, so either may come first. An empty table gives no rows, and
    other columns are not looked at.
    """
    units = window // grain
    pieces = token_pieces(docs, path, window).withColumn("_bin", F.ceil(F.col("length") / grain).cast("int"))
    pieces = cut_lineage(pieces)
    histogram = {r["_bin"]: r["count"] for r in pieces.groupBy("_bin").count().collect()}
    buckets = max(16, -(-sum(histogram.values()) // bucket_rows))
    layout: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for pattern, times in plan(histogram, units, depth):
        for b in dict.fromkeys(pattern):
            layout.setdefault(b, []).append((pattern.count(b), times, sequence))
        sequence += times
    # per bin: first rank, slots in a sequence and first sequence of each stretch of ranks
    tables = {b: (np.cumsum([0, *(m * t for m, t, _ in x)])[:-1], np.array([m for m, _, _ in x]), np.array([s for _, _, s in x])) for b, x in layout.items()}

    salted = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    totals = salted.groupBy("_bin", "_b").count()
    past = Window.partitionBy("_bin").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bin", "_b", F.coalesce(F.sum("count").over(past), F.lit(0)).alias("_past"))
    own = Window.partitionBy("_bin", "_b").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = salted.join(offsets, ["_bin", "_b"]).withColumn("_rank", F.col("_past") + F.row_number().over(own) - 1)
    names = [*_NAMES, "_bin", "_rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, ranks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_bin", "_rank"))
            sequences, slots = np.zeros(len(bins), np.int64), np.zeros(len(bins), np.int64)
            for b in np.unique(bins):
                at = np.flatnonzero(bins == b)
                first, many, base = tables[int(b)]
                k = np.searchsorted(first, ranks[at], side="right") - 1
                inside = ranks[at] - first[k]
                sequences[at], slots[at] = base[k] + inside // many[k], inside % many[k]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*_NAMES, "_bin")], pa.array(sequences), pa.array(slots)], [*_NAMES, "_bin", "sequence_id", "_slot"])

    placed = ranked.select(*names).mapInArrow(place, ", ".join(f"{c} long" for c in _NAMES) + ", _bin int, sequence_id long, _slot long")
    inside = Window.partitionBy("sequence_id").orderBy(F.col("_bin").desc(), "_slot")
    upto = F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return placed.select(*_NAMES, "sequence_id", (upto - F.col("length")).alias("offset"), F.sum("length").over(Window.partitionBy("sequence_id")).alias("sequence_length"))
