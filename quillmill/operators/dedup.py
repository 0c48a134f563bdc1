"""Exact and fuzzy deduplication: lines, documents, MinHash with LSH, exact Jaccard, components."""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.grams import gram_lists
from quillmill.functions.text import line_hash, normalize_text, word_ngrams, words
from quillmill.operators.batches import slices
from quillmill.operators.graph import connected_components
from quillmill.operators.skew import join_keyed, small
from quillmill.session import cut_lineage

#: A prime under 2**31: products with 31-bit hashes fit a long.
PRIME = (1 << 31) - 1


def exploded_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, line``; a final newline makes no line."""
    return docs.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", r"\n$", ""), "\n")).alias("line_no", "line"))


def line_counts(docs: DataFrame) -> DataFrame:
    """``hash, n`` over all documents; partial counts keep a very common line from piling up."""
    return exploded_lines(docs).groupBy(line_hash(F.col("line")).alias("hash")).agg(F.count("*").alias("n"))


def unique_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, text, n_kept`` with every line that occurs more than once anywhere removed.

    A line travels once for each task that has it; documents stay even if nothing is left of them.
    """
    lines = exploded_lines(docs).withColumn("hash", line_hash(F.col("line")))
    single = lines.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line_no", "line")).alias("at")).where("n = 1").select("at.*")
    kept = single.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    return docs.select("doc_id").join(kept, "doc_id", "left").select(
        "doc_id",
        F.coalesce(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("")).alias("text"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_kept"),
    )


def exact_documents(docs: DataFrame) -> DataFrame:
    """The smallest doc_id of each distinct text, with the number of copies."""
    return docs.groupBy(F.md5("text").alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def document_grams(docs: DataFrame, n: int = 5) -> DataFrame:
    """``doc_id, grams``: distinct word n-grams of the normalised text, of documents that have any."""
    return docs.select("doc_id", word_ngrams(words(normalize_text(F.col("text"))), n).alias("grams")).where(F.size("grams") > 0)


def gram_hash(gram: Column) -> Column:
    """31 bits of the MD5, the same everywhere."""
    return F.conv(F.substring(F.md5(gram), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(PRIME))


#: Bytes of text that are hashed at a time.
SLICE_BYTES = 4 << 20


def gram_sets(docs: DataFrame, n: int = 5) -> DataFrame:
    """``doc_id, hs``: the distinct word n-grams as sorted 64-bit hashes, of documents that have any.

    Texts are normalised natively; NumPy then hashes all words of a batch, and rolls these hashes into those of the
    grams, so no gram is ever spelled out.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * SLICE_BYTES / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                yield pa.RecordBatch.from_arrays([part.column(0), gram_lists(part.column(1), n)], ["doc_id", "hs"])

    key = docs.schema["doc_id"].dataType.simpleString()
    normal = docs.select("doc_id", normalize_text(F.col("text")).alias("text"))
    return normal.mapInArrow(hashed, f"doc_id {key}, hs array<long>").where(F.col("hs").isNotNull())


#: Leading bits of a gram's MD5 that say which bucket it is counted in.
BUCKET_BITS = 12


def shared_grams(docs: DataFrame, n: int = 5) -> DataFrame:
    """``gram_md5, n_docs``: the word n-grams of the normalised texts that more than one row has.

    A gram travels as the sixteen bytes of its MD5 and two of a count, once for each few megabytes of text, and those of a bucket side by side in
    one value; a bucket is counted at a time.
    """

    def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        return keys[first], np.add.reduceat(counts, first)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096, SLICE_BYTES):  # so few rows that a count has two bytes
            digests: list[bytes] = []
            for text in part.column("text").to_pylist():
                w = (text or "").encode().split()
                digests.append(b"".join([md5(g).digest() for g in {b" ".join(g) for g in zip(*(w[i:] for i in range(n)))}]))
            keys = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
            if not len(keys):
                continue
            keys, counts = summed(keys, np.ones(len(keys), np.int64))
            bucket = (keys[:, 0] >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
            cuts = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(keys)]
            values = [(int(bucket[a]), keys[a:b].tobytes(), counts[a:b].astype(np.uint16).tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*values, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "grams", "counts"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, grams, counts = None, [], []

        def rows() -> pa.RecordBatch:
            keys, times = summed(np.frombuffer(b"".join(grams), np.uint64).reshape(-1, 2), np.frombuffer(b"".join(counts), np.uint16).astype(np.int64))
            spelled = keys[times > 1].astype(">u8").tobytes().hex()
            return pa.RecordBatch.from_arrays([pa.array([spelled[i : i + 32] for i in range(0, len(spelled), 32)], pa.string()), pa.array(times[times > 1])], ["gram_md5", "n_docs"])

        for batch in batches:
            for r in range(batch.num_rows):
                bucket, some, times = (batch.column(c)[r].as_py() for c in ("bucket", "grams", "counts"))
                if bucket != here and grams:
                    yield rows()
                    grams, counts = [], []
                here = bucket
                grams.append(some)
                counts.append(times)
        if grams:
            yield rows()

    buckets = docs.select(normalize_text(F.col("text")).alias("text")).mapInArrow(packed, "bucket int, grams binary, counts binary")
    return buckets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(counted, "gram_md5 string, n_docs long")


def set_classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with the same grams are one class, which its smallest id stands for.

    Returns the sets of the representatives, and ``a, b, jaccard`` that tie every other member to its own: a large
    group of copies costs its size, not its square.
    """
    key = F.struct(F.xxhash64("hs").alias("h1"), F.xxhash64(F.lit(7), F.col("hs")).alias("h2")).alias("set")
    member = sets.select("doc_id", key)
    classes = cut_lineage(member.groupBy("set").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    several = classes.where("n > 1")
    total = several.agg(F.sum("n")).first()[0] or 0
    copies = small(join_keyed(member, several, "set", "n", total).where("doc_id != low"))
    same = copies.select(F.col("low").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("jaccard"))
    # sets stay where they lie, as long as the copies are few enough to be sent to them
    heads = sets.where(F.col("doc_id").isNotNull()).withColumn("set", key).join(copies.select("doc_id", "set"), ["doc_id", "set"], "left_anti")
    return heads.select("doc_id", "hs"), same


def exact_jaccard_pairs(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """``a, b, jaccard``: every pair of different gram sets at or over the threshold, by their representatives, and the members of each.

    Prefix filtering: all sets have their grams in one order, frequent ones last, and two sets this similar must share one of
    their first ``size - ceil(threshold * size) + 1`` grams, so only these travel and meet.
    """
    sets, same = set_classes(cut_lineage(gram_sets(docs, n)))
    return verified_pairs(prefix_candidates(sets, threshold), sets, threshold).unionByName(same)


#: Leading bits of a gram's hash that say in which cell it is counted: a table of 16 MB, whatever the input.
CELL_BITS = 22


def cells_of(grams: np.ndarray) -> np.ndarray:
    return (grams.view(np.uint64) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def cell_counts(sets: DataFrame) -> np.ndarray:
    """How many grams of all ``hs`` fall into each cell. A task sends its table once, compressed and in sections, which are added up side by side."""
    section = 1 << 16

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.uint32)
        for part in slices(batches, 4096, SLICE_BYTES):
            np.add.at(cells, cells_of(part.column("hs").flatten().to_numpy()), np.uint32(1))
        for at in np.flatnonzero(cells.reshape(-1, section).any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(cells[at * section : (at + 1) * section].tobytes(), 1)], pa.binary())], ["section", "cells"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, cells in zip(batch.column("section").to_pylist(), batch.column("cells"), strict=True):
                sums[at] = sums.get(at, 0) + np.frombuffer(zlib.decompress(cells.as_py()), np.uint32)
        for at, cells in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([cells.tobytes()], pa.binary())], ["section", "cells"])

    kind = "section int, cells binary"
    total = np.zeros((1 << CELL_BITS - 16, section), np.uint32)
    for row in sets.select("hs").mapInArrow(counted, kind).repartition("section").mapInArrow(added, kind).collect():
        total[row["section"]] = np.frombuffer(row["cells"], np.uint32)
    return total.reshape(-1)


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """``doc_id, n_grams, h``: the first ``size - ceil(threshold * size) + 1`` grams of each set, ordered by the count of their cell, then by hash.

    Any order will do as long as it is the same for all sets. The cells stand for the grams' own counts, which would take a shuffle of every
    gram: a frequent one makes its cell stand out, and rare ones that are taken for each other only swap places.
    """
    counts = sets.sparkSession.sparkContext.broadcast(cell_counts(sets))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = counts.value
        for part in slices(batches, 4096, SLICE_BYTES):
            grams = part.column("hs").flatten().to_numpy()
            sizes = pc.list_value_length(part.column("hs")).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort((row << 32) + cells[cells_of(grams)], kind="stable")  # hashes are sorted as they come
            length = sizes - np.ceil(sizes * threshold - 1e-9).astype(np.int64) + 1
            kept = np.flatnonzero(np.arange(len(grams)) - (np.cumsum(sizes) - sizes)[row] < length[row])
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row[kept])), pa.array(sizes[row[kept]].astype(np.int32)), pa.array(grams[order[kept]])], ["doc_id", "n_grams", "h"])

    key = sets.schema["doc_id"].dataType.simpleString()
    return sets.select("doc_id", "hs").mapInArrow(first, f"doc_id {key}, n_grams int, h long")


def prefix_candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a < b`` of sets that share enough grams of their prefixes: every pair at or over the threshold, and others.

    What two sets share outside their common prefix lies behind the prefix of one of them, so the rest of the longer one bounds it.
    """
    keys = prefixes(sets, threshold)
    a, b = keys.select(F.col("doc_id").alias("a"), F.col("n_grams").alias("na"), "h"), keys.select(F.col("doc_id").alias("b"), F.col("n_grams").alias("nb"), "h")
    met = a.join(b, "h").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold))
    need = F.ceil((F.col("na") + F.col("nb")) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9)) - F.ceil(F.greatest("na", "nb") * F.lit(threshold) - F.lit(1e-9)) + 1
    return met.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(need).alias("need")).where("n >= need").select("a", "b")


def verified_pairs(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Exact Jaccard of candidate pairs from ``doc_id, hs`` sets.

    A set travels to its pairs' tiles, not with each pair: near copies of one text meet in a tile, or in a few if there are many.
    """
    placed = tiles(pairs)
    homes = small(placed.select(F.explode(F.array("a", "b")).alias("doc_id"), "family", "x", "y").distinct())
    sent = sets.join(homes, "doc_id").select(*[F.col(c).alias(c) for c in ("family", "x", "y")], "doc_id", "hs")

    def compared(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        lists = sets["hs"].combine_chunks()
        found: dict[object, list[np.ndarray]] = {}
        for at, doc in enumerate(sets["doc_id"].to_pylist()):
            found.setdefault(doc, []).append(lists[at].values.to_numpy())
        kept, jaccard = [], []
        for at, (a, b) in enumerate(zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True)):
            for ha in found.get(a, ()):
                for hb in found.get(b, ()):
                    shared = len(np.intersect1d(ha, hb, assume_unique=True))
                    if shared / (len(ha) + len(hb) - shared) >= threshold:
                        kept.append(at)
                        jaccard.append(shared / (len(ha) + len(hb) - shared))
        return pairs.select(["a", "b"]).take(pa.array(kept, pa.int64())).append_column("jaccard", pa.array(jaccard, pa.float64()))

    key = sets.schema["doc_id"].dataType.simpleString()
    return sent.groupBy("family", "x", "y").cogroup(placed.groupBy("family", "x", "y")).applyInArrow(compared, f"a {key}, b {key}, jaccard double")


#: Documents of a family that a tile takes from each of its two sides, about.
TILE = 64


def tiles(pairs: DataFrame) -> DataFrame:
    """``a, b, family, x, y``: pairs by the smallest document that ``a`` is paired with, and by two blocks of that family's documents."""
    pairs = cut_lineage(pairs)
    least = pairs.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("least"))
    held = cut_lineage(pairs.join(least, "a", "left").select("a", "b", F.coalesce("least", "a").alias("family")))
    members = held.select("family", F.explode(F.array("a", "b")).alias("doc_id")).distinct().groupBy("family").agg(F.ceil(F.count("*") / TILE).alias("blocks"))
    sizes = held.groupBy("family").agg(F.count("*").alias("n")).join(members, "family")
    x, y = (F.pmod(F.xxhash64(c), F.col("blocks")) for c in ("a", "b"))
    return cut_lineage(join_keyed(held, sizes, "family", "n", held.count()).select("a", "b", "family", F.least(x, y).alias("x"), F.greatest(x, y).alias("y")))


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, jaccard`` of any pairs. Only the sets that are in a pair are sent to them."""
    pairs = cut_lineage(pairs)
    paired = small(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = sets.join(paired, "doc_id", "left_semi")
    left = sets.select(F.col("doc_id").alias("a"), F.col("hs").alias("ha"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("hs").alias("hb"))
    shared = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", (shared / (F.size("ha") + F.size("hb") - shared)).alias("jaccard"))


def coefficients(n: int, seed: int = 42) -> list[tuple[int, int]]:
    rng = random.Random(seed)
    return [(rng.randrange(1, PRIME), rng.randrange(PRIME)) for _ in range(n)]


def minhash_signatures(docs: DataFrame, n_hashes: int = 100, n: int = 5, seed: int = 42) -> DataFrame:
    """``doc_id, signature``: minima of (a*h + b) mod p over the grams, for every coefficient pair; documents without grams have none.

    Texts are normalised natively; words, grams and minima are left to Python and NumPy on pieces of Arrow batches, where they cost a
    part of what interpreted lambdas take.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 512, 1 << 20):
            rows: list[np.ndarray | None] = []
            for text in part.column("text").to_pylist():
                w = (text or "").encode().split()
                grams = {b" ".join(g) for g in zip(*(w[i:] for i in range(n)))}
                first = b"".join([md5(g).digest()[:4] for g in grams])
                rows.append((np.frombuffer(first, ">u4") & PRIME).astype(np.int64) if grams else None)
            ends = np.cumsum([0, *(0 if r is None else len(r) for r in rows)])
            values = np.concatenate([r for r in rows if r is not None] or [np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([r is None for r in rows]))], ["doc_id", "ms"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", normalize_text(F.col("text")).alias("text")).mapInArrow(lambda it: signed_batches(hashed(it), n_hashes, seed), f"doc_id {key}, signature array<long>")


def signed_batches(batches: Iterator[pa.RecordBatch], n_hashes: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Signatures of hash lists; rows without a list are left out. ``(a*h + b) mod (2**31 - 1)`` is folded, not divided."""
    a, b = (np.array(x, np.uint64) for x in zip(*coefficients(n_hashes, seed), strict=True))
    prime, bits = np.uint64(PRIME), np.uint64(31)
    for batch in batches:
        lists = batch.column(1)
        rows, at = [], []
        for one in range(batch.num_rows):
            h = lists[one].values
            if h is None or not len(h):
                if h is not None:
                    at.append(one)
                    rows.append(np.full(n_hashes, PRIME, np.int64))
                continue
            h = h.to_numpy(zero_copy_only=False).astype(np.uint64)
            least = np.full(n_hashes, prime, np.uint64)
            for low in range(0, len(h), 512):
                x = h[low : low + 512, None] * a + b
                x = (x & prime) + (x >> bits)
                least = np.minimum(least, np.minimum(x, x - prime).min(axis=0))
            at.append(one)
            rows.append(least.astype(np.int64))
        values = np.concatenate(rows) if rows else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * n_hashes, pa.int32()), values)], ["doc_id", "signature"])


def signatures_of(hashed: DataFrame, n_hashes: int = 100, seed: int = 42) -> DataFrame:
    """``doc_id, signature`` from ``doc_id, ms`` (31-bit hashes)."""
    key = hashed.schema["doc_id"].dataType.simpleString()
    return hashed.select("doc_id", "ms").mapInArrow(lambda it: signed_batches(it, n_hashes, seed), f"doc_id {key}, signature array<long>")


def lsh_buckets(signatures: DataFrame, bands: int) -> DataFrame:
    """``doc_id, band, key``; hashes that don't fill a band are left out."""
    rows = F.floor(F.size("signature") / bands).cast("int")
    return signatures.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(F.slice("signature", i * rows + 1, rows)))).alias("band", "key"))


def lsh_candidates(signatures: DataFrame, bands: int) -> DataFrame:
    """Distinct pairs ``a < b`` that share a bucket; singleton buckets go before the self-join."""
    buckets = lsh_buckets(signatures, bands)
    shared = buckets.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key")
    left = buckets.join(shared, ["band", "key"])
    return left.select("band", "key", F.col("doc_id").alias("a")).join(left.select("band", "key", F.col("doc_id").alias("b")), ["band", "key"]).where("a < b").select("a", "b").distinct()


def fuzzy_pairs(docs: DataFrame, n_hashes: int = 100, bands: int = 20, n: int = 5, threshold: float = 0.8, complete: bool = False) -> DataFrame:
    """LSH candidates verified by exact Jaccard: pairs of representatives of the different gram sets, and the members of each.

    A pair at 0.8 shares no bucket of 20 bands of five in one case of 2,800. ``complete`` adds the pairs that buckets missed, which
    share a gram of their prefixes.
    """
    heads, same = set_classes(cut_lineage(gram_sets(docs, n)))
    mixed = F.transform("hs", lambda h: F.shiftrightunsigned(h, 33).cast("long"))
    candidates = lsh_candidates(signatures_of(heads.select("doc_id", mixed.alias("ms")), n_hashes), bands)
    if complete:
        candidates = candidates.unionByName(prefix_candidates(heads, threshold)).distinct()
    return verified_pairs(candidates, heads, threshold).unionByName(same)


#: Members up to which all pairs of a bucket are compared; larger ones are linked through a pivot.
HOT_BUCKET = 32


def bucket_links(buckets: DataFrame, sets: DataFrame, threshold: float, hot: int = HOT_BUCKET) -> DataFrame:
    """``a, b, jaccard`` over the threshold, such that the components are those of all pairs that share a bucket.

    A large bucket's members are compared with its smallest, the pivot. Who is similar to it is linked, and needs no link to
    others that are. One minus Jaccard is a metric, so a member that isn't similar to the pivot can be similar only to those
    whose distance to the pivot differs from its own by no more than a link may span; it is compared with these. A bucket of near
    copies of one text costs a comparison each.
    """
    buckets = cut_lineage(buckets)
    sizes = buckets.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("doc_id").alias("pivot")).where("n > 1")
    held = buckets.join(sizes, ["band", "key"])
    few = held.where(f"n <= {int(hot)}")
    few = few.select("band", "key", F.col("doc_id").alias("a")).join(few.select("band", "key", F.col("doc_id").alias("b")), ["band", "key"]).where("a < b").select("a", "b").distinct()
    many = held.where(f"n > {int(hot)}").select("band", "key", "pivot", "doc_id")
    spokes = cut_lineage(similarities(many.where("pivot != doc_id").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct(), sets))
    linked = spokes.where(F.col("jaccard") >= threshold)

    span = 1 - threshold + 1e-9
    away = many.join(spokes.select(F.col("a").alias("pivot"), F.col("b").alias("doc_id"), (1 - F.col("jaccard")).alias("d")), ["pivot", "doc_id"], "left")
    away = away.select("band", "key", "doc_id", F.coalesce("d", F.lit(0.0)).alias("d"), (F.coalesce("d", F.lit(0.0)) > 1 - threshold + 1e-12).alias("apart"))
    lone = away.where("apart").select("band", "key", F.col("doc_id").alias("x"), F.col("d").alias("dx"))
    cross = away.where("d > 0").join(lone, ["band", "key"]).where((F.abs(F.col("d") - F.col("dx")) <= span) & (F.col("doc_id") != F.col("x")) & (~F.col("apart") | (F.col("doc_id") < F.col("x"))))
    cross = cross.select(F.least("doc_id", "x").alias("a"), F.greatest("doc_id", "x").alias("b")).distinct()
    return verified_pairs(few.unionByName(cross).distinct(), sets, threshold).unionByName(linked)


def fuzzy_links(docs: DataFrame, n_hashes: int = 100, bands: int = 20, n: int = 5, threshold: float = 0.8, hot: int = HOT_BUCKET) -> DataFrame:
    """Links whose components are those of ``fuzzy_pairs``; large groups of different near copies cost their size, not its square."""
    heads, same = set_classes(cut_lineage(gram_sets(docs, n)))
    mixed = F.transform("hs", lambda h: F.shiftrightunsigned(h, 33).cast("long"))
    return bucket_links(lsh_buckets(signatures_of(heads.select("doc_id", mixed.alias("ms")), n_hashes), bands), heads, threshold, hot).unionByName(same)


def clusters(pairs: DataFrame) -> DataFrame:
    """``doc_id, cluster_id`` of every document in a pair; the smallest id represents."""
    found = connected_components(pairs, "a", "b")
    return found.select(F.col("node").alias("doc_id"), F.col("root").alias("cluster_id"))


def drop_duplicates_of(docs: DataFrame, clustered: DataFrame) -> DataFrame:
    """The documents that aren't a non-representative member of a cluster."""
    return docs.join(clustered.where("doc_id != cluster_id").select("doc_id"), "doc_id", "left_anti")


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """``doc_id, item_id, shared``: n-grams a document shares with a benchmark item."""
    items = small(gram_sets(benchmark.select(F.col("item_id").alias("doc_id"), "text"), n).select(F.col("doc_id").alias("item_id"), F.explode("hs").alias("h")))
    return gram_sets(docs, n).select("doc_id", F.explode("hs").alias("h")).join(items, "h").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
