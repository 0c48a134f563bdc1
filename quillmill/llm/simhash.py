"""SimHash near-duplicate groups by tiled exact comparison of 64-bit fingerprints.

Distinct fingerprints are range-sorted by the population counts of the whole word and of its
four 16-bit quarters and packed into tiles. Two fingerprints within ``radius`` bits differ by at
most ``radius`` in the summed differences of those counts, so tile pairs, and inside them pairs of
small sub-tiles, whose count boxes lie farther apart are skipped without looking at a row. What is
left is compared in full with numpy exclusive-or and bit counts. A pair task returns a spanning
forest of its links (at most one row a fingerprint), never all pairs, and the forests meet in a
distributed connected-components step.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import as_bytes, slices, whole_row
from quillmill.operators.graph import connected_components
from quillmill.operators.skew import join_keyed
from quillmill.session import cut_lineage

SHINGLE = 4
SEED = 42
RADIUS = 4
TILE = 16384
SUB = 256
_CHUNK = 1 << 15


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the A-Z-lowered word shingles; no word (or null): 0."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if n <= shingle:
        return int.from_bytes(digest(joined, SEED), "big")
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    ends = starts[shingle : n + 1]
    counts = np.zeros(64, dtype=np.int64)
    total = n - shingle + 1
    for at in range(0, total, _CHUNK):
        some = b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(starts[at : min(at + _CHUNK, total)], ends[at : at + _CHUNK], strict=True)])
        bits = np.unpackbits(np.frombuffer(some, np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 2048):
        fp = np.fromiter((fingerprint(t) for t in as_bytes(part.column("text"))), np.uint64, part.num_rows)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), pa.array(fp.view(np.int64))], ["doc_id", "row_key", "fp"])


def row_key() -> Column:
    """A hash of id and text; with the id beside it a result finds its row without carrying the text."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("text").cast("string"), F.col("doc_id").cast("long")).alias("row_key")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, row_key, fp)`` with the fingerprint's bits in a signed long."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_fingerprints, "doc_id long, row_key long, fp long")


def _counts(fp: np.ndarray) -> np.ndarray:
    """Population counts: the four quarters."""
    return np.stack([np.bitwise_count((fp >> np.uint64(s)) & np.uint64(0xFFFF)) for s in (48, 32, 16, 0)], axis=1).astype(np.int16)


def _pack(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[pa.RecordBatch]:
    base, number, held = TaskContext.get().partitionId() << 32, 0, []
    names = ["tile", "lo", "hi", "box", "fps"]

    def out(fp: np.ndarray) -> pa.RecordBatch:
        nonlocal number
        q = _counts(fp.view(np.uint64))
        pc = q.sum(axis=1)
        row = [[base + number], [int(pc.min())], [int(pc.max())], [[*map(int, q.min(axis=0)), *map(int, q.max(axis=0))]], [fp.tobytes()]]
        number += 1
        return pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary()), strict=True)], names
        )

    size = 0
    for batch in batches:
        held.append(batch.column("fp").to_numpy(zero_copy_only=False))
        size += batch.num_rows
        while size >= tile:
            whole = np.concatenate(held)
            yield out(whole[:tile])
            held, size = [whole[tile:]], size - tile
    if size:
        yield out(np.concatenate(held))


def _gap(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> np.ndarray:
    """Least summed difference of counts between boxes (last axis: the counts)."""
    return np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a)).sum(axis=-1)


def _block_edges(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a block's bipartite links, as row and column indices."""
    r, c = np.nonzero(hit)
    if r.size <= 2 * sum(hit.shape):
        return r, c
    big = hit.shape[0]
    label = np.arange(big)
    while True:
        col = np.where(hit, label[:, None], big).min(axis=0)
        row = np.minimum(label, np.where(hit, col[None, :], big).min(axis=1))
        if (row == label).all():
            break
        label = row
    # one link for each column, and one for each row, to the same label's members
    first_row = np.where(hit.any(axis=0), np.argmax(hit, axis=0), -1)
    first_col = np.where(hit.any(axis=1), np.argmax(hit, axis=1), -1)
    cols, rows = np.flatnonzero(first_row >= 0), np.flatnonzero(first_col >= 0)
    extra_r, extra_c = [], []
    for lab in np.unique(label[rows]):
        members = rows[label[rows] == lab]
        if members.size > 1:  # members are linked in truth, through this block; any column of the label stands for it
            anchor = first_col[members[0]]
            extra_r.append(members)
            extra_c.append(np.full(members.size, anchor))
    return (
        np.concatenate([first_row[cols], rows, *extra_r]),
        np.concatenate([cols, first_col[rows], *extra_c]),
    )


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component, by hooking and pointer jumping."""
    root = np.arange(n)
    while a.size:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def compare_tiles(fa: np.ndarray, fb: np.ndarray | None, radius: int, sub: int = SUB) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between two tiles (or inside one, ``fb`` None) as fingerprint arrays."""
    same = fb is None
    fb = fa if same else fb
    cut = lambda x: [x[i : i + sub] for i in range(0, len(x), sub)]
    blocks_a, blocks_b = cut(fa), cut(fb)
    box = lambda blocks: [np.stack([f(_counts(x), axis=0) for x in blocks]) for f in (np.min, np.max)]
    (la, ha), (lb, hb) = box(blocks_a), box(blocks_b)
    near = _gap(la[:, None], ha[:, None], lb[None], hb[None]) <= radius
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, j in zip(*np.nonzero(near), strict=True):
        if same and j < i:
            continue
        hit = np.bitwise_count(blocks_a[i][:, None] ^ blocks_b[j][None, :]) <= radius
        if same and i == j:
            np.fill_diagonal(hit, False)
        if hit.any():
            r, c = _block_edges(hit)
            left.append(r + i * sub)
            right.append(c + j * sub)
    a, b = np.concatenate(left), np.concatenate(right)
    offset = 0 if same else len(fa)
    values = fa if same else np.concatenate([fa, fb])
    root = local_roots(len(values), a, b + offset)
    moved = np.flatnonzero(root != np.arange(len(values)))
    return values[moved], values[root[moved]]


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            fa = np.frombuffer(row["fps_a"], np.uint64)
            fb = None if row["a"] == row["b"] else np.frombuffer(row["fps_b"], np.uint64)
            src, dst = compare_tiles(fa, fb, radius)
            yield pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], ["src", "dst"])


def near_links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links ``(src, dst)`` whose components are those of all fingerprints within ``radius`` bits."""
    quarter = lambda s: F.bit_count(F.shiftrightunsigned("fp", s).bitwiseAND(F.lit(0xFFFF)))
    keys = fps.select(F.bit_count("fp").alias("_pc"), *[quarter(s).alias(f"_q{s}") for s in (48, 32, 16)], "fp")
    order = ["_pc", "_q48", "_q32", "_q16", "fp"]
    tiles = cut_lineage(
        keys.repartitionByRange(*order).sortWithinPartitions(*order).select("fp")
        .mapInArrow(lambda it: _pack(it, tile), "tile long, lo int, hi int, box array<int>, fps binary")
    )
    width = radius + 1
    bands = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width).cast("int"), F.floor(hi / width).cast("int"))).alias("band")
    meta = tiles.select("tile", "lo", "hi", "box")
    a = meta.select(F.col("tile").alias("a"), F.col("box").alias("box_a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), bands(F.col("lo"), F.col("hi")))
    b = meta.select(F.col("tile").alias("b"), F.col("box").alias("box_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), bands(F.col("lo") - radius, F.col("hi") + radius))
    gap = sum(
        (F.greatest(F.lit(0), F.col("box_a")[k] - F.col("box_b")[k + 4], F.col("box_b")[k] - F.col("box_a")[k + 4]) for k in range(1, 4)),
        F.greatest(F.lit(0), F.col("box_a")[0] - F.col("box_b")[4], F.col("box_b")[0] - F.col("box_a")[4]),
    )
    pairs = (
        a.join(b, "band").where((F.col("a") <= F.col("b")) & (F.col("lo_a") <= F.col("hi_b") + radius) & (F.col("lo_b") <= F.col("hi_a") + radius) & (gap <= radius))
        .select("a", "b").distinct()
    )
    work = pairs.join(tiles.select(F.col("tile").alias("a"), F.col("fps").alias("fps_a")), "a").join(
        tiles.select(F.col("tile").alias("b"), F.col("fps").alias("fps_b")), "b"
    )
    return work.select("a", "b", "fps_a", "fps_b").mapInArrow(lambda it: _compare(it, radius), "src long, dst long")


def _grouped(docs: DataFrame, radius: int, tile: int) -> DataFrame:
    """``doc_id, row_key, fp, component_id, n_same, root`` (the group's fingerprint of reference)."""
    marked = cut_lineage(fingerprints(docs))
    each = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n_same")))
    total = each.agg(F.sum("n_same")).first()[0] or 0
    parts = connected_components(near_links(each.select("fp"), radius, tile)).withColumnRenamed("node", "fp")
    linked = cut_lineage(parts.join(each.select("fp", "low"), "fp"))
    lows = linked.groupBy("root").agg(F.min("low").alias("group_low"))
    found = each.join(linked.join(lows, "root").select("fp", "root", "group_low"), "fp", "left").select(
        "fp", F.coalesce("group_low", "low").alias("component_id"), F.col("n_same").alias("_count"), "n_same", F.coalesce("root", "fp").alias("root")
    )
    return join_keyed(marked, found, "fp", "_count", total)


def simhash_groups(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row a document: ``doc_id, fingerprint, component_id, n_same`` (documents with that fingerprint).

    ``component_id`` is the smallest doc_id reachable over links of at most ``radius`` differing
    bits. Null and word-free texts share fingerprint zero and link like any other. Repeated rows
    each come back; rows with a null doc_id come back with the smallest non-null id of their group
    (null if it has none). An empty table gives no rows; other columns are not looked at.
    """
    return _grouped(docs, radius, tile).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_same")


def keep_one_of_each(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """The rows and columns of one document of each group: its smallest doc_id (null last), least row hash on ties.

    Null and empty texts are one group (fingerprint zero), of which one row stays; of repeated rows one stays;
    rows that share id and text but differ elsewhere count as repeated, and the least hash of all columns stays.
    Columns may have any name; an empty table gives no rows.
    """
    groups = _grouped(docs, radius, tile)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row_key")).alias("first"))
    kept = first.select(F.coalesce("first.doc_id", F.lit(0)).alias("id"), F.col("first.row_key").alias("row_key"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), row_key(), whole_row(docs).alias("row"))
    rows = rows.join(kept, ["row_key", "id"], "left_semi")
    same = Window.partitionBy("row_key", "id").orderBy(F.xxhash64("row"))  # dealt as the join is, so texts move once
    return rows.withColumn("n", F.row_number().over(same)).where("n = 1").select("row.*")
