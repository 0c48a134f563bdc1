"""Removal of bytes that occur earlier, by Burrows-Wheeler transforms of collections that grow column by column.

1. Every window of ``WINDOW`` bytes has an anchor, the least hash of a ``GRAM``-byte string in it, so equal windows
   have equal anchors wherever they are. Anchors are counted; around one that occurs once nothing can repeat. What stays
   are stretches of consecutive windows with a shared anchor ("regions").
2. The bytes of all regions of an anchor, copies included, meet in one collection; an anchor with more than ``WIDE`` regions
   is salted over several. Regions reach their collections through Spark's shuffle files, which are read once, in order.
3. A collection is a set of strings. Each round inserts one more symbol of every string, from the last to the first, into the
   transform, and brings the common prefixes of neighbours up to date. A symbol is twenty bytes, numbered within the
   collection: a window is five of them, and a region is twenty strings, one for each offset of its bytes, so that every
   window starts at a symbol.
4. Runs of suffixes that share five symbols are equal windows. All but the run's earliest are marked. Of a salted anchor,
   each collection's earliest are compared once more, by the window's 128-bit digest.
5. The marks go back to their documents, where the bytes they cover are removed.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import as_bytes, slices
from quillmill.llm.words import _BYTE, _INVERSE, _ROOT, _power, mix, window_minimum
from quillmill.operators.skew import join_keyed
from quillmill.session import cut_lineage, shared_folder

WINDOW = 100
GRAM = 24
#: Windows in a region.
LONGEST = 128
#: Regions of one anchor in a collection; more are salted over several.
WIDE = 1024
#: Bytes of a collection, unless a single anchor's share is more.
COLLECTION_BYTES = 1 << 16
#: Shared anchors that are sent to every task, as a filter of two bytes each; more are joined.
MOST_SENT = 100_000_000
#: Words of 64 bits in a piece of the filter, which one group of rows makes.
PIECE = 1 << 16
#: Bytes that are hashed at a time.
SEGMENT = 1 << 20


def _symbol_bytes(window: int) -> int:
    return next(w for w in range(20, 0, -1) if window % w == 0)


def _numbered(data: np.ndarray, width: int) -> np.ndarray:
    """A number for the ``width`` bytes from each position on, the same for equal ones only."""
    n = len(data) - width + 1
    if n < 1:
        return np.empty(0, np.int64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_ROOT, len(data)), out=total[1:])
    hashes = mix((total[width:] - total[:-width]) * _power(_INVERSE, len(data))[:n])
    number, first = pd.factorize(hashes.view(np.int64))
    one_of = np.empty(len(first), np.int64)
    one_of[number] = np.arange(n)
    twin = one_of[number]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = padded[: len(data)].astype(np.uint64)
    for i in range(1, min(8, width)):
        eight |= padded[i : len(data) + i].astype(np.uint64) << np.uint64(8 * i)
    for i in {*range(0, width - 7, 8), max(0, width - 8)}:  # equal hashes of other bytes would be taken apart here
        part = eight[i : i + n]
        if np.any(part != part[twin]):
            return np.unique(np.lib.stride_tricks.sliding_window_view(data, width), axis=0, return_inverse=True)[1].reshape(-1)
    return number


class Collection:
    """Transform of all strings of regions, built one column a round.

    ``pairs`` is the transform, as the sorted list of (symbol, place): the symbol that stands before the suffix at that
    place of the order. The i-th pair is also the i-th suffix, its first symbol and the place of the rest of it. Places
    count the strings' ends first, then the suffixes. ``common[i]`` are the symbols that suffix i shares with the one
    before, up to ``cap``; ``starts[i]`` is where it starts in ``data``.
    """

    def __init__(self, regions: list[bytes], cap: int, width: int) -> None:
        self.cap, self.width = cap, width
        data = np.frombuffer(b"".join(regions), np.uint8)
        sizes = np.fromiter(map(len, regions), np.int64, len(regions))
        stops = np.cumsum(sizes)
        self.symbol = np.zeros(len(data), np.int64)
        if len(data) >= width:
            self.symbol[: len(data) - width + 1] = _numbered(data, width)
        self.left = (np.repeat(stops, sizes) - np.arange(len(self.symbol))) // width  # symbols from here to the string's end
        offset = np.arange(width)
        begins = ((stops - sizes)[:, None] + offset)[sizes[:, None] - offset >= cap * width]
        self.lengths = self.left[begins]
        self.ends = begins + self.lengths * width
        self.pairs, self.starts, self.common = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint8)
        self._place = np.arange(len(begins))
        self._live = np.arange(len(begins))
        for column in range(1, int(self.lengths.max(initial=0)) + 1):
            self._insert(column)

    def _insert(self, column: int) -> None:
        live = self._live = self._live[self.lengths[self._live] >= column]
        place = self._place[live]
        pair = np.sort(self.symbol[self.ends[live] - column * self.width] << 31 | place)
        by_place = np.empty(len(self.lengths) + len(self.pairs), np.int32)
        by_place[place] = live
        live = by_place[pair & 0x7FFFFFFF]
        start = self.ends[live] - column * self.width
        gap = np.searchsorted(self.pairs, pair)
        at, n, ends = gap + np.arange(len(gap)), len(self.pairs), len(self.lengths)
        stays = np.ones(n + len(at), bool)
        stays[at] = False

        def merged(old: np.ndarray, new: np.ndarray | int) -> np.ndarray:
            out = np.empty(len(stays), old.dtype)
            out[stays], out[at] = old, new
            return out

        pairs, starts, common = merged(self.pairs, pair), merged(self.starts, start), merged(self.common, 0)
        behind = at + 1  # the suffix after an inserted one, unless it was inserted too
        changed = np.concatenate([at, behind[np.append(behind[:-1] != at[1:], True)]]) if len(at) else at
        changed = changed[(changed > 0) & (changed < len(pairs))]
        common[changed] = self._common(pairs, starts, changed)
        # what stood behind an insertion moves back, and so do the places in the pairs
        moved = np.zeros(ends + n, np.int32)
        np.cumsum(np.bincount(gap, minlength=n + 1)[:n], out=moved[ends:])
        pairs += moved[pairs & 0x7FFFFFFF]
        self.pairs, self.starts, self.common = pairs, starts, common
        self._place[live] = ends + at

    def _common(self, pairs: np.ndarray, starts: np.ndarray, changed: np.ndarray) -> np.ndarray:
        """Common prefixes of suffixes with those before them, while places are still those before this round."""
        here, before, ends = pairs[changed], pairs[changed - 1], len(self.lengths)
        rest, other = here & 0x7FFFFFFF, before & 0x7FFFFFFF
        out = np.zeros(len(changed), np.int64)
        same = here >> 31 == before >> 31
        out[same & (other < ends)] = 1
        known = same & (other >= ends) & (rest == other + 1)  # the rests are neighbours: one symbol more than they share
        out[known] = np.minimum(1 + self.common[rest[known] - ends].astype(np.int64), self.cap)
        far = np.flatnonzero(same & (other >= ends) & (rest != other + 1))
        a, b = starts[changed[far]], starts[changed[far] - 1]
        most = np.minimum(np.minimum(self.left[a], self.left[b]), self.cap)
        for k in range(1, self.cap + 1):
            out[far] = k
            on = most > k
            far, a, b, most = far[on], a[on] + self.width, b[on] + self.width, most[on]
            on = self.symbol[a] == self.symbol[b]
            far, a, b, most = far[on], a[on], b[on], most[on]
            if not len(far):
                break
        return out

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows and the number of each one's run of equal windows, run by run."""
        windows = self.left[self.starts] >= self.cap
        run = np.cumsum(self.common < self.cap)[windows]
        return self.starts[windows], run


def _regions(texts: list[bytes], window: int, gram: int, seen: bool = False) -> tuple[np.ndarray, ...]:
    """Text, first window, windows and anchor of each region; ``seen`` adds whether the anchor is in it more than once,
    without which no window of the region is equal to another of it."""
    found: list[tuple[np.ndarray, ...]] = []
    held: list[tuple[int, int, bytes]] = []

    def settle() -> None:
        data = np.frombuffer(b"".join(piece for _, _, piece in held), np.uint8)
        if len(data) >= window:
            sizes = np.array([len(piece) for _, _, piece in held])
            stops = np.cumsum(sizes)
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTE[data] * _power(_ROOT, len(data)), out=total[1:])
            grams = mix((total[gram:] - total[:-gram]) * _power(_INVERSE, len(data))[: len(data) - gram + 1]) >> np.uint64(16)  # 48 bits: a false anchor only costs
            least = window_minimum(grams, window - gram + 1)
            owner = np.repeat(np.arange(len(held)), sizes)[: len(least)]
            fits = np.arange(len(least)) + window <= stops[owner]
            new = np.ones(len(least), bool)
            new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
            begin = np.flatnonzero(new & fits)
            stop = np.flatnonzero(fits & np.concatenate([new[1:] | ~fits[1:], [True]])) + 1
            if len(begin):
                cuts = -(-(stop - begin) // LONGEST)
                which = np.repeat(np.arange(len(begin)), cuts)
                first = begin[which] + LONGEST * (np.arange(len(which)) - np.repeat(np.cumsum(cuts) - cuts, cuts))
                at = owner[first]
                text, offset = np.array([t for t, _, _ in held]), np.array([o for _, o, _ in held])
                windows = np.minimum(stop[which] - first, LONGEST)
                columns = [text[at], first - (stops - sizes)[at] + offset[at], windows, least[first]]
                if seen:
                    around = np.arange(window - gram + 1)
                    leftmost = (grams[first[:, None] + around] == columns[3][:, None]).argmax(axis=1)
                    rightmost = (grams[(first + windows - 1 + window - gram)[:, None] - around] == columns[3][:, None]).argmax(axis=1)
                    columns.append(leftmost != windows - 1 + window - gram - rightmost)
                found.append(tuple(columns))
        held.clear()

    size = 0
    for i, text in enumerate(texts):
        for offset in range(0, len(text) - window + 1, SEGMENT):
            held.append((i, offset, text[offset : offset + SEGMENT + window - 1]))
            size += len(held[-1][2])
            if size >= SEGMENT:
                settle()
                size = 0
    settle()
    if not found:
        return (*[np.empty(0, np.int64)] * 3, np.empty(0, np.uint64), *[np.empty(0, bool)] * seen)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _anchors(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 4096):
        *_, anchor, again = _regions([t or b"" for t in as_bytes(part.column("text"))], window, gram, seen=True)
        distinct, at = np.unique(anchor, return_inverse=True)
        n = np.bincount(at, 1 + again)  # an anchor that is twice in its only region counts as two
        yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(n.astype(np.int64))], ["anchor", "n"])


def _places(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 4096):
        ids, keys = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "key"))
        text, first, windows, anchor = _regions([t or b"" for t in as_bytes(part.column("text"))], window, gram)
        columns = (anchor.view(np.int64), ids[text], keys[text], first, windows.astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "id", "key", "first", "windows"])


def _contents(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The wanted regions with their bytes."""
    names = ["anchor", "salt", "salts", "id", "key", "first", "bytes"]
    before = None
    for part in slices(batches, 256, 2 << 20):
        lists = part.column("wanted")
        sizes = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
        anchor, salt, salts, first, windows = lists.flatten().flatten()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        ids, keys = part.column("id"), part.column("key")
        texts, here = as_bytes(part.column("text")), list(zip(ids.to_pylist(), keys.to_pylist(), strict=True))
        again = np.array([row == last for row, last in zip(here, [before, *here], strict=False)], bool)
        before = here[-1]  # a repeated row; those that aren't neighbours are told apart where they meet
        use = np.flatnonzero(~again[owner])
        low, high = first.to_numpy()[use], (first.to_numpy() + windows.to_numpy() + window - 1)[use]
        pieces = [texts[o][a:b] for o, a, b in zip(owner[use].tolist(), low.tolist(), high.tolist(), strict=True)]
        rows = pa.array(use)
        of = pa.array(owner[use])
        yield pa.RecordBatch.from_arrays([anchor.take(rows), salt.take(rows), salts.take(rows), ids.take(of), keys.take(of), first.take(rows), pa.array(pieces, pa.binary())], names)


def _bits(anchor: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each anchor's word of a filter of ``words`` words, and its five bits there."""
    with np.errstate(over="ignore"):
        h = mix(anchor.astype(np.uint64) * _ROOT + np.uint64(1))
    bits = np.zeros(len(h), np.uint64)
    for shift in range(0, 30, 6):
        bits |= np.uint64(1) << (h >> np.uint64(shift) & np.uint64(63))
    return ((h >> np.uint64(32)) * np.uint64(words) >> np.uint64(32)).astype(np.int64), bits


def _filter(anchors: DataFrame, n: int) -> np.ndarray:
    """Bits of ``n`` anchors, sixteen for each, put together by tasks piece by piece. Of other anchors some 0.4 % are taken for one of them."""
    words = max(1, -(-n // 4))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, bits = _bits(batch.column("anchor").to_numpy(), words)
            yield pa.RecordBatch.from_arrays([pa.array(at // PIECE), pa.array((at % PIECE).astype(np.int32)), pa.array(bits.view(np.int64))], ["piece", "at", "bits"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, data = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([here]), pa.array([data.tobytes()], pa.binary())], ["piece", "data"])
        for batch in batches:
            piece, at, bits = (batch.column(c).to_numpy() for c in ("piece", "at", "bits"))
            cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(piece)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                if here != piece[low]:
                    if here is not None:
                        yield row()
                    here, data = int(piece[low]), np.zeros(PIECE, np.uint64)
                np.bitwise_or.at(data, at[low:high], bits[low:high].view(np.uint64))
        if here is not None:
            yield row()

    rows = anchors.select("anchor").mapInArrow(spread, "piece long, at int, bits long")
    pieces = rows.repartition("piece").sortWithinPartitions("piece").mapInArrow(gathered, "piece long, data binary").toArrow()
    out = np.zeros(-(-words // PIECE) * PIECE, np.uint64)
    for piece, data in zip(pieces.column("piece").to_pylist(), pieces.column("data"), strict=True):
        out[piece * PIECE : (piece + 1) * PIECE] = np.frombuffer(data.as_buffer(), np.uint64)
    return out[:words]


def _shared_contents(batches: Iterator[pa.RecordBatch], window: int, gram: int, known: np.ndarray, wide: np.ndarray, parts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The regions whose anchor passes the filter ``known``, with their bytes; ``parts``: the salts of each of the sorted ``wide`` ones."""
    names = ["anchor", "salt", "salts", "id", "key", "first", "bytes"]
    for part in slices(batches, 1024, 2 << 20):
        texts = [t or b"" for t in as_bytes(part.column("text"))]
        ids, keys = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "key"))
        text, first, windows, anchor = _regions(texts, window, gram)
        anchor = anchor.view(np.int64)
        word, bits = _bits(anchor, len(known))
        use = np.flatnonzero(known[word] & bits == bits)
        text, first, windows, anchor = text[use], first[use], windows[use], anchor[use]
        salts = np.ones(len(use), np.int64)
        if len(wide):
            at = np.minimum(np.searchsorted(wide, anchor), len(wide) - 1)
            salts = np.where(wide[at] == anchor, parts[at], salts)
        with np.errstate(over="ignore"):
            salt = (mix(ids[text].astype(np.uint64) * _ROOT + first.astype(np.uint64)) % salts.astype(np.uint64)).astype(np.int64) if len(use) else use
        pieces = [texts[t][a:b] for t, a, b in zip(text.tolist(), first.tolist(), (first + windows + window - 1).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (anchor, salt, salts, ids[text], keys[text], first)] + [pa.array(pieces, pa.binary())], names)


_CONTENTS = "anchor long, salt long, salts long, id long, key long, first long, bytes binary"
_MARKS = "id long, key long, low long, high long, anchor long, h1 long, h2 long"


def _marked(batches: Iterator[pa.RecordBatch], window: int, budget: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor and salt: whole ones of these make up a collection at a time.

    Gives runs of windows (``low`` to ``high``) that have an equal one earlier, and of salted anchors the windows that are
    earliest in their collection, one by one, with anchor and digest.
    """
    width = _symbol_bytes(window)
    names = [c.split()[0] for c in _MARKS.split(", ")]
    held: list[tuple] = []

    def settle() -> pa.RecordBatch:
        collection = Collection([row[5] for row in held], window // width, width)
        sizes = np.fromiter((len(row[5]) for row in held), np.int64, len(held))
        ids, keys, firsts, salts = (np.fromiter((row[i] for row in held), np.int64, len(held)) for i in (1, 2, 3, 4))
        begins = np.cumsum(sizes) - sizes
        at, run = collection.runs()
        owner = np.searchsorted(begins, at, side="right") - 1
        place = firsts[owner] + at - begins[owner]
        head = np.flatnonzero(np.diff(run, prepend=-1))
        many = np.diff(np.append(head, len(run)))
        least = np.repeat(np.minimum.reduceat(ids[owner], head), many) if len(run) else ids[owner]
        same = ids[owner] == least
        never = np.iinfo(np.int64).max
        first = np.repeat(np.minimum.reduceat(np.where(same, place, never), head), many) if len(run) else place
        late = ~same | (place > first)

        flags = np.zeros(int(sizes.sum()) + 1, np.int8)
        flags[at[late]] = 1
        flags[begins] |= 2  # regions don't run on into one another
        on = (flags & 1).astype(bool)
        begin = np.flatnonzero(on & (np.concatenate([[True], ~on[:-1]]) | (flags >= 2)))
        stop = np.flatnonzero(on & np.concatenate([~on[1:] | (flags[1:] >= 2), [True]]))
        of = np.searchsorted(begins, begin, side="right") - 1
        low, high = firsts[of] + begin - begins[of], firsts[of] + stop - begins[of]

        open_at = np.flatnonzero(~late & (salts[owner] > 1))
        who = owner[open_at].tolist()
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(held[o][5][b : b + window]) for o, b in zip(who, (at - begins[owner])[open_at].tolist(), strict=True)), np.int64).reshape(-1, 2)
        anchors = [held[o][0] for o in who]
        none = [None] * len(of)
        ids_out, keys_out = np.concatenate([ids[of], ids[who]]) if who else ids[of], np.concatenate([keys[of], keys[who]]) if who else keys[of]
        columns = (ids_out, keys_out, np.concatenate([low, place[open_at]]), np.concatenate([high, place[open_at]]), none + anchors, none + digests[:, 0].tolist(), none + digests[:, 1].tolist())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    size, shard, last = 0, None, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "id", "key", "first", "salts", "bytes", "salt")), strict=True):
            if row[:4] == last:
                continue  # of a repeated row
            here, last = (row[0], row[6]), row[:4]
            if here != shard and size >= budget:
                yield settle()
                size = 0
            shard = here
            held.append(row)
            size += len(row[5])
    if held:
        yield settle()


def _removed(batches: Iterator[pa.RecordBatch], window: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    for part in slices(batches, 512):
        rows: list[list] = [[], [], [], [], []]
        lists = part.column("found")
        sizes = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
        low, high = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists.flatten().flatten())
        ends = np.cumsum(sizes)
        for text, a, b in zip(as_bytes(part.column("text")), (ends - sizes).tolist(), ends.tolist(), strict=True):
            kept = text or b""
            n, spans = len(kept), 0
            if a < b:
                edge = np.bincount(low[a:b], minlength=n + 1) - np.bincount(high[a:b] + window, minlength=n + 1)
                gone = np.cumsum(edge[:n]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(kept, np.uint8)[~gone].tobytes()
            for column, value in zip(rows, (n, n - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None), strict=True):
                column.append(value)
        columns = [part.column("doc_id"), *[pa.array(c, pa.int64()) for c in rows[:3]], pa.array(rows[3], pa.string())]
        yield pa.RecordBatch.from_arrays(columns + [pa.array(rows[4], pa.binary())] * with_text, names)


def _sent_contents(slim: DataFrame, anchors: DataFrame, n: int, window: int, gram: int, wide: int) -> DataFrame:
    """A filter of the shared anchors goes to every task, which cuts their regions out of its texts. A region that only looks like
    one of them is alone in its collection, or with regions of another anchor, and costs no more than its bytes."""
    table = anchors.where(F.col("all") > wide).toArrow()  # at most one in ``wide`` of all regions' anchors
    salted = table.column("anchor").to_numpy()
    order = np.argsort(salted)
    parts = -(-table.column("all").to_numpy()[order] // wide)
    sent = slim.sparkSession.sparkContext.broadcast((_filter(anchors, n), salted[order], parts))
    return slim.mapInArrow(lambda it: _shared_contents(it, window, gram, *sent.value), _CONTENTS)


def _joined_contents(slim: DataFrame, anchors: DataFrame, window: int, gram: int, wide: int) -> DataFrame:
    """The same by joins: places with anchors, then texts with their places."""
    total = anchors.agg(F.sum("all")).first()[0] or 0
    every = slim.mapInArrow(lambda it: _places(it, window, gram), "anchor long, id long, key long, first long, windows int")
    places = join_keyed(every, anchors.withColumn("times", F.col("all")), "anchor", "all", total)
    salts = F.ceil(F.col("times") / F.lit(wide)).cast("long")
    places = places.withColumn("salts", salts).withColumn("salt", F.pmod(F.xxhash64("id", "first"), F.col("salts")))
    wanted = places.groupBy("id", "key").agg(F.collect_set(F.struct("anchor", "salt", "salts", "first", "windows")).alias("wanted"))
    return slim.join(wanted, ["id", "key"]).select("id", "key", "text", "wanted").mapInArrow(lambda it: _contents(it, window), _CONTENTS)


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, wide: int = WIDE, with_text: bool = False, most_sent: int = MOST_SENT) -> DataFrame:
    """A row for each row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, as bytes).

    A byte goes if a string of ``window`` bytes that covers it also starts earlier: in a smaller doc_id, or in the same one
    nearer to the beginning. Rows that share a doc_id are one document in that order, so a repeated row takes nothing from its
    twin. A null doc_id counts as the largest. A null text is empty; texts under ``window`` bytes stay whole, very long ones are
    read whole; an empty table gives no rows; other columns are not looked at. ``gram`` is brought within the window.
    """
    if window < 1 or wide < 1:
        raise ValueError("window and wide have to be positive")
    gram = min(gram, window)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumns({"id": F.coalesce("doc_id", F.lit((1 << 63) - 1)), "key": F.xxhash64("doc_id", "text")})
    slim = own.select("id", "key", "text")

    anchors = slim.mapInArrow(lambda it: _anchors(it, window, gram), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("all"))
    anchors = cut_lineage(anchors.where("all >= 2"))
    n = anchors.count()
    contents = _sent_contents(slim, anchors, n, window, gram, wide) if n <= most_sent else _joined_contents(slim, anchors, window, gram, wide)
    marks = contents.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "id", "key", "first").mapInArrow(lambda it: _marked(it, window, COLLECTION_BYTES), _MARKS)
    path = f"{shared_folder(docs.sparkSession)}/marks-{uuid.uuid4().hex}"
    marks.write.parquet(path)  # a fifth of a checkpoint's size
    marks = docs.sparkSession.read.parquet(path)

    open_ones = marks.where("anchor is not null")
    earliest = open_ones.groupBy("anchor", "h1", "h2").agg(F.min(F.struct("id", "low")).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    late = open_ones.join(earliest, ["anchor", "h1", "h2"]).where(F.struct("id", "low") > F.col("least"))
    found = marks.where("anchor is null").select("id", "key", "low", "high").unionByName(late.select("id", "key", "low", "high"))
    found = found.groupBy("id", "key").agg(F.collect_set(F.struct("low", "high")).alias("found"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return own.join(found, ["id", "key"], "left").select("doc_id", "text", "found").mapInArrow(lambda it: _removed(it, window, with_text), out)
