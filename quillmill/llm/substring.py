"""Removal of word spans that occur elsewhere, by suffix automata over shards of the shared reference.

A window of ``WINDOW`` words is repeated if its words also start anywhere else. The reference is the corpus
itself, so it is first cut down to what can repeat, without losing a link, and then sharded:

1. The windows of a document fall into stretches that share their least ``GRAM``-word hash, their
   anchor. Equal windows have equal anchors wherever they are. Anchors are counted; those that occur once
   can't hold a repeated window. What stays are the places of shared stretches ("regions"), as hashes.
2. The words of each distinct shared region, however often it occurs, are the reference, each with the number of
   its places. Regions that are alone around their anchor (copies of one another) make up shards where their
   words are read; the others are dealt out by anchor. An anchor with more than ``WIDE`` different regions is
   salted over several shards.
3. A shard is a suffix automaton with occurrence counts. Regions stream through it, and the windows are
   marked whose matching statistic reaches the threshold in a state that occurs at least twice. What a salted
   shard saw once is merged with the counts of the anchor's other shards.
4. The marks go back to all places of their regions, where the maximal spans they cover are removed.

Only the counts of the hottest anchors and marks of the hottest regions are broadcast (see ``join_keyed``): an automaton
of the corpus has no size bound, and broadcasting its shards one by one costs a pass over all documents for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import as_bytes, slices
from quillmill.llm.words import gram_hashes, regions, word_hashes
from quillmill.operators.skew import join_keyed
from quillmill.session import cut_lineage

WINDOW = 35
GRAM = 8
#: Different regions around one anchor in a shard; more are salted over several shards.
WIDE = 512
#: Words that one automaton holds, unless a single shard of an anchor is more.
AUTOMATON_WORDS = 40_000
#: Bytes of text that are hashed or cut at a time; hashing takes some forty times as much.
SLICE_BYTES = 1 << 20


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of word hashes, with weighted occurrence counts."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]

    def _clone(self, p: int, q: int, word: int) -> int:
        clone = len(self.next)
        self.next.append(self.next[q].copy())
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.count.append(0)
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list[int], weight: int = 1) -> None:
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for word in words:
            q = nxt[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, q, word)
                count[last] += weight
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            count.append(weight)
            p = last
            while p >= 0 and word not in nxt[p]:
                nxt[p][word] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][word]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, word)
            last = cur

    def close(self) -> None:
        """Add each state's occurrences to the states of its shorter suffixes."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def window_states(self, words: list[int], window: int) -> list[int]:
        """The state of each window, or 0 if it isn't in the reference: matching statistics cut off at ``window``."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        out = []
        for j, word in enumerate(words):
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            if word in nxt[state]:
                state = nxt[state][word]
                matched += 1
            while length[link[state]] >= window:
                state = link[state]
            if j >= window - 1:
                out.append(state if matched >= window else 0)
        return out


def _automaton(held: list[tuple[int, list[int]]]) -> SuffixAutomaton:
    """Of weighted word sequences."""
    automaton = SuffixAutomaton()
    for n, words in held:
        automaton.add(words, n)
    automaton.close()
    return automaton


def _anchors(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Anchors of each slice with their counts."""
    for part in slices(batches, 4096, SLICE_BYTES):
        _, _, _, anchor, _, _ = regions([t or b"" for t in as_bytes(part.column("text"))], window, gram)
        distinct, n = np.unique(anchor, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(n.astype(np.int64))], ["anchor", "n"])


def _places(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Every region of every document."""
    for part in slices(batches, 4096, SLICE_BYTES):
        ids, keys = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "key"))
        text, first, last, anchor, region, _ = regions([t or b"" for t in as_bytes(part.column("text"))], window, gram)
        columns = (anchor.view(np.int64), region.view(np.int64), ids[text], keys[text], first.astype(np.int32), last.astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "region", "id", "key", "first", "last"])


_CONTENTS = (("anchor", pa.int64()), ("region", pa.int64()), ("n", pa.int64()), ("salt", pa.int64()), ("salts", pa.int64()), ("mark", pa.int64()), ("words", pa.binary()))


def _contents(batches: Iterator[pa.RecordBatch], window: int, budget: int) -> Iterator[pa.RecordBatch]:
    """Words of the wanted regions; those alone around their anchor are matched here, in shards of the rows at hand.

    Neighbouring ones of these that occur equally often are one sequence of the reference: every window of it is in
    exactly one of them.
    """
    alone: list[tuple[int, list[int], list[dict]]] = []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(_CONTENTS)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _CONTENTS, strict=True)], [n for n, _ in _CONTENTS])

    def matched() -> pa.RecordBatch:
        automaton = _automaton([(n, words) for n, words, _ in alone])
        count, rows = automaton.count, []
        for n, words, parts in alone:
            twice = [count[state] >= 2 for state in automaton.window_states(words, window)]
            for w in parts:
                at = w["first"] - parts[0]["first"]
                mark = sum(1 << i for i, yes in enumerate(twice[at : at + w["last"] - w["first"] + 1]) if yes)
                rows.append((w["anchor"], w["region"], n, 0, 1, mark, None))
        alone.clear()
        return batch_of(rows)

    size, before = 0, None
    for part in slices(batches, 256, SLICE_BYTES):
        rows = []
        for row, text, wanted in zip(zip(part.column("id").to_pylist(), part.column("key").to_pylist(), strict=True), as_bytes(part.column("text")), part.column("wanted").to_pylist(), strict=True):
            if row == before:
                continue  # a repeated row; those that aren't neighbours are told apart where they meet
            before = row
            words = word_hashes(text or b"")
            run: list[dict] = []
            for w in [*sorted(wanted, key=lambda w: w["first"]), None]:
                if run and not (w and w["alone"] and w["n"] == run[0]["n"] and w["first"] == run[-1]["last"] + 1):
                    alone.append((run[0]["n"], words[run[0]["first"] : run[-1]["last"] + window].tolist(), run))
                    size += len(alone[-1][1])
                    run = []
                if w and w["alone"]:
                    run.append(w)
                elif w:
                    rows.append((w["anchor"], w["region"], w["n"], w["salt"], w["salts"], None, words[w["first"] : w["last"] + window].tobytes()))
            if size >= budget:
                yield matched()
                size = 0
        yield batch_of(rows)
    if alone:
        yield matched()


_PAIR = pa.struct([("i", pa.int32()), ("h", pa.int64())])
_COUNT = pa.struct([("h", pa.int64()), ("c", pa.int64())])
_MARKS = (("anchor", pa.int64()), ("region", pa.int64()), ("n", pa.int64()), ("mark", pa.int64()), ("single", pa.list_(_PAIR)), ("often", pa.list_(_COUNT)))


def _match(batches: Iterator[pa.RecordBatch], window: int, budget: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, salt and region: an automaton over whole anchors' regions (or one salt of them) at a time.

    Regions that are marked already pass through. A salted shard adds what the other shards of the anchor need: the windows it saw once, for each region, and
    those it saw more often, once each with their count.
    """

    def flush() -> pa.RecordBatch:
        automaton = _automaton([(w["n"], words) for w, words in held])
        count, rows, told = automaton.count, [(w["anchor"], w["region"], w["n"], w["mark"], [], []) for w in marked], set()
        for w, words in held:
            states = automaton.window_states(words, window)
            mark = sum(1 << i for i, state in enumerate(states) if count[state] >= 2)
            single, often = [], []
            if w["salts"] > 1:
                hashes = gram_hashes(np.array(words, np.uint64), window).view(np.int64).tolist()
                for i, (state, h) in enumerate(zip(states, hashes, strict=True)):
                    if count[state] < 2:
                        single.append({"i": i, "h": h})
                    elif state not in told:
                        told.add(state)
                        often.append({"h": h, "c": count[state]})
            rows.append((w["anchor"], w["region"], w["n"], mark, single, often))
        held.clear()
        marked.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _MARKS, strict=True)], [n for n, _ in _MARKS])

    held: list[tuple[dict, list[int]]] = []
    marked: list[dict] = []
    size, shard, region = 0, None, None
    for batch in batches:
        for row in batch.to_pylist():
            here = (row["anchor"], row["salt"])
            if here == shard and row["region"] == region:
                continue  # of a repeated row
            if here != shard and (size >= budget or len(marked) >= budget):
                yield flush()
                size = 0
            shard, region = here, row["region"]
            if row["words"] is None:
                marked.append(row)
                continue
            held.append((row, np.frombuffer(row["words"], np.uint64).tolist()))
            size += len(held[-1][1])
    if held or marked:
        yield flush()


def _covered(n: int, first: np.ndarray, last: np.ndarray, mark: np.ndarray, window: int) -> np.ndarray:
    """Which of n words a marked window covers."""
    edge = np.zeros(n + 1, np.int64)
    full = mark == (np.int64(1) << (last - first + 1)) - 1  # the windows of a stretch run on without a gap
    low, high = first[full], last[full] + window
    if not full.all():
        partial = [a + i for a, b, m in zip(first[~full].tolist(), last[~full].tolist(), mark[~full].tolist(), strict=True) for i in range(b - a + 1) if m >> i & 1]
        low, high = np.concatenate([low, partial]).astype(np.int64), np.concatenate([high, np.array(partial, np.int64) + window]).astype(np.int64)
    edge += np.bincount(low, minlength=n + 1) - np.bincount(high, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _remove(batches: Iterator[pa.RecordBatch], window: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text
    for part in slices(batches, 512, SLICE_BYTES):
        rows: list[list] = [[], [], [], []]
        lists = part.column("found")
        sizes = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
        first, last, mark = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists.flatten().flatten())
        ends = np.cumsum(sizes)
        for text, a, b in zip(as_bytes(part.column("text")), (ends - sizes).tolist(), ends.tolist(), strict=True):
            words = (text or b"").split()
            n = len(words)
            if a < b:
                gone = _covered(n, first[a:b], last[a:b], mark[a:b], window)
                words = list(compress(words, (~gone).tolist()))
            kept = b" ".join(words)
            for column, value in zip(rows, (n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None), strict=True):
                column.append(value)
        columns = [part.column("doc_id"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())]
        yield pa.RecordBatch.from_arrays(columns + [pa.array(rows[3], pa.string())] * with_text, names)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, wide: int = WIDE, with_text: bool = False) -> DataFrame:
    """A row for each row: ``doc_id, n_words, n_removed, kept_sha256`` (and ``kept``).

    Texts are judged as they come in: every copy of a repeated window loses its words, the first one
    too. A null text has no words. Texts under ``window`` words stay whole, very long ones are read whole. Repeated rows
    repeat each other's windows; an empty table gives no rows; rows with a null doc_id are treated like any; other columns
    are not looked at. ``gram`` is brought within the window, and so near to it that a region's marks fit a long.
    """
    if window < 1 or wide < 1:
        raise ValueError("window and wide have to be positive")
    gram = max(min(gram, window), window - 62)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumns({"id": F.coalesce("doc_id", F.lit(0)), "key": F.xxhash64("doc_id", "text")})
    slim = own.select("id", "key", "text")

    anchors = slim.mapInArrow(lambda it: _anchors(it, window, gram), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("all"))
    anchors = cut_lineage(anchors.where("all >= 2"))
    total = anchors.agg(F.sum("all")).first()[0] or 0
    every = slim.mapInArrow(lambda it: _places(it, window, gram), "anchor long, region long, id long, key long, first int, last int")
    places = cut_lineage(join_keyed(every, anchors, "anchor", "all", total))

    # distinct regions, and how many there are around their anchor
    each = cut_lineage(places.groupBy("anchor", "region").agg(F.count("*").alias("n"), F.min(F.struct("id", "key", "first", "last")).alias("at")))
    around = each.groupBy("anchor").agg(F.count("*").alias("d"))
    facts = around.agg(F.sum("d").alias("d")).first()
    each = join_keyed(each, around.select("anchor", F.col("d").alias("rows"), "d"), "anchor", "rows", facts["d"] or 0)
    salts = F.ceil(F.col("d") / F.lit(wide)).cast("long")
    each = each.withColumns({"salts": salts, "salt": F.pmod("region", salts), "alone": F.col("d") == 1})

    # their words, each once
    wanted = each.groupBy("at.id", "at.key").agg(F.collect_list(F.struct("anchor", "region", "n", "salt", "salts", "alone", "at.first", "at.last")).alias("wanted"))
    contents = slim.join(wanted, ["id", "key"]).select("id", "key", "text", "wanted").mapInArrow(
        lambda it: _contents(it, window, AUTOMATON_WORDS), "anchor long, region long, n long, salt long, salts long, mark long, words binary"
    )
    matched = contents.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "region").mapInArrow(
        lambda it: _match(it, window, AUTOMATON_WORDS),
        "anchor long, region long, n long, mark long, single array<struct<i:int,h:long>>, often array<struct<h:long,c:long>>",
    )
    matched = cut_lineage(matched)
    single = matched.select("anchor", "region", "n", F.explode("single").alias("x")).select("anchor", "region", "n", "x.i", "x.h")
    often = matched.select("anchor", F.explode("often").alias("x")).select("anchor", "x.h", "x.c").unionByName(single.select("anchor", "h", F.lit(1).cast("long").alias("c")))
    often = often.groupBy("anchor", "h").agg(F.sum("c").alias("c")).where("c >= 2").select("anchor", "h")
    merged = single.join(often, ["anchor", "h"]).select("anchor", "region", "n", F.expr("shiftleft(1L, i)").alias("mark"))
    marks = matched.where("mark != 0").select("anchor", "region", "n", "mark").unionByName(merged)
    marks = marks.groupBy(F.struct("anchor", "region").alias("at")).agg(F.max("n").alias("n"), F.bit_or("mark").alias("mark"))
    marks = cut_lineage(marks)

    total = marks.agg(F.sum("n")).first()[0] or 0
    found = join_keyed(places.select(F.struct("anchor", "region").alias("at"), "id", "key", "first", "last"), marks, "at", "n", total)
    found = found.groupBy("id", "key").agg(F.collect_set(F.struct("first", "last", "mark")).alias("found"))
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return own.join(found, ["id", "key"], "left").select("doc_id", "text", "found").mapInArrow(lambda it: _remove(it, window, with_text), out)


#: The same by comparing every window's words.
REPEATS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
t AS (SELECT r, len(w) AS n, unnest(w) AS v, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT r, p, n, md5(string_agg(v, ' ') OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) AS h FROM t),
c AS (SELECT r, p, count(*) OVER (PARTITION BY h) AS times FROM k WHERE p <= n - 34),
g AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS p FROM c WHERE times > 1),
s AS (SELECT t.r, string_agg(t.v, ' ' ORDER BY t.p) AS kept, count(*) AS n_kept FROM t LEFT JOIN g ON t.r = g.r AND t.p = g.p WHERE g.r IS NULL GROUP BY t.r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(s.n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)
"""
