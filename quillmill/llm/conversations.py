"""Repair of conversations whose turns are broken: cheapest edits by a fold over sorted turns in Spark SQL.

1. Window functions flag each row's first fault: blank, duplicate (same role and text earlier), truncated. Repeated rows
   are counted before anything is shuffled, so a row that stands a million times is one row with a count.
2. Rows are sorted by turn and cut into chunks of at most ``CHUNK`` rows, so no array grows with a conversation.
3. ``aggregate()`` folds a chunk's turns. It carries four ``(cost, audit)`` structs, one for each place in the grammar
   ``(s?(ua)+)?``: nothing yet, after ``s``, after ``u``, after ``a``; ``least`` picks the cheaper edit, and of equally cheap
   ones the smaller audit. A conversation's first chunk starts with nothing; a later one is folded from each of the four.
4. Chunks are folded into groups of chunks in the same way, ``CHUNK`` at a time, until each conversation is one row.
5. The repaired turns stream past their conversation's audit in sorted order, which writes or hashes them.

Why the smaller of two equally cheap audits at one place may be settled at once: both have used the same rows, so neither
can continue the other without paying for an insertion more; they differ at a letter, which what follows can't change.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.session import cut_lineage

#: Turns in a chunk, and chunks in a group of chunks.
CHUNK = 64
#: Turn numbers that are sorted together before they are cut into chunks.
BLOCK = 1024
#: More than any edits cost.
NEVER = 1 << 60

INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
_PLACES = "nsua"  # nothing yet, after system, after user, after assistant


def damage(conversations: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text`` with a twentieth each dropped, emptied, cut off, repeated or given to the user.

    Which one is decided by ``crc32(conv_id:turn) % 20``. A null in what is hashed, in the role or in the text is one space;
    a null conv_id or turn stays null as a key. An empty table gives no rows.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"), (F.crc32(key) % 20).alias("_fate")
    ).where("_fate != 0")
    text = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fate") == 4, "user").otherwise(F.col("role"))
    again = F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_again")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), again).drop("_again")


def _flagged(rows: DataFrame) -> DataFrame:
    """Distinct rows in order: conversation, block, chunk, place, times, initial, faults."""
    own = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text")
    )
    counted = own.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("times"))
    before = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    counted = counted.withColumn("again", F.row_number().over(before) > 1).withColumn("block", F.floor(F.col("turn") / F.lit(BLOCK)).cast("long"))
    ordered = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    at = F.row_number().over(ordered) - 1
    return counted.select(
        "conv_id", "turn", "role", "text", "times", "block", at.alias("at"), F.floor(at / F.lit(CHUNK)).cast("long").alias("chunk"), F.substring("role", 1, 1).alias("initial"),
        blank.alias("blank"), (~blank & F.col("again")).alias("again"), (~blank & ~F.col("again") & cut).alias("cut"),
        (F.col("turn").isNotNull() & ~F.lag("turn").over(ordered).eqNullSafe(F.col("turn"))).alias("new_turn"),
    )


def _plus(pair: str, cost: str | int, letters: str) -> str:
    return f"named_struct('cost', {pair}.cost + {cost}, 'audit', concat({pair}.audit, {letters}))"


def _four(n: str, s: str, u: str, a: str) -> str:
    return f"named_struct('n', {n}, 's', {s}, 'u', {u}, 'a', {a})"


def _inserted(at: str) -> str:
    """Insertions wherever they lead on: to the user from every other place, to the assistant from the user."""
    user = f"least({at}.u, {', '.join(_plus(f'{at}.{p}', INSERT, "'I'") for p in 'nsa')})"
    return f"transform(array({user}), put -> {_four(f'{at}.n', f'{at}.s', 'put', f'least({at}.a, {_plus("put", INSERT, "'I'")})')})[0]"


def _edited(at: str) -> str:
    """One distinct row, kept, reroled or deleted; its repetitions are deleted."""
    gone = {p: _plus(f"{at}.{p}", f"{DELETE} * t.times", "repeat('D', int(t.times))") for p in _PLACES}
    more = f"{DELETE} * (t.times - 1) + if(t.cut, {TRUNCATED}, 0)"

    def stays(pair: str, initial: str) -> str:
        letter = f"concat(if(t.initial = '{initial}', 'K', 'R'), repeat('D', int(t.times - 1)))"
        return _plus(pair, f"{more} + if(t.initial = '{initial}', 0, {REROLE})", letter)

    user = f"least({gone['u']}, {stays(f'least({at}.n, {at}.s, {at}.a)', 'u')})"
    system = f"if(t.initial = 's', least({gone['s']}, {stays(f'{at}.n', 's')}), {gone['s']})"
    assistant = f"least({gone['a']}, {stays(f'{at}.u', 'a')})"
    return f"if(t.must_go, {_four(*(gone[p] for p in _PLACES))}, {_four(gone['n'], system, user, assistant)})"


def _start(places: str = _PLACES) -> str:
    """For each of the places, the four structs of a fold that starts there."""
    one = "named_struct('cost', bigint({}), 'audit', '')"
    return f"array({', '.join(_four(*(one.format(0 if p == q else NEVER) for q in _PLACES)) for p in places)})"


def _fold_chunk(turns: str, first: str) -> Column:
    step = f"transform(array({_inserted('acc')}), open -> {_edited('open')})[0]"
    return F.expr(f"transform(if({first}, {_start('n')}, {_start()}), start -> aggregate({turns}, start, (acc, t) -> {step}))")


def _fold_group(parts: str) -> Column:
    """Chunks one after the other: the cheapest way through each place between them."""

    def reach(place: str) -> str:
        ways = [f"named_struct('cost', acc.{p}.cost + m[{i}].{place}.cost, 'audit', concat(acc.{p}.audit, m[{i}].{place}.audit))" for i, p in enumerate(_PLACES)]
        return f"if(size(m) = 1, {ways[0]}, least({', '.join(w.replace('m[', 'm[if(size(m) = 1, 0, ').replace('].', ')].') for w in ways)}))"

    first = "transform(sequence(0, size({0}[0].ways) - 1), i -> {1}[i])".format(parts, _start())
    return F.expr(f"transform({first}, start -> aggregate(transform({parts}, x -> x.ways), start, (acc, m) -> {_four(*(reach(p) for p in _PLACES))}))")


_SUMS = ("blank", "duplicate", "truncated", "turns", "illegal")


def _illegal(parts: str, left: str, right: str) -> str:
    """Adjacent initials that may not stand side by side, between neighbouring elements of an array."""
    pair = f"concat({parts}[i].{left}, {parts}[i + 1].{right})"
    return f"aggregate(if(size({parts}) < 2, array(), sequence(0, size({parts}) - 2)), 0L, (k, i) -> k + if({pair} in ('su', 'ua', 'au'), 0, 1))"


def _chunks(flagged: DataFrame) -> DataFrame:
    """A row for each chunk: its ways through the grammar, its counts, its outer initials."""
    n = F.col("times")
    turn = F.struct("at", "initial", "times", "cut", (F.col("blank") | F.col("again")).alias("must_go"))
    chunks = flagged.groupBy("conv_id", "block", "chunk").agg(
        F.sort_array(F.collect_list(turn)).alias("rows"),
        F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("again"), n).otherwise(n - 1)).alias("duplicate"),
        F.sum(F.col("cut").cast("long")).alias("truncated"),
        F.sum(F.col("new_turn").cast("long")).alias("turns"),
        F.min("turn").alias("least"),
        F.max("turn").alias("most"),
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first(), "chunk")) - 1
    illegal = F.expr(f"{_illegal('rows', 'initial', 'initial')} + aggregate(rows, 0L, (k, t) -> k + t.times - 1)")
    return chunks.withColumn("place", place).select(
        "conv_id", "place", _fold_chunk("rows", "place = 0").alias("ways"), "blank", "duplicate", "truncated", "turns", illegal.alias("illegal"), "least", "most",
        F.expr("rows[0].initial").alias("head"), F.expr("element_at(rows, -1).initial").alias("tail"),
    )


def _grouped(parts: DataFrame) -> DataFrame:
    """Every ``CHUNK`` consecutive parts of a conversation as one."""
    part = F.struct("place", "ways", "head", "tail")
    groups = parts.groupBy("conv_id", F.floor(F.col("place") / F.lit(CHUNK)).cast("int").alias("place")).agg(
        F.sort_array(F.collect_list(part)).alias("parts"), *[F.sum(c).alias(c) for c in _SUMS], F.min("least").alias("least"), F.max("most").alias("most")
    )
    return groups.select(
        "conv_id", "place", _fold_group("parts").alias("ways"), "blank", "duplicate", "truncated", "turns",
        (F.col("illegal") + F.expr(_illegal("parts", "tail", "head"))).alias("illegal"), "least", "most",
        F.expr("parts[0].head").alias("head"), F.expr("element_at(parts, -1).tail").alias("tail"),
    )


def _verdicts(flagged: DataFrame) -> DataFrame:
    """A row for each conversation that has rows: counts, cost and audit."""
    parts = cut_lineage(_chunks(flagged))
    while (parts.agg(F.max("place")).first()[0] or 0) > 0:
        parts = cut_lineage(_grouped(parts))
    done = F.expr(f"transform(array({_inserted('ways[0]')}), w -> least(w.n, w.a))[0]")
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0))
    return parts.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", done.alias("done")).select("*", "done.*").drop("done")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _repaired(batches: Iterator[pa.RecordBatch], as_hash: bool, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Conversations one after the other: the row with the audit first, then the turns in order."""
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"] if as_hash else ["conv_id", "place", "role", "text", "edit"]
    types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()] if as_hash else [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
    out: list[tuple] = []
    head, at, place, odd, digest = None, 0, 0, 1, hashlib.sha256()

    def put(role: str, text: str, edit: str) -> None:
        nonlocal place, odd
        if place == 0 and role[:1] == "s":
            odd = 0
        if as_hash:
            digest.update((("\n" if place else "") + f"{role}:{text}").encode())
        else:
            out.append((head["conv_id"], place, role, text, edit))
        place += 1

    def wanted() -> str:
        return "user" if (place + odd) % 2 else "assistant"

    def inserted() -> None:
        nonlocal at
        while at < len(head["audit"]) and head["audit"][at] == "I":
            put(wanted(), "", "insert")
            at += 1

    def ended() -> None:
        if head is not None:
            inserted()
            if as_hash:
                out.append((head["conv_id"], *[head[c] for c in _COUNTS], head["audit"], digest.hexdigest()))

    def batch() -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * len(names)
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        out.clear()
        return made

    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            for row in whole.slice(start, 256).to_pylist():
                if row["audit"] is not None:
                    ended()
                    head, at, place, odd, digest = row, 0, 0, 1, hashlib.sha256()
                    continue
                for _ in range(row["times"]):
                    inserted()
                    letter = head["audit"][at]
                    at += 1
                    if letter == "K":
                        put(row["role"], row["text"], "keep")
                    elif letter == "R":
                        put(wanted(), row["text"], "rerole")
            yield batch()
    ended()
    yield batch()


def _streamed(rows: DataFrame, originals: DataFrame, as_hash: bool) -> DataFrame:
    flagged = cut_lineage(_flagged(rows))
    verdicts = _verdicts(flagged)
    kind = originals.schema["conv_id"].dataType
    heads = originals.select("conv_id").distinct().alias("o").join(verdicts.alias("v"), F.col("o.conv_id").eqNullSafe(F.col("v.conv_id")), "left").select(
        "o.conv_id", *[F.coalesce(f"v.{c}", F.lit(0)).cast("long").alias(c) for c in _COUNTS], F.coalesce("v.audit", F.lit("")).alias("audit")
    )
    both = heads.unionByName(flagged.select("conv_id", "block", "turn", "at", "role", "text", "times"), allowMissingColumns=True)
    # the audit first, then blocks, null first: their rows are in order
    order = [F.col("conv_id"), F.col("audit").isNull(), F.col("block").asc_nulls_first(), F.col("at")]
    named = dict(originals.dtypes)["conv_id"]
    out = f"conv_id {named}, " + (", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string" if as_hash else "place long, role string, text string, edit string")
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    return both.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(lambda it: _repaired(it, as_hash, arrow), out)


def repair_turns(rows: DataFrame) -> DataFrame:
    """The repaired turns: ``conv_id, place, role, text, edit`` (keep, rerole or insert), places counted from 0.

    Rows are taken by turn, nulls first, then by role and text. A null role or text is one space, a null conv_id is a
    conversation of its own; an inserted turn's text is empty; an empty table gives no rows. Other columns are not looked at.
    """
    return _streamed(rows, rows, False)


def repair_report(rows: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """A row for each conversation of ``originals`` (by default those of ``rows``): faults, edits and the repaired text's hash.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``. A row's first fault counts. Nulls
    and ties are taken as in ``repair_turns``. A conversation without rows has zeros, an empty audit and the hash of nothing.
    """
    return _streamed(rows, rows if originals is None else originals, True)


#: The same with a recursive walk from turn to turn.
REPAIR_SQL = r"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
f AS (SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::UBIGINT)), lambda c, b:
  list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT) % 20 AS fate FROM o),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE fate <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
  NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, left(role, 1) AS i FROM d),
q AS (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY p) || i AS pair FROM r),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
  count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM q GROUP BY conv_id),
w AS (
  SELECT conv_id, 0::BIGINT AS p, {'c': 0, 'a': '', 't': ''} AS n, {'c': 1000000, 'a': '', 't': ''} AS s, {'c': 1000000, 'a': '', 't': ''} AS u, {'c': 1000000, 'a': '', 't': ''} AS a FROM c
  UNION ALL
  SELECT conv_id, p, {'c': n.c + 3, 'a': n.a || 'D', 't': n.t},
    CASE WHEN stay AND i = 's' THEN least({'c': s.c + 3, 'a': s.a || 'D', 't': s.t}, {'c': n.c + t, 'a': n.a || 'K', 't': role || ':' || text || chr(10)}) ELSE {'c': s.c + 3, 'a': s.a || 'D', 't': s.t} END,
    CASE WHEN stay THEN least({'c': u.c + 3, 'a': u.a || 'D', 't': u.t}, {'c': least(n, s, a).c + t + CASE WHEN i = 'u' THEN 0 ELSE 2 END, 'a': least(n, s, a).a || CASE WHEN i = 'u' THEN 'K' ELSE 'R' END,
      't': least(n, s, a).t || CASE WHEN i = 'u' THEN role ELSE 'user' END || ':' || text || chr(10)}) ELSE {'c': u.c + 3, 'a': u.a || 'D', 't': u.t} END,
    CASE WHEN stay THEN least({'c': a.c + 3, 'a': a.a || 'D', 't': a.t}, {'c': u.c + t + CASE WHEN i = 'a' THEN 0 ELSE 2 END, 'a': u.a || CASE WHEN i = 'a' THEN 'K' ELSE 'R' END,
      't': u.t || CASE WHEN i = 'a' THEN role ELSE 'assistant' END || ':' || text || chr(10)}) ELSE {'c': a.c + 3, 'a': a.a || 'D', 't': a.t} END
  FROM (SELECT x.*, least(x.a0, {'c': x.u.c + 2, 'a': x.u.a || 'I', 't': x.u.t || 'assistant:' || chr(10)}) AS a, q.i, q.role, q.text, CASE WHEN q.cut THEN 1 ELSE 0 END AS t, NOT q.blank AND NOT q.again AS stay
    FROM (SELECT conv_id, p + 1 AS p, n, s, a AS a0, least(u, {'c': n.c + 2, 'a': n.a || 'I', 't': n.t || 'user:' || chr(10)}, {'c': s.c + 2, 'a': s.a || 'I', 't': s.t || 'user:' || chr(10)}, {'c': a.c + 2, 'a': a.a || 'I', 't': a.t || 'user:' || chr(10)}) AS u FROM w) x
    JOIN q ON q.conv_id IS NOT DISTINCT FROM x.conv_id AND q.p = x.p)
),
e AS (SELECT w.conv_id, least(n, a, {'c': u.c + 2, 'a': u.a || 'I', 't': u.t || 'assistant:' || chr(10)}, {'c': s.c + 4, 'a': s.a || 'II', 't': s.t || 'user:' || chr(10) || 'assistant:' || chr(10)},
  {'c': n.c + 4, 'a': n.a || 'II', 't': n.t || 'user:' || chr(10) || 'assistant:' || chr(10)}) AS z FROM w JOIN c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.rows = w.p)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  coalesce(e.z.c, 0)::BIGINT AS cost, coalesce(e.z.a, '') AS audit, sha256(coalesce(left(e.z.t, -1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
