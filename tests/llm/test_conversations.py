"""Conversation repair against a plain search over all edits."""

import hashlib
import itertools
import random
import zlib

import pytest

from quillmill.llm import conversations as conv

SCHEMA = "conv_id long, turn long, role string, text string, audit string, place int"


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def plain_damage(rows):
    out = {}
    for c, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        kept = out.setdefault(c, [])
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(x for x in text if x not in ".!?")
        if fate == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return {c: in_order(v) for c, v in out.items()}


def plain_report(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, hash of one conversation's rows; whole strings are kept at every place."""
    blank = duplicate = truncated = 0
    seen, flags = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        blank, duplicate, truncated = blank + (kind == "blank"), duplicate + (kind == "duplicate"), truncated + (kind == "truncated")
        flags.append(kind)
    follows = {("n", "s"): "s", ("n", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    def settle(best):
        """Insertions, as far as they pay."""
        queue = list(best.items())
        while queue:
            place, (cost, audit, out) = queue.pop()
            for i in "ua":
                to = follows.get((place, i))
                way = (cost + 2, audit + "I", [*out, f"{names[i]}:"])
                if to and (to not in best or way[:2] < best[to][:2]):
                    best[to] = way
                    queue.append((to, way))
        return best

    best = settle({"n": (0, "", [])})
    for (_, role, text), kind in zip(rows, flags, strict=True):
        new = {}

        def offer(place, way, new=new):
            if place and (place not in new or way[:2] < new[place][:2]):
                new[place] = way

        for place, (cost, audit, out) in best.items():
            offer(place, (cost + 3, audit + "D", out))
            if kind in ("", "truncated"):
                more = kind == "truncated"
                offer(follows.get((place, role[:1])), (cost + more, audit + "K", [*out, f"{role}:{text}"]))
                for i in "ua":
                    offer(follows.get((place, i)), (cost + more + 2, audit + "R", [*out, f"{names[i]}:{text}"]))
        best = settle(new)
    cost, audit, out = min(best[p] for p in "na" if p in best)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def planted(seed, n, most):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "So it is!", "  ", "", "Why?\n", "well ", None, "zwölf."]
    rows = []
    for c in [*range(n), None]:
        for turn in range(rng.randint(1, most)):
            rows.append((c, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 1, 7]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "User", "", None]), rng.choice(texts + [f"t{rng.random()}."] * 6)))
    return rows


@pytest.mark.parametrize(("chunk", "block"), [(64, 1024), (2, 4), (3, 1024)])
def test_against_plain_search(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(conv, "CHUNK", chunk)
    monkeypatch.setattr(conv, "BLOCK", block)
    rows = planted(chunk, 25, 14)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    want = {c: plain_report(plain_damage(rows).get(c, [])) for c in {r[0] for r in rows}}
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in conv.repair_report(conv.damage(df), df).collect()}
    assert got == want


def test_repaired_turns_keep_the_grammar(spark):
    rows = planted(5, 30, 9)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    report = {r["conv_id"]: r["repaired_sha256"] for r in conv.repair_report(df).collect()}
    turns = {}
    for r in conv.repair_turns(df).orderBy("place").collect():
        turns.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for c, digest in report.items():
        out = turns.get(c, [])
        initials = "".join(x[0] for x in out)
        assert hashlib.sha256("\n".join(out).encode()).hexdigest() == digest
        assert initials.lstrip("s") == "ua" * (len(initials.lstrip("s")) // 2) and initials.count("s") <= 1 and (initials != "s")


def test_one_conversation_of_very_many_repeated_rows(spark):
    df = spark.range(30_000).selectExpr("7L conv_id", "id % 3 turn", "if(id % 3 = 1, 'assistant', 'user') role", "concat('Turn ', id % 3, '.') text")
    row = conv.repair_report(df).first()
    assert (row["duplicate"], row["illegal"], row["gaps"]) == (29_997, 29_997, 0)
    assert row["cost"] == 3 * 29_997 + 2 and row["audit"].count("D") == 29_997 and row["audit"][0] == "K" and len(row["audit"]) == 30_001


def test_empty_and_dropped(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conv.repair_report(conv.damage(empty), empty).count() == 0 and conv.repair_turns(empty).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    row = conv.repair_report(conv.damage(df), df).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
