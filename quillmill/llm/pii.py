"""Personal-data spans by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Base spans of four kinds follow exact patterns and are always returned. Beyond them a candidate
scan proposes wider spans (obfuscated mail addresses, phones and cards in other shapes, secrets after
a keyword). On every candidate regex, gazetteer and context labelers vote for (1), against (0) or
abstain (2). The histogram of vote rows over the whole corpus, not a sample, feeds expectation-
maximisation of a two-class model with a reliability table for each labeler; its posteriors then
train, as soft labels, a logistic classifier on span features that aren't votes (shape, length,
separators, surroundings). Base spans take part in both as anchors, so that EM knows which
class is personal. A candidate becomes a span if the classifier gives at least ``THRESHOLD``
and it overlaps no base span.

Everything is linear in the text: patterns start only where a match can start.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.9
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """As a leftmost scan for the whole pattern, but looking only around each @."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            free = m.end()
            yield "email", start, free
        else:
            free = at + 1
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[Span]:
    """The contract's spans: by kind as in KINDS, then start."""
    out = list(_emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


# -- candidates and labelers -------------------------------------------------------------------

#: Domain endings, words that announce personal data, words that announce other numbers.
ENDINGS = frozenset("com org net edu gov io info biz de fr es uk eu".split())
PERSONAL_WORDS = frozenset("phone tel telephone call mobile fax contact mail email e-mail card visa mastercard iban ssn account password token secret key telefon handy karte konto teléfono correo tarjeta téléphone courriel carte".split())
OTHER_WORDS = frozenset("version page pages isbn issn order no chapter section figure table build port seite página".split())

# whole runs, without any limit; possessive where no shorter run could match, so every pattern is linear
_OBFUSCATED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]++)+", re.I)
_NUMBER = re.compile(r"(?<![\w.@+-])[(]?[0-9]++(?:[\x20().-]{1,3}[0-9]++)*+")
_GLUED = re.compile(r"[\w@]")
_SECRET = re.compile(r"\b(?:token|secret|password|passwd|api_?key)\b[\"']?\x20{0,3}[=:]\x20{0,3}[\"']?([A-Za-z0-9_+/.-]{12,})", re.I)
_KEYWORD = re.compile(r"[A-Za-z_]+[\"']?\x20*[=:]\x20*[\"']?$")
_AT_WORD = re.compile(r"[\[( ]at[\]) ]", re.I)
_WORD_BEFORE = re.compile(r"[\w-]+")
N_LABELERS = 6


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Spans that may be personal beyond the base ones and overlap none of them."""
    found: list[Span] = []
    if _AT_WORD.search(text):
        found += [("email", m.start(), m.end()) for m in _OBFUSCATED.finditer(text)]
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            run = m.group()
            if _GLUED.match(text, m.end()):  # the last number belongs to a word
                run = run.rstrip("0123456789").rstrip(" ().-")
            digits = len(_DIGIT.findall(run))
            if 7 <= digits <= 19:
                found.append(("card" if digits >= 16 else "phone", m.start(), m.start() + len(run)))
    found += [("secret", *m.span(1)) for m in _SECRET.finditer(text)]
    if not found:
        return []
    taken = sorted((s, e) for _, s, e in base)
    out, last = [], -1
    starts = [s for s, _ in taken]
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        i = bisect.bisect_right(starts, s)
        clash = (i and taken[i - 1][1] > s) or (i < len(taken) and taken[i][0] < e)
        if not clash and s >= last:
            out.append((kind, s, e))
            last = e
    return out


def votes(text: str, span: Span) -> str:
    """One vote a labeler: 1 personal, 0 not, 2 abstains."""
    kind, s, e = span
    body = text[s:e]
    digits = "".join(_DIGIT.findall(body))
    said = text[max(0, s - 48) : s]
    if kind == "secret":
        said = _KEYWORD.sub("", said)  # it made the span a candidate, so it is no evidence of its own
    before = [w.lower() for w in _WORD_BEFORE.findall(said)][-4:]
    after = text[e : e + 12].strip().lower()
    # regex labelers: the strict shape of the kind; a checksum or digit count
    shape = {
        "email": bool(re.search(r"@|[\[(]at[\])]", body, re.I)),
        "phone": bool(re.fullmatch(r"\+?[0-9 ]{0,4}\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|\+[0-9][0-9 ().-]+", body)),
        "card": bool(re.fullmatch(r"[0-9]{4}([ -]?[0-9]{4}){3,4}", body)),
        "ip": True,
        "secret": bool(re.fullmatch(r"[0-9a-fA-F]{32,}|(?=.*[0-9])(?=.*[A-Za-z]).{16,}", body)),
    }[kind]
    check = luhn(digits) if kind == "card" else (len(digits) in (10, 11) if kind == "phone" else None)
    # gazetteers: known domain endings; words that announce personal data or other numbers
    ending = re.split(r"[.\W]+", body.lower())[-1] if kind == "email" else ""
    named = [
        "1" if shape else "0",
        "2" if check is None else "1" if check else "0",
        "2" if kind != "email" else "1" if ending in ENDINGS else "0",
        "1" if PERSONAL_WORDS & set(before) else "2",
        "0" if OTHER_WORDS & set(before[-2:]) else "2",
        # context: an equation, a unit or a percentage after it speaks against; a label with a colon for
        "0" if after[:1] in ("%", "=", "*", "/") else "1" if text[max(0, s - 2) : s].strip() in (":", '"', "=") else "2",
    ]
    return "".join(named)


def features(text: str, span: Span) -> tuple[int, ...]:
    """Small categorical description of a span that shares nothing with the votes' outcomes."""
    kind, s, e = span
    body = text[s:e]
    digits = len(_DIGIT.findall(body))
    return (
        ("email", "ip", "card", "phone", "secret").index(kind),
        min(7, digits // 3),
        min(7, (e - s) // 6),
        int(" " in body) + 2 * int("-" in body) + 4 * int("." in body),
        int("(" in body) + 2 * int("@" in body),
        int(s > 0 and text[s - 1].isalnum()) + 2 * int(e < len(text) and text[e].isalnum()),
        int("\n" in text[max(0, s - 3) : s] or s == 0),
    )


FEATURE_SIZES = (5, 8, 8, 8, 4, 4, 2)


def _pattern(text: str, span: Span, base: bool) -> str:
    return f"{int(base)}{votes(text, span)}:{'.'.join(map(str, features(text, span)))}"


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        found: dict[str, int] = {}
        for text in part.column("text").to_pylist():
            if text:
                base = base_spans(text)
                for is_base, spans in ((True, base), (False, candidates(text, base))):
                    for span in spans:
                        key = _pattern(text, span, is_base)
                        found[key] = found.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["pattern", "n"])


@dataclass(frozen=True)
class SpanModel:
    """reliability[l, class, vote]; prior of the personal class; logistic weights over one-hot features."""

    reliability: np.ndarray
    prior: float
    weights: np.ndarray

    def probability(self, span_features: tuple[int, ...]) -> float:
        return float(1 / (1 + np.exp(-self.weights @ _one_hot([span_features])[0])))


def _one_hot(rows: list[tuple[int, ...]]) -> np.ndarray:
    x = np.zeros((len(rows), sum(FEATURE_SIZES) + 1))
    x[:, -1] = 1
    at = 0
    for k, size in enumerate(FEATURE_SIZES):
        x[np.arange(len(rows)), at + np.array([r[k] for r in rows], int)] = 1
        at += size
    return x


def expectation_maximisation(vote_rows: np.ndarray, counts: np.ndarray, anchored: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of the personal class for each vote row, reliabilities and prior.

    vote_rows (n, labelers) of 0/1/2, counts (n,), anchored (n,): rows of the base patterns, kept personal.
    Starts from the majority of the votes; counts are smoothed by one vote each way.
    """
    post = np.where(anchored, 0.999, ((vote_rows == 1).sum(1) + 0.5) / ((vote_rows != 2).sum(1) + 1.0))
    table = np.full((vote_rows.shape[1], 2, 3), 1 / 3)
    prior = 0.5
    for _ in range(rounds):
        for c, share in enumerate((1 - post, post)):
            for v in range(3):
                table[:, c, v] = ((vote_rows == v) * (share * counts)[:, None]).sum(0) + 1
        table /= table.sum(2, keepdims=True)
        prior = float((post * counts).sum() + 1) / (counts.sum() + 2)
        logit = np.full(len(counts), np.log(prior / (1 - prior)))
        for k in range(vote_rows.shape[1]):
            logit += np.log(table[k, 1, vote_rows[:, k]] / table[k, 0, vote_rows[:, k]])
        new = np.where(anchored, 0.999, 1 / (1 + np.exp(-np.clip(logit, -30, 30))))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post, table, prior


def fit(docs: DataFrame) -> SpanModel:
    """Count vote-and-feature patterns over all documents, then EM and the classifier on the counts.

    The number of patterns is bounded by the product of vote and feature values, not by the
    corpus. No candidate at all gives a model that adds no span.
    """
    rows = (
        docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_patterns, "pattern string, n long")
        .groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    )
    width = sum(FEATURE_SIZES) + 1
    if not rows:
        return SpanModel(np.full((N_LABELERS, 2, 3), 1 / 3), 0.0, np.append(np.zeros(width - 1), -30.0))
    counts = np.array([r["n"] for r in rows], float)
    vote_rows = np.array([[int(v) for v in r["pattern"][1 : 1 + N_LABELERS]] for r in rows])
    anchored = np.array([r["pattern"][0] == "1" for r in rows])
    post, table, prior = expectation_maximisation(vote_rows, counts, anchored)
    x = _one_hot([tuple(map(int, r["pattern"].split(":")[1].split("."))) for r in rows])
    w = np.zeros(width)
    weight = counts / counts.sum()
    for _ in range(40):  # Newton steps on the weighted log-loss with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - post)) + 1e-4 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(width)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return SpanModel(table, prior, w)


def added_spans(text: str, base: list[Span], model: SpanModel, threshold: float = THRESHOLD) -> list[Span]:
    return [s for s in candidates(text, base) if model.probability(features(text, s)) >= threshold]


def mask(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind; spans that overlap become one mark of the first kind."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"|||{kind.upper()}|||"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _said(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_ORDER = {k: i for i, k in enumerate((*KINDS, "secret"))}


def find_personal_data(docs: DataFrame, model: SpanModel | None = None, with_masked: bool = False) -> DataFrame:
    """A row for each row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added (and masked).

    The n_ columns and base_sha256 state the base spans; spans lists these and the added ones by kind,
    then start, in code points with exclusive ends. Base spans of different kinds may overlap and are all listed;
    added ones overlap none, and of two candidates that do the earlier, then the longer, is kept. A null text counts
    as empty (masked: stays null). Repeated rows each come back; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs) if model is None else model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"] + ["masked"] * with_masked
        for part in slices(batches):
            counts, shas, said, more, masked = {k: [] for k in KINDS}, [], [], [], []
            for text in part.column("text").to_pylist():
                base = base_spans(text) if text else []
                extra = added_spans(text, base, shared.value) if text else []
                every = sorted(base + extra, key=lambda x: (_ORDER[x[0]], x[1]))
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in base))
                shas.append(hashlib.sha256(_said(base).encode()).hexdigest())
                said.append(_said(every))
                more.append(len(extra))
                if with_masked:
                    masked.append(mask(text, every) if every else text)
            columns = [part.column("doc_id"), *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(shas), pa.array(said, pa.string()), pa.array(more, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(masked, pa.string())] * with_masked, names)

    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id long, {kinds}, base_sha256 string, spans string, n_added long" + ", masked string" * with_masked
    )


def mask_documents(docs: DataFrame, model: SpanModel | None = None, text: str = "text") -> DataFrame:
    """The same rows and columns with every found span masked in the text.

    Null and empty texts stay as they are, repeated rows stay repeated, columns may have any name, and an
    empty table gives no rows. Spans that overlap become one mark (see ``mask``).
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs) if model is None else model)
    columns = docs.columns
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text=text):
            out = []
            for value in part.column(at).to_pylist():
                base = base_spans(value) if value else []
                every = base + added_spans(value, base, shared.value) if value else []
                out.append(mask(value, every) if every else value)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else part.column(i) for i in range(len(columns))], columns)

    return docs.mapInArrow(run, docs.schema)
