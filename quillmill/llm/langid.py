"""Language identification by nearest clustered centroid of TF-IDF byte n-gram vectors.

A text is lower-cased, everything but letters becomes one space, and its UTF-8 byte 2-, 3- and
4-grams are hashed into ``SPACE`` cells. Cell counts are damped (1 + ln), weighted by inverse document
frequency and normalised; centroids know the ``DIMS`` most common cells, and the weight of all other cells
counts in a text's norm, so what is foreign to the sample makes a text less like it. Each language has
several centroids, found by spherical k-means among its sample, so unlike kinds of writing in one
language keep their own centre. The nearest centroid by cosine names the language.

A text is rejected where its cosine is below what held-back texts of that language and length reach:
the sample is dealt into ``FOLDS`` parts, each is compared with a model of the others, and the radius is
a low quantile. A piece cut from each sampled text for each short band gives short texts a radius too.

Fitting reads a bounded sample: at most ``MAX_SAMPLE`` labelled texts in all, split evenly over the
languages and chosen by hash. Fitting and prediction read whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import slices
from quillmill.session import cut_lineage

SPACE = 1 << 20
DIMS = 1 << 15
MAX_SAMPLE = 2400
CLUSTERS = 4
#: Bounds of the length bands (n-grams in a text) that have rejection radii of their own.
BANDS = (0, 16, 64, 256, 1024, 4096, 16384, 1 << 62)
#: Letters of the pieces cut from sampled texts, one for each of the short bands.
PIECES = (4, 12, 48, 200)
FOLDS = 3
#: The share of held-back texts that lies below a quantile, the share of that similarity that is still accepted, and the texts that a band needs for a radius of its own.
QUANTILE, SLACK, LEAST = 0.01, 0.7, 20
#: Least radius: no text without any likeness is accepted.
FLOOR = 0.02
UNDETERMINED = "und"
_RUNS = re.compile(r"[^\W\d_]+")
_CHUNK = 1 << 20


def _letters(text: str) -> str:
    """Lower-case runs of letters, apart by one blank; number signs such as one half or a raised two are no letters."""
    out: list[str] = []
    for word in text.lower().split():
        if word.isalpha():
            out.append(word)
        else:
            runs = _RUNS.findall(word)
            out += runs if "".join(runs).isalpha() else "".join([c if c.isalpha() else " " for c in word]).split()
    return " ".join(out)


def _grams(norm: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Cells of hashed byte n-grams, ascending, and their counts; None without a letter."""
    if not norm:
        return None
    data = np.frombuffer(f" {norm} ".encode(), np.uint8)
    counts = None
    for at in range(0, max(1, len(data) - 1), _CHUNK):  # overlapping pieces, so that no n-gram is lost
        b = data[at : at + _CHUNK + 3].astype(np.uint32)
        two = (b[:-1] << np.uint32(8)) | b[1:]
        keys = []
        for width, gram in ((2, two), (3, (two[:-1] << np.uint32(8)) | b[2:]), (4, (two[:-2] << np.uint32(16)) | two[2:])):
            own = gram[: _CHUNK]
            keys.append(((own * np.uint32(2654435761) + np.uint32(width * 0x3C6EF372)) * np.uint32(0x85EBCA6B)) >> np.uint32(12))
        keys = np.concatenate(keys)
        if len(data) <= 1 << 15:
            return np.unique(keys, return_counts=True)
        counts = np.bincount(keys, minlength=SPACE) + (0 if counts is None else counts)
    cells = np.flatnonzero(counts)
    return cells, counts[cells]


def _pieces(norm: str) -> list[str]:
    """A run of whole words of about each of the lengths in PIECES, from the middle of the text; long texts have all."""
    out = []
    for n in PIECES:
        if len(norm) >= 2 * n:
            start = norm.find(" ", len(norm) // 2) + 1
            end = norm.find(" ", start + n)
            out.append(norm[start : end if end > 0 else len(norm)])
    return out


def held_out(doc_id: Column) -> Column:
    """Documents whose crc32 of the id as text leaves remainder 1 by 3 are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed counts of each text (piece 0) and of the pieces cut from it."""
    names = ["lang", "key", "piece", "cells", "counts"]
    for part in slices(batches, 64):
        rows = []
        for name, key, text in zip(*(part.column(c).to_pylist() for c in ("lang", "key", "text")), strict=True):
            norm = _letters(text or "")
            for i, one in enumerate([norm, *_pieces(norm)]):
                if (c := _grams(one)) is not None:
                    rows.append((name, key, i, c[0].astype("<i4").tobytes(), c[1].astype("<i4").tobytes()))
        if rows:
            types = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names)


@dataclass(frozen=True)
class LanguageModel:
    """languages[k], for centroid k; place: a cell's column, or -1; idf: by column, last that of other cells; centroids: unit rows; radii: least similarity by language and band."""

    languages: tuple[str, ...]
    place: np.ndarray
    idf: np.ndarray
    centroids: np.ndarray
    radii: dict

    def vector(self, cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns and weights of a text; cells without a column count in the norm."""
        at = self.place[cells]
        x = (1 + np.log(counts, dtype=np.float32)) * self.idf[at]
        return at[at >= 0], x[at >= 0] / max(float(np.sqrt(x @ x)), 1e-12)

    def nearest(self, cells: np.ndarray, counts: np.ndarray) -> tuple[int, float]:
        at, x = self.vector(cells, counts)
        sims = x @ self.centroids[at]
        return int(sims.argmax()), float(min(1.0, max(0.0, sims.max())))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [(UNDETERMINED, 0.0, True)] * len(texts)
        if not self.languages:
            return out
        for i, text in enumerate(texts):
            if text and (c := _grams(_letters(text))) is not None:
                k, score = self.nearest(*c)
                lang = self.languages[k]
                out[i] = (lang, round(score, 6), score < self.radii[lang][_band(c[1].sum())])
        return out


def _band(n: int) -> int:
    return int(np.searchsorted(BANDS, n, side="right")) - 1


def _cluster(rows: list[tuple[np.ndarray, np.ndarray]], dims: int, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means over sparse unit rows of ``(columns, weights)``, with farthest-first seeding; deterministic."""
    rows = [r for r in rows if len(r[0])]
    if not rows:
        return np.zeros((1, dims), np.float32)
    at, weight = (np.concatenate(x) for x in zip(*rows, strict=True))
    sizes = np.array([len(a) for a, _ in rows])
    starts = np.cumsum(sizes) - sizes
    like = lambda centre: np.add.reduceat(centre[at] * weight, starts)

    def mean(chosen: np.ndarray) -> np.ndarray:
        of = np.repeat(chosen, sizes)
        return (np.bincount(at[of], weights=weight[of], minlength=dims) / max(1, chosen.sum())).astype(np.float32)

    unit = lambda centre: centre / max(float(np.linalg.norm(centre)), 1e-12)
    centres = [mean(np.ones(len(rows), bool))]
    while len(centres) < min(k, len(rows)):
        farthest = np.max([like(c) for c in centres], axis=0).argmin()
        seed = np.zeros(dims, np.float32)
        seed[rows[farthest][0]] = rows[farthest][1]
        centres.append(seed)
    for _ in range(rounds):
        centres = [unit(c) for c in centres]
        own = np.argmax([like(c) for c in centres], axis=0)
        centres = [mean(own == j) if (own == j).any() else c for j, c in enumerate(centres)]
    return np.stack([unit(c) for c in centres])


def _columns(seen: np.ndarray, texts: int) -> LanguageModel:
    """Columns and idf from the number of texts that have each cell; no centroids."""
    common = np.argsort(-seen, kind="stable")[:DIMS]
    common = np.sort(common[seen[common] > 0])
    place = np.full(SPACE, -1, np.int32)
    place[common] = np.arange(len(common))
    idf = (np.log((1 + texts) / (1 + np.append(seen[common], 0))) + 1).astype(np.float32)
    return LanguageModel((), place, idf, np.zeros((len(common), 0), np.float32), {})


def _with_centroids(model: LanguageModel, vectors: pa.Table, clusters: int) -> LanguageModel:
    """Centroids (cell by row) of ``lang, at, weight``, the texts' vectors in the model's columns."""
    names, centres = [], []
    langs = np.array(vectors.column("lang").to_pylist(), object)
    at, weight = vectors.column("at").to_pylist(), vectors.column("weight").to_pylist()
    for lang in sorted(set(langs.tolist())):
        own = [(np.frombuffer(at[i], "<i4"), np.frombuffer(weight[i], "<f4")) for i in np.flatnonzero(langs == lang)]
        c = _cluster(own, len(model.idf) - 1, clusters)
        names += [lang] * len(c)
        centres.append(c)
    return replace(model, languages=tuple(names), centroids=np.ascontiguousarray(np.concatenate(centres).astype(np.float32).T))


def _packed(part: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for i, (cells, n) in enumerate(zip(part.column("cells").to_pylist(), part.column("counts").to_pylist(), strict=True)):
        yield i, np.frombuffer(cells, "<i4"), np.frombuffer(n, "<i4")


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By fold: whole texts, and for each cell the number of those that have it."""
    counts: dict[int, np.ndarray] = {}
    texts: dict[int, int] = {}
    for part in batches:
        folds = part.column("fold").to_pylist()
        for i, cells, _ in _packed(part):
            own = counts.setdefault(folds[i], np.zeros(SPACE, np.int32))
            own[cells] += 1
            texts[folds[i]] = texts.get(folds[i], 0) + 1
    for fold, own in counts.items():
        cells = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([texts[fold]], pa.int64()), pa.array([cells.astype("<i4").tobytes()], pa.binary()), pa.array([own[cells].astype("<i4").tobytes()], pa.binary())], ["fold", "texts", "cells", "counts"])


def _vectors(batches: Iterator[pa.RecordBatch], model: LanguageModel) -> Iterator[pa.RecordBatch]:
    """Texts as unit vectors in the model's columns, of which there are at most ``DIMS``."""
    for part in batches:
        made = [model.vector(cells, n) for _, cells, n in _packed(part)]
        columns = [pa.array([x.astype(kind).tobytes() for x in values], pa.binary()) for values, kind in zip(zip(*made, strict=True), ("<i4", "<f4"), strict=True)] if made else [pa.array([], pa.binary())] * 2
        yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("key"), *columns], ["lang", "key", "at", "weight"])


def _likeness(batches: Iterator[pa.RecordBatch], models: list[LanguageModel]) -> Iterator[pa.RecordBatch]:
    """Band and similarity to its own language of each text and piece, by the model that hasn't seen its fold."""
    for part in batches:
        langs, folds = part.column("lang").to_pylist(), part.column("fold").to_pylist()
        rows = []
        for i, cells, n in _packed(part):
            model = models[folds[i]]
            own = np.array([x == langs[i] for x in model.languages], bool)
            if own.any():
                at, x = model.vector(cells, n)
                rows.append((langs[i], _band(n.sum()), float((x @ model.centroids[at])[own].max())))
        columns = zip(*rows, strict=True) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.float64()), strict=True)], ["lang", "band", "likeness"])


def _radii(likeness: dict[str, list[tuple[int, float]]]) -> dict:
    """From ``(band, similarity)`` of held-back texts; a band with few texts takes the radius of the nearest shorter one, else of a longer one."""
    out = {}
    for lang, found in likeness.items():
        own: list[float | None] = []
        for b in range(len(BANDS) - 1):
            sims = [sim for band, sim in found if band == b]
            own.append(SLACK * float(np.quantile(sims, QUANTILE)) if len(sims) >= LEAST else own[-1] if own else None)
        first = next((r for r in own if r is not None), FLOOR)
        out[lang] = [max(FLOOR, first if r is None else r) for r in own]
    return out


def fit(docs: DataFrame, clusters: int = CLUSTERS, max_sample: int = MAX_SAMPLE) -> LanguageModel:
    """Learn from text and non-null lang of documents that aren't held out.

    ``max_sample`` bounds the texts and so the languages, too: of more than that the most frequent ones are learnt. Texts are
    counted where they lie; the driver gets sums, and of each sampled text a vector of at most ``DIMS`` columns, however long the
    text is. A null doc_id isn't held out, repeated rows count each time; a table without a labelled text gives a model without
    a language.
    """
    known = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_sample).collect()}
    nothing = LanguageModel((), np.full(SPACE, -1, np.int32), np.ones(1, np.float32), np.zeros((0, 0), np.float32), {})
    if not counts:
        return nothing
    each = max(1, max_sample // len(counts))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.5 * each / n + 20 / n))])
    thin = known.where(place < rate[F.col("lang")])
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = thin.select("lang", "text", F.row_number().over(order).alias("_n")).where(F.col("_n") <= each)
    chosen = chosen.select("lang", F.xxhash64("text").alias("key"), "text")
    sample = chosen.mapInArrow(_sample_vectors, "lang string, key long, piece int, cells binary, counts binary")
    sample = cut_lineage(sample.withColumn("fold", F.pmod("key", F.lit(FOLDS)).cast("int")))  # copies of a text are in one fold
    whole = sample.where("piece = 0")
    seen, texts = np.zeros((FOLDS, SPACE), np.int32), np.zeros(FOLDS, np.int64)
    for row in whole.mapInArrow(_seen, "fold int, texts long, cells binary, counts binary").toLocalIterator():
        seen[row["fold"], np.frombuffer(row["cells"], "<i4")] += np.frombuffer(row["counts"], "<i4")
        texts[row["fold"]] += row["texts"]
    if not texts.any():
        return nothing
    context = docs.sparkSession.sparkContext

    def learn(rest: list[int]) -> LanguageModel:
        if not texts[rest].any():
            return nothing
        model = _columns(seen[rest].sum(axis=0), int(texts[rest].sum()))
        shared = context.broadcast(model)
        vectors = whole.where(F.col("fold").isin(rest)).mapInArrow(lambda it: _vectors(it, shared.value), "lang string, key long, at binary, weight binary")
        return _with_centroids(model, vectors.orderBy("lang", "key", "at", "weight").toArrow(), clusters)

    models = context.broadcast([learn([f for f in range(FOLDS) if f != fold]) for fold in range(FOLDS)])
    likeness: dict[str, list[tuple[int, float]]] = {r["lang"]: [] for r in sample.select("lang").distinct().collect()}
    for r in sample.mapInArrow(lambda it: _likeness(it, models.value), "lang string, band int, likeness double").collect():
        likeness[r["lang"]].append((r["band"], r["likeness"]))
    return replace(learn(list(range(FOLDS))), radii=_radii(likeness))


def identify(docs: DataFrame, model: LanguageModel, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` and ``carry`` columns, a row for each row.

    lang_pred is a learned language, or ``und`` if the text is null or has no letter (score 0, rejected).
    score is the cosine to the nearest centroid; of equally near ones the first by language name wins. rejected: too
    far from every centroid, or ``und``. Very long texts are read whole, piece by piece. With no labelled row every
    text is ``und``. Null doc_ids count as not held out. Repeated rows each come back; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"),
        *[F.col(c).alias(f"_carry_{c}") for c in carry],
    )

    kept = [c for c in slim.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 128):
            got = shared.value.predict(part.column("text").to_pylist())
            lang, score, rejected = zip(*got, strict=True)
            yield pa.RecordBatch.from_arrays(
                [*map(part.column, kept), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                [*kept, "lang_pred", "score", "rejected"],
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != "text"]
    out = slim.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double", "rejected boolean"]))
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected", *[F.col(f"_carry_{c}").alias(c) for c in carry])


def identify_language(docs: DataFrame) -> DataFrame:
    """Fit on the labelled, not held-out documents and predict all of them."""
    return identify(docs, fit(docs))


def drop_rejected(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """The rows and columns of the documents that are not rejected.

    Null texts and such without a letter are rejected. Repeated rows stay together or go together; columns may have
    any name. An empty table, or one without a label to learn from, gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs) if model is None else model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 128):
            rejected = [x[2] for x in shared.value.predict(part.column(at).to_pylist())]
            yield part.filter(pa.array([not x for x in rejected], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
