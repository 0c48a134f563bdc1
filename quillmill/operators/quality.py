"""Rule-based quality metrics, gates and the first-failure filter cascade, all native."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import let, mask_pii
from quillmill.functions.tokens import treebank_tokens

#: ASCII white space, as \\s has it.
BLANKS = " \t\n\x0b\f\r"
#: Few matches each, and nothing to backtrack: a word without a letter between single blanks, dots that end a line.
_NO_LETTER, _ELLIPSIS = r" [^ \p{L}]++(?= )", r"\.\.\.[^\S\n]*+(?=\n|\z)"


def quality(text: Column) -> Column:
    """A struct of every metric and ``gopher_pass`` by the published bounds (all inclusive), from one run over the text.

    White space is brought to single blanks once; words, characters and lines are then differences of lengths, and only what
    is rare is matched. The struct is one expression, so no filter that is pushed down repeats the scans.
    """

    def count(t: Column, letter: str) -> Column:
        return (F.length(t) - F.length(F.replace(t, F.lit(letter), F.lit("")))).cast("long")

    def counted(words: Column) -> Column:
        n = F.when(words == "", F.lit(0).cast("long")).otherwise(count(words, " ") + 1)
        body = F.when(text.endswith("\n"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
        plain = F.regexp_count(F.concat(F.lit(" "), words, F.lit(" ")), F.lit(_NO_LETTER)).cast("long")
        lines = F.regexp_count(body, F.lit(_ELLIPSIS)).cast("long")
        return F.struct(n.alias("n"), F.length(F.replace(words, F.lit(" "), F.lit(""))).alias("chars"), F.when(n > 0, n - plain).otherwise(F.lit(0)).alias("alpha"), lines.alias("dotted"), (count(body, "\n") + 1).alias("lines"))

    def shared(q: Column) -> Column:
        share = lambda part, of: F.when(q[of] > 0, q[part] / q[of]).otherwise(F.lit(0.0))
        return F.struct(q["n"].alias("n_words"), share("chars", "n").alias("mean_word_len"), share("dotted", "lines").alias("ellipsis_ratio"), share("alpha", "n").alias("alpha_ratio"))

    return let(F.trim(F.regexp_replace(text, r"\s+", " ")), lambda words: let(counted(words), lambda q: let(shared(q), bounded)))


def token_quality(text: Column) -> Column:
    """The same struct over treebank tokens in place of words between blanks: marks count as words, and are short and without letters."""
    words = treebank_tokens(text)

    def judged(w: Column) -> Column:
        n = F.size(w).cast("long")
        share = lambda part: F.when(n > 0, part / n).otherwise(F.lit(0.0))
        by_blanks = quality(text)
        m = {
            "n_words": n, "mean_word_len": share(F.length(F.array_join(w, ""))), "ellipsis_ratio": by_blanks["ellipsis_ratio"],
            "alpha_ratio": share(F.size(F.filter(w, lambda x: x.rlike(r"\p{L}")))),
        }
        return let(F.struct(*[c.alias(k) for k, c in m.items()]), bounded)

    return let(words, judged)


def bounded(m: Column) -> Column:
    """The metrics, and whether they keep the published bounds."""
    good = m["n_words"].between(50, 100_000) & m["mean_word_len"].between(3.0, 10.0) & (m["ellipsis_ratio"] <= 0.3) & (m["alpha_ratio"] >= 0.8)
    return F.struct(*[m[c].alias(c) for c in METRICS], good.alias("gopher_pass"))


METRICS = ("n_words", "mean_word_len", "ellipsis_ratio", "alpha_ratio")


def with_quality(docs: DataFrame, text: str = "text", treebank: bool = False) -> DataFrame:
    """Every metric as a column, and ``gopher_pass``; a null text is empty. Words lie between blanks, or are treebank tokens."""
    scored = docs.withColumn("_quality", (token_quality if treebank else quality)(F.coalesce(F.col(text), F.lit(""))))
    return scored.withColumns({c: F.col(f"_quality.{c}") for c in (*METRICS, "gopher_pass")}).drop("_quality")


@dataclass(frozen=True)
class CascadePreset:
    """Thresholds of a cascade; the two presets differ at their edges on purpose."""

    min_chars: int = 50
    strip: bool = True
    language: str = "en"
    min_language_score: float = 0.65
    max_harm_score: float = 0.8
    harm_inclusive: bool = False
    min_quality_score: float = 0.0

    def too_short(self, text: Column) -> Column:
        if self.strip:
            return F.length(F.btrim(text, F.lit(BLANKS))) < self.min_chars
        return F.length(text) <= self.min_chars

    def harmful(self, score: Column) -> Column:
        return score >= self.max_harm_score if self.harm_inclusive else score > self.max_harm_score


SCALAR = CascadePreset()
BATCHED = CascadePreset(strip=False, min_language_score=0.5, harm_inclusive=True, min_quality_score=0.5)
REASONS = ("short", "language", "gopher", "nsfw", "toxic", "quality")


def discard_reason(docs: DataFrame, preset: CascadePreset = SCALAR) -> DataFrame:
    """Adds ``discard_reason``: the first rule that a row fails, null if it passes all.

    Reads text, lang, lang_score, nsfw_score, toxic_score, quality (high or low) and quality_score;
    cheap rules stand first, and a null score never discards.
    """
    scored = with_quality(docs.withColumn("text", F.coalesce("text", F.lit(""))))
    reason = (
        F.when(preset.too_short(F.col("text")), "short")
        .when(~((F.col("lang") == preset.language) & (F.col("lang_score") >= preset.min_language_score)), "language")
        .when(~F.col("gopher_pass"), "gopher")
        .when(preset.harmful(F.col("nsfw_score")), "nsfw")
        .when(preset.harmful(F.col("toxic_score")), "toxic")
        .when((F.col("quality") == "low") | (F.col("quality_score") < preset.min_quality_score), "quality")
    )
    return scored.withColumn("discard_reason", reason)


def kept_and_masked(cascaded: DataFrame) -> DataFrame:
    """Survivors with personal data masked; masking runs on survivors only."""
    kept = cascaded.where(F.col("discard_reason").isNull()).withColumn("_m", mask_pii(F.col("text")))
    return kept.withColumns({"text": F.col("_m.text"), "n_email": F.col("_m.n_email"), "n_phone": F.col("_m.n_phone"), "n_ip": F.col("_m.n_ip")}).drop("_m")


def funnel(cascaded: DataFrame) -> DataFrame:
    """``reason, n, pct`` with kept rows as reason kept; an empty input has no rows."""
    counts = cascaded.groupBy(F.coalesce("discard_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
    return counts.select("reason", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("pct"))  # over a row for each reason
