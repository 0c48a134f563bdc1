"""Text transforms as Column expressions: all of them stay inside code generation, none calls Python."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns and marks that masked text must agree on.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE_CORE = r"(?:\+?1[-.\s]?)?(?:\(\d{3}\)|\d{3})[-.\s]?\d{3}[-.\s]?\d{4}"
PHONE = rf"(?<![\p{{L}}\p{{N}}_]){PHONE_CORE}(?![\p{{L}}\p{{N}}_])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b"
EMAIL_MARK, PHONE_MARK, IP_MARK = "|||EMAIL_ADDRESS|||", "|||PHONE_NUMBER|||", "|||IP_ADDRESS|||"
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, not once for each use inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def one_line(text: Column) -> Column:
    """Newlines to blanks, outer white space off."""
    return F.regexp_replace(F.translate(text, "\n", " "), r"^\s+|\s+$", "")


def collapse_ws(text: Column, limit: int = 10_000) -> Column:
    """Runs of white space to one blank, at most ``limit`` characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit)


def _masked(text: Column, pattern: str, mark: str, hint: Column) -> Column:
    """Struct of text and n; the pattern runs only over texts with what every match of it holds."""
    found = F.struct(F.regexp_replace(text, pattern, mark.replace("|", r"\|")).alias("text"), F.regexp_count(text, F.lit(pattern)).cast("long").alias("n"))
    return F.when(hint, found).otherwise(F.struct(text.alias("text"), F.lit(0).cast("long").alias("n")))


def mask_emails(text: Column) -> Column:
    return _masked(text, EMAIL, EMAIL_MARK, text.contains("@"))


def mask_phone_numbers(text: Column) -> Column:
    return _masked(text, PHONE, PHONE_MARK, text.rlike(r"\d{3}[-.\s]?\d{4}"))


def mask_ips(text: Column) -> Column:
    return _masked(text, IP, IP_MARK, text.rlike(r"\d\.\d{1,3}\.\d"))


def mask_pii(text: Column) -> Column:
    """E-mail, then phone, then IP on the text so far: struct of text, n_email, n_phone, n_ip."""

    def rest(emails: Column, phones: Column) -> Column:
        return let(mask_ips(phones["text"]), lambda ips: F.struct(ips["text"].alias("text"), emails["n"].alias("n_email"), phones["n"].alias("n_phone"), ips["n"].alias("n_ip")))

    return let(mask_emails(text), lambda emails: let(mask_phone_numbers(emails["text"]), lambda phones: rest(emails, phones)))


def _accents() -> tuple[str, str]:
    """Latin letters that decompose to one base letter and marks, and their bases, by rule."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), 0x212A, 0x212B):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accents()


def normalize_text(text: Column) -> Column:
    """Accents off, lower case, punctuation off, white space collapsed (native; exact for every block of Latin letters)."""
    plain = F.regexp_replace(F.translate(text, _FROM, _TO), r"\p{Mn}+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def words(text: Column) -> Column:
    """White-space-separated words; an empty text has none."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_ngrams(tokens: Column, n: int) -> Column:
    """Distinct n-grams joined by a blank; fewer than n words: none."""

    def grams(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    return let(tokens, grams)


def line_hash(line: Column) -> Column:
    """MD5 of the line without its trailing newlines."""
    return F.md5(F.regexp_replace(line, r"\n+$", ""))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Shared over all distinct elements; ``empty`` for two empty sets."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / both)


def snippet_around(text: Column, pattern: str, window: int = 120) -> Column:
    """Characters around the first match of a pattern; null without one."""
    at = F.regexp_instr(text, F.lit(pattern))
    start = F.greatest(at - window, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at + window - start))


def snippet_around_change(before: Column, after: Column, window: int = 120) -> Column:
    """Struct of ``before`` and ``after``: characters around the first one that differs; null for equal texts.

    The window ends within the shorter text. The common prefix is found by halving, so a long text costs some
    comparisons of prefixes, not one of each character.
    """
    short = F.least(F.length(before), F.length(after))

    def halve(state: Column, _: Column) -> Column:
        low, high = state["low"], state["high"]
        middle = F.ceil((low + high) / 2).cast("int")
        same = F.substring(before, F.lit(1), middle) == F.substring(after, F.lit(1), middle)
        return F.struct(F.when(same, middle).otherwise(low).alias("low"), F.when(same, high).otherwise(F.greatest(low, middle - 1)).alias("high"))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(short + 2)).cast("int") + 1)
    shared = F.aggregate(steps, F.struct(F.lit(0).alias("low"), short.alias("high")), halve)["low"]

    def cut(text: Column, at: Column) -> Column:
        start = F.greatest(at - window, F.lit(0))
        return F.substring(text, start + 1, F.least(at + window, F.length(after)) - start)

    both = let(shared, lambda at: F.struct(cut(before, at).alias("before"), cut(after, at).alias("after")))
    return F.when(before != after, both)


def format_prompt(template: str, question: Column, slot: str = "question") -> Column:
    return F.replace(F.lit(template), F.lit("{" + slot + "}"), F.regexp_replace(question, r"^\s+|\s+$", ""))


def pretokens(text: Column) -> Column:
    """Pre-tokens of byte-level BPE; they concatenate back to the text."""
    return F.regexp_extract_all(text, F.lit(PRETOKEN), 0)


def fasttext_line(label: Column, text: Column) -> Column:
    return F.concat(F.lit("__label__"), label, F.lit(" "), one_line(text))


# -- HTML, natively ----------------------------------------------------------------------------

_BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def html_text(html: Column) -> Column:
    """Visible text without a parser: hidden elements off, blocks to lines, tags off, entities decoded."""
    x = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|head|noscript)\b.*?</(script|style|head|noscript)>", " ")
    x = F.regexp_replace(x, r"\s+", " ")
    x = F.regexp_replace(x, rf"(?i)</?(?:{_BLOCKS})\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    x = F.regexp_replace(F.regexp_replace(x, r" *\n *", "\n"), r"\n+", "\n")
    return F.regexp_replace(x, r"^[\s]+|[\s]+$", "")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


# -- prompts -----------------------------------------------------------------------------------

#: Prompt templates.
PROMPTS = {
    "r1_zero": (
        "A conversation between User and Assistant. The User asks a question, and the Assistant solves it. The Assistant first thinks about the reasoning process in the mind and then provides the User with the answer. "
        "The reasoning process is enclosed within <think> </think> and answer is enclosed within <answer> </answer> tags, respectively, i.e., <think> reasoning process here </think> <answer> answer here </answer>.\n"
        "User: {question}\nAssistant: <think>"
    ),
    "question_only": "{question}",
    "zero_shot_system": (
        '# Instruction\nBelow is a list of conversations between a human and an AI assistant (you).\nUsers place their queries under "# Query:", and your responses are under "# Answer:".\n'
        "You are a helpful, respectful, and honest assistant.\nYou should always answer as helpfully as possible while ensuring safety.\n"
        "Your answers should be well-structured and provide detailed information. They should also have an engaging tone.\n"
        "Your responses must not contain any fake, harmful, unethical, racist, sexist, toxic, dangerous, or illegal content, even if it may be helpful.\n"
        "Your response must be socially responsible, and thus you can reject to answer some controversial topics.\n\n# Query:\n```{instruction}```\n\n# Answer:\n```\n"
    ),
    "alpaca_sft": "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n### Instruction:\n{instruction}\n\n### Response:\n{response}\n",
}
