"""Queries over answer normalising and grading: a table of cases goes through the functions; SQL states what has to come out."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from quillmill.functions import answers as A
from quillmill.operators import bpe
from quillmill.plans.registry import Catalog
from quillmill.session import load

query = Catalog()


def _quoted(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return "'" + str(value).replace("'", "''") + "'" if isinstance(value, str) else repr(value)


#: The case that a row takes, and the two digits it is filled with.
_CASE, _FIRST, _SECOND = "(conv_id * 7 + turn) % {n}", "conv_id % 9 + 1", "turn % 9 + 1"


def _cases(name: str, columns: str, function, kind: str, cases: list[tuple]) -> None:
    """Registers a query over the conversations: each turn takes one of the cases, ``@`` and ``#`` in it being digits of its own.

    The SQL fills the case's result with the same digits; function and SQL both run over all rows.
    """
    arguments = columns.split()
    rows = ", ".join(f"({i}, {', '.join(map(_quoted, case))})" for i, case in enumerate(cases))
    fill = "replace(replace({}, '@', first), '#', second)".format
    result = fill("v.result") if kind == "string" else "v.result"
    places = f"SELECT conv_id, turn, {_CASE.format(n=len(cases))} AS case_no, ({_FIRST})::VARCHAR AS first, ({_SECOND})::VARCHAR AS second FROM conversations"

    @query(name, "conversations", sql=f"SELECT conv_id, turn, {', '.join(f'{fill(f"v.{a}")} AS {a}' for a in arguments)}, {result} AS result FROM ({places}) p JOIN (VALUES {rows}) v(case_no, {', '.join(arguments)}, result) ON v.case_no = p.case_no")
    def run(conversations):
        schema = "case_no long, " + ", ".join(f"{a} string" for a in arguments)
        table = conversations.sparkSession.createDataFrame([(i, *case[:-1]) for i, case in enumerate(cases)], schema)
        placed = conversations.select("conv_id", "turn", F.expr(_CASE.format(n=len(cases))).alias("case_no"), F.expr(_FIRST).cast("string").alias("first"), F.expr(_SECOND).cast("string").alias("second"))

        @F.pandas_udf(kind)
        def apply(*series: pd.Series) -> pd.Series:
            return pd.Series([function(*[None if pd.isna(x) else x for x in values]) for values in zip(*series, strict=True)])

        filled = placed.join(F.broadcast(table), "case_no").select("conv_id", "turn", *[F.expr(fill(a)).alias(a) for a in arguments])
        return filled.withColumn("result", apply(*arguments))


_cases("latex_answers", "answer", A.normalize_latex, "string", [
    ("\\frac@#", "\\frac{@}{#}"), ("\\dfrac{@}{#}", "\\frac{@}{#}"), ("\\tfrac @ #", "\\frac{@}{#}"), ("\\frac@{1#}", "\\frac{@}{1#}"), ("0.5", "\\frac{1}{2}"), (".5", "\\frac{1}{2}"),
    (".@#", "0.@#"), ("@/#", "\\frac{@}{#}"), ("-@/#", "\\frac{-@}{#}"), ("0@/#", "0@/#"), ("x=@", "@"), ("f(x)=@", "f(x)=@"), ("@# cm", "@#"), ("@#\\text{ miles}", "@#"), ("\\text{blue}", "blue"),
    ("@0^\\circ", "@0"), ("@0^{\\circ}", "@0"), ("\\$@#", "@#"), ("@#\\%", "@#"), ("\\sqrt@", "\\sqrt{@}"), ("@\\sqrt{ # }", "@\\sqrt{#}"), ("x \\neq 2", "x\\ne2"), ("\\left( 1, 2 \\right)", "(1,2)"),
    ("\\begin{bmatrix} 1 & 2 \\end{bmatrix}", "\\begin{pmatrix}1&2\\end{pmatrix}"), ("1\\!000", "1000"), ("\\frac{1", "\\frac{1"), ("", ""), (None, None),
])
_cases("text_answers", "answer", A.normalize_text_answer, "string", [
    ("@,23#", "@23#"), ("@ #/4", "@+#/4"), ("$@", "@"), ("@%", "@"), ("@ million", "@*10^6"), ("@ hours", "@"), ("4 inches^2", "4"), ("@.0", "@"), ("- @", "-@"), ("\\frac{@}{#}", "@/#"), ("\\sqrt{@}", "sqrt(@)"),
    ("2\\pi", "2pi"), ("1 or 2", "1,2"), ("ABC", "abc"), ("{9}", "9"), ("\\text{Red}", "red"), ("10,\\! 000", "10000"), (None, None),
])
_cases("final_answers", "answer", A.normalize_final_answer, "string", [
    ("the total is $42$", "42"), ("1,000", "1000"), ("\\frac12", "\\frac{1}{2}"), ("\\sqrt3", "\\sqrt{3}"), ("$\\boxed{7}$ units", "7"), ("\\textbf{8}", "8"), ("5 dollars", "5"), ("x^{2}", "x^{2}"),
])
_cases("boxed_answers", "text", A.boxed_answer, "string", [
    ("so \\boxed{@}", "@"), ("\\boxed{@} then \\boxed{\\frac{@}{#}}", "\\frac{@}{#}"), ("\\boxed{x{y}z}", "x{y}z"), ("\\boxed{open", None), ("none", None), ("\\boxed 5", None), (None, None),
])
_cases("graded_answers", "given truth", A.grade, "boolean", [
    ("@/#", "\\frac{@}{#}", True), ("2/4", "1/2", False), ("@,000", "@000", True), ("(@, #)", "(@,#)", True), ("(2,1)", "(1,2)", False), ("[1,2)", "(1,2)", False), ("5.0", "5", True), ("5.5", "5", False),
    ("x=@", "@", True), ("@ cm", "@", True), ("@#", "\\boxed{@#}", True), ("2^3", "8", False), ("@*x+#", "#+x*@", True), ("(x+1)^2", "x^2+2x+1", True), ("(x+1)^2", "x^2+1", False), ("\\sqrt{8}", "2\\sqrt{2}", True), ("2\\pi r", "2r\\pi", True), ("x+y+z", "z+y+x", False), ("1.50", "1.5", True), ("", "5", False), (None, "5", False),
])
_cases("equal_numbers", "a b", lambda a, b: A.numeric_equal(float(a), float(b)), "boolean", [("1.00005", "1", True), ("1.0002", "1", False), ("-3", "-3.0001", True), ("0", "0", True), ("0.001", "0", False)])
_cases("equal_values", "given truth", A.value_equal, "boolean", [("0.50", "1/2", False), ("2.0", "2", True), ("\\frac12", "0.5", True), ("a", "b", False), ("1e3", "1000", True)])
_cases("answer_kinds", "text", lambda t: "".join("01"[f(t)] for f in (A.is_float, A.is_int_text, A.is_fraction, A.may_evaluate)), "string", [
    ("5", "1101"), ("5.0", "1101"), ("5.5", "1001"), ("1,000", "0101"), ("1/2", "0011"), ("1/0", "0001"), ("x+y", "0001"), ("x+y+z", "0000"), ("2^{3}", "0000"), ("2^33", "0000"), ("nan", "1001"), ("1e400", "1001"),
])
_cases("tuple_answers", "text", lambda t: "|".join(A.split_tuple(t)), "string", [("(@,00#, #)", "@00#|#"), ("[a, b)", "a|b"), ("1,000", "1000"), ("((1,2),3)", "((1,2),3)"), ("", ""), ("()", "()")])
_cases("rational_values", "text", lambda t: None if (x := A.rational(t)) is None else str(x), "string", [
    ("1/2+1/3", "5/6"), ("2^3", "8"), ("2(3)", "6"), ("1/0", None), ("-0.25", "-1/4"), ("x", None), ("2**", None), ("+".join(["1"] * 300), "300"),
])
_cases("repeated_texts", "text", A.repeatness, "boolean", [("ab" * 40, True), ("the quick brown fox jumps over it", False), ("", False), ("a", False), ("aaaaaaaaaa", True), ("to be or not to be", False)])
_cases("boxed_rewards", "response truth", lambda r, t: "{format_reward:.0f}{answer_reward:.0f}{reward:.0f}".format(**A.boxed_reward(r, t)), "string", [
    ("so \\boxed{1/2}", "0.5", "111"), ("so \\boxed{3}", "4", "100"), ("so 4", "4", "000"), (None, "4", "000"),
])
_cases("tagged_rewards", "response truth", lambda r, t: "{format_reward:.0f}{answer_reward:.0f}{reward:.0f}".format(**A.think_answer_reward(r, t)), "string", [
    ("a</think> <answer>7</answer>", "7", "111"), ("a</think> <answer> \\boxed{\\frac12} </answer>", "1/2", "111"), ("a</think><answer>7</answer>", "7", "000"), ("a</think> <answer>6</answer> <answer>7</answer>", "7", "111"),
    ("a</think> <answer>x = 7</answer>", "7", "111"), ("a</think> <answer>\\boxed{7</answer>", "7", "100"),
])


@query("byte_alphabet", "documents", sql="""WITH b AS (SELECT unnest(range(256))::INTEGER AS byte), v AS (SELECT byte, (byte BETWEEN 33 AND 126 OR byte BETWEEN 161 AND 172 OR byte BETWEEN 174 AND 255) AS seen FROM b),
a AS (SELECT byte, CASE WHEN seen THEN chr(byte) ELSE chr((255 + count(CASE WHEN NOT seen THEN 1 END) OVER (ORDER BY byte))::INTEGER) END AS printed FROM v),
h AS (SELECT hex(encode(text)) AS h FROM documents), t AS (SELECT ('0x' || unnest(regexp_extract_all(h, '..')))::INTEGER AS byte FROM h)
SELECT byte, printed, count(*)::BIGINT AS n FROM t JOIN a USING (byte) GROUP BY ALL""")
def byte_alphabet(docs):
    """The texts' bytes, counted, each with the letter that vocabulary files print for it."""

    def counted(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                total += np.bincount(np.frombuffer(text or b"", np.uint8), minlength=256)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["byte", "n"])

    letters = docs.sparkSession.createDataFrame(list(bpe.printable_bytes().items()), "byte int, printed string")
    counts = docs.select("text").mapInArrow(counted, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))
    return counts.join(F.broadcast(letters), "byte").select("byte", "printed", "n")


@query("special_split", sql="""WITH d AS (SELECT doc_id, unnest(string_split(text || '<|endoftext|>' || lang || '<|pad|>' || source, '<|endoftext|>')) AS x FROM documents)
SELECT doc_id, md5(piece) AS piece_md5 FROM (SELECT doc_id, unnest(string_split(x, '<|pad|>')) AS piece FROM d)""")
def special_split(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    text = F.concat("text", F.lit("<|endoftext|>"), "lang", F.lit("<|pad|>"), "source")
    return docs.select("doc_id", F.explode(bpe.split_on_specials(text, ("<|endoftext|>", "<|pad|>"))).alias("piece")).select("doc_id", F.md5("piece").alias("piece_md5"))
