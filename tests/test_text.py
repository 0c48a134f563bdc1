import unicodedata

import pytest
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.functions.html import decode_html, extract_text


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("phone", ["415.555.0132", "+1 212 555 0187", "(646)555-0121", "1-800-555-0199", "9195550143"])
def test_phone_formats(spark, phone):
    got = one(spark, T.mask_phone_numbers(F.col("t")), t=f"ring {phone}, or don't")
    assert got["text"] == "ring |||PHONE_NUMBER|||, or don't" and got["n"] == 1


def test_masks_leave_marks_alone(spark):
    got = one(spark, T.mask_emails(F.col("t")), t="not |||EMAIL_ADDRESS||| again, but a.b@example.org.")
    assert got["text"] == "not |||EMAIL_ADDRESS||| again, but |||EMAIL_ADDRESS|||." and got["n"] == 1
    assert one(spark, T.mask_ips(F.col("t")), t="At 192.0.2.146. Not 300.1.1.1")["n"] == 1
    both = one(spark, T.mask_pii(F.col("t")), t="x@y.io 312-555-0176 10.0.0.1")
    assert (both["n_email"], both["n_phone"], both["n_ip"]) == (1, 1, 1)


def test_normalize_and_grams(spark):
    assert one(spark, T.normalize_text(F.col("t")), t=" Héllo,  WÖRLD!\n") == "hello world"
    grams = lambda t: one(spark, T.word_ngrams(T.words(F.col("t")), 2), t=t)
    assert grams("a b a b") == ["a b", "b a"] and grams("a") == [] and grams("") == []


def test_accents_of_every_latin_block(spark):
    letters = [chr(c) for block in ((0xC0, 0x250), (0x1E00, 0x1F00), (0x2C60, 0x2C80), (0xA720, 0xA800)) for c in range(*block) if unicodedata.category(chr(c)) in ("Ll", "Lu")]
    rows = spark.createDataFrame([(c, unicodedata.normalize("NFD", c)) for c in letters], "t string, d string").select("t", "d", T.normalize_text(F.col("t")).alias("x"), T.normalize_text(F.col("d")).alias("y"))
    for r in rows.collect():
        plain = "".join(c for c in r["d"] if unicodedata.category(c) != "Mn")
        assert r["x"] == r["y"] and (not plain.isascii() or r["x"] == plain.lower()), r["t"]


def test_pretokens_rebuild_text(spark):
    text = "Où   est l'été?  🙃 it's 42\n\n fin"
    assert "".join(one(spark, T.pretokens(F.col("t")), t=text)) == text


def test_jaccard_of_empty_sets(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, T.jaccard(empty, empty), t="") == 0.0
    assert one(spark, T.jaccard(empty, empty, 1.0), t="") == 1.0


def test_html_blocks():
    page = "<html><head><title>no</title></head><body><h1>A  B</h1><div><p>\n one\n two <a href=x>link</a>.</p><img src=y></div><ul><li>Item</li><li>Two</li></ul><script>var x='</p>';</script></body></html>"
    assert extract_text(page) == "A B\n\none two link.\n\n  • Item\n  • Two"
    assert extract_text("") == "" and extract_text(None) == ""


def test_encodings():
    page = "<p>Größe, naïve — 文字</p>"
    for encoding in ("utf-8", "utf-8-sig", "utf-16"):
        assert decode_html(page.encode(encoding)) == page
    plain = "<p>Größe, “naïve” text of a page</p>"
    assert decode_html(plain.encode("utf-16-le")) == plain and decode_html(plain.encode("cp1252")) == plain
    for name in ("koi8-r", "gb18030", "shift_jis"):
        text = f"<!--{'x' * 9000}--><meta charset='{name}'>" + {"koi8-r": "слово", "gb18030": "文字", "shift_jis": "日本語テキスト"}[name]
        assert decode_html(text.encode(name)) == text
    assert decode_html(b"<meta charset=nonsense>\xe9") == "<meta charset=nonsense>é" and decode_html(None) == decode_html(b"") == ""
