import math

from quillmill.operators import classify as C


def plain(text, profiles, floor=-12.0):
    import re

    t = " " + " ".join(re.findall(r"[^\W\d_]+", (text or "").lower())) + " "
    grams = [t[i : i + 3] for i in range(len(t) - 2)]
    s = {}
    for g in grams:
        for lang, logp in profiles.get(g, ()):
            s[lang] = s.get(lang, 0) + logp - floor
    if not s:
        return "unknown", 0.0
    best = max(s, key=lambda k: (s[k], k))
    return best, 1 / sum(math.exp(v - s[best]) for v in s.values())


def test_profiles_and_predictions_where_the_texts_lie(spark, monkeypatch):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, "Ünder the Ärger 𝒳yz", "de"), (4, None, "en"), (5, "", "fr"), (6, "12 !?", None), (7, "a", None), (None, "the und", None), (8, "the the the " * 30_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    monkeypatch.setattr(C, "slices", lambda it, *_: (b.slice(i, 2) for b in it for i in range(0, b.num_rows, 2)))
    found = C.language_profiles(docs, 30).collect()
    profiles = {}
    for r in found:
        profiles.setdefault(r["gram"], []).append((r["lang"], r["logp"]))
    table = spark.createDataFrame(found)
    here, joined = C.identify_language(docs, table), C.identify_language(docs.where("doc_id is not null"), table, most_sent=0)
    wanted = {d: plain(t, profiles) for d, t, _ in rows}
    got = {r[0]: (r[1], r[2]) for r in here.collect()}
    assert here.count() == len(rows) and {d: g[0] for d, g in got.items()} == {d: g[0] for d, g in wanted.items()}
    assert all(abs(got[d][1] - wanted[d][1]) < 1e-9 for d in wanted)
    assert {r[0]: (r[1], round(r[2], 9)) for r in joined.collect()} == {d: (g[0], round(g[1], 9)) for d, g in got.items() if d is not None}
    assert not any("Generate" in line for line in here._jdf.queryExecution().toString().splitlines())
