"""Each operator on odd rows, on an empty table, and against brute force."""

import hashlib
import math
import pathlib
import random
import re
import textwrap
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillmill.llm import ann, flac, langid, licenses, mixing, packing, pii, sharding, simhash, substring
from quillmill.llm.words import gram_hashes, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=str)


# -- 1 language -------------------------------------------------------------------------------


def test_language_held_out_accuracy(documents):
    out = langid.identify(documents, langid.fit(documents), ("lang",)).where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out) and sum(r["rejected"] for r in out) <= 1


def test_held_out_is_crc32(documents):
    for r in langid.identify_language(documents).select("doc_id", "held_out").collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_labels_are_no_inputs(documents):
    model = langid.fit(documents)
    mixed = documents.withColumns({"lang": F.lit("zz"), "source": F.lit("s")})
    assert rows(langid.identify(documents, model), "doc_id", "lang_pred", "score") == rows(langid.identify(mixed, model), "doc_id", "lang_pred", "score")


def test_language_odd_rows(odd, spark):
    got = {(r["doc_id"], r["lang_pred"] == "und") for r in langid.identify_language(odd).collect()}
    assert {(3, True), (4, True), (5, True), (8, True), (1, False), (7, False)} <= got and langid.identify_language(odd).count() == 10
    assert langid.identify_language(odd.limit(0)).count() == 0
    nothing = langid.identify_language(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_other_scripts_are_rejected(spark):
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    assert [x[2] for x in model.predict(["这是一个完全不同的语言文本测试", "The and that was of the"])] == [True, False]


def test_long_texts_of_other_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.fit(docs)
    assert all(r > 0 for radii in model.radii.values() for r in radii)
    rng = random.Random(3)
    words = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(2, 4))) for _ in range(n))
    foreign = {
        "cyrillic": "абвгдежзийклмнопрстуфхцчшщыэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "chinese": [chr(0x4E00 + i) for i in range(3000)],
        "finnish": [c + v for c in "kltsnmrphvj" for v in ("ä", "aa", "ui", "en", "ssa", "lla", "ö")], "polish": [c + v for c in ("sz", "cz", "rz", "ł", "prz") for v in ("y", "ie", "ą", "ę", "ów")],
    }
    for name, parts in foreign.items():
        assert [x[2] for x in model.predict([words(parts, n) for n in (20, 100, 1000, 5000)])] == [True] * 4, name
    clean = [r["text"] for r in docs.where(langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("text").collect()]
    assert sum(x[2] for x in model.predict(clean)) <= 0.005 * len(clean)


def test_no_letter_is_undetermined(spark, documents):
    model = langid.fit(documents)
    signs = ["½ ² ³", "Ⅷ ⅔", "٣٤", "___", "123 !", "①", "\u0301", "∑ € 🙃"]
    assert not any(c.isalpha() for t in signs for c in t) and [x[0] for x in model.predict(signs)] == ["und"] * len(signs)
    assert [x[0] != "und" for x in model.predict(["½a", "²é³", "一"])] == [True] * 3


def test_prediction_equals_a_plain_centroid_loop(documents):
    """TF-IDF, norms and cosines written out over dictionaries of n-grams."""
    model = langid.fit(documents)
    centroids = model.centroids.T.astype(float)
    for text in [t for _, t in texts_of(documents)][:60] + ["½ un ² texte", "a", "É" * 40]:
        letters = "".join(c if c.isalpha() else " " for c in text.lower())
        data = (" " + " ".join(letters.split()) + " ").encode()
        grams = Counter(data[i : i + n] for n in (2, 3, 4) for i in range(len(data) - n + 1))
        cells = Counter()
        for gram, times in grams.items():
            n, value = len(gram), int.from_bytes(gram, "big")
            h = (value * 2654435761 + n * 0x3C6EF372) % 2**32 * 0x85EBCA6B % 2**32
            cells[h >> 12] += times
        weights = {c: (1 + math.log(times)) * float(model.idf[model.place[c]]) for c, times in cells.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        score = [sum(w * row[model.place[c]] for c, w in weights.items() if model.place[c] >= 0) / norm for row in centroids]
        lang, got, _ = model.predict([text])[0]
        assert abs(got - min(1, max(0, max(score)))) < 1e-4 and score[[i for i, x in enumerate(model.languages) if x == lang][0]] <= max(score)
        assert max(s for s, x in zip(score, model.languages) if x == lang) > max(score) - 1e-4


def test_stage_drops_odd_rows(odd):
    kept = langid.drop_rejected(odd).collect()
    assert {r["doc_id"] for r in kept} & {3, 4, 5, 8} == set() and len([r for r in kept if r["doc_id"] == 2]) in (0, 2)
    assert langid.drop_rejected(odd.limit(0)).count() == 0


def test_language_fit_counts_whole_texts():
    text = "the and " * 10_000 + "zyx wvu"
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([1], pa.int64()), pa.array([text])], ["lang", "key", "text"])
    got = next(r for part in langid._sample_vectors(iter([batch])) for r in part.to_pylist() if r["piece"] == 0)
    assert set(langid._grams("zyx wvu")[0][1:]) & set(np.frombuffer(got["cells"], "<i4")) == set(langid._grams("zyx wvu")[0][1:])
    assert np.frombuffer(got["counts"], "<i4").sum() == langid._grams(text)[1].sum()


# -- 2 simhash --------------------------------------------------------------------------------


def slow_fingerprint(text):
    words = [w.encode() for w in WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))]
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def slow_groups(rows_):
    fps = [(d, slow_fingerprint(t)) for d, t in rows_]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, f"{fp:016x}", low.get(find(i))) for i, (d, fp) in enumerate(fps)), key=str)


@pytest.mark.parametrize("tile", [16384, 7])
def test_simhash_groups_equal_brute_force(documents, odd, tile):
    for docs in (documents, odd):
        got = rows(simhash.simhash_groups(docs, tile=tile), "doc_id", "fingerprint", "component_id")
        assert got == slow_groups(texts_of(docs))


def test_simhash_dense_blocks():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 3, dtype=np.int64).view(np.uint64)
    fps = np.unique(np.concatenate([b ^ np.array([(1 << int(i)) | (1 << int(j)) for i in range(24) for j in range(24)], np.uint64) for b in base]))
    src, dst = simhash.compare_tiles(fps, None, 4, sub=64)
    at = {int(v): i for i, v in enumerate(fps)}
    root = simhash.local_roots(len(fps), np.array([at[int(v)] for v in src]), np.array([at[int(v)] for v in dst]))
    hit = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    assert (root == simhash.local_roots(len(fps), *np.nonzero(hit))).all() and len(src) < len(fps)


def test_simhash_empty_and_kept(odd, documents):
    assert simhash.simhash_groups(odd.limit(0)).count() == 0 and simhash.keep_one_of_each(odd.limit(0)).count() == 0
    kept = simhash.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    groups = {c for _, _, c in slow_groups(texts_of(odd))}
    assert kept.count() == len(groups)
    assert simhash.keep_one_of_each(documents).count() == len({c for _, _, c in slow_groups(texts_of(documents))})


def clashing(docs):
    """The same rows with columns named as the operators' helpers might be."""
    names = ["row_key", "_key", "_n", "_copies", "_copy", "shard", "_slot", "row", "n", "id", "kept_id", "text_key", "taken_id", "copies", "slot", "number"]
    return docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})


def test_columns_of_any_name_come_through(odd, documents, spark, tmp_path):
    for docs in (clashing(documents), clashing(odd)):
        own = {tuple(r) for r in docs.collect()}
        for out in (simhash.keep_one_of_each(docs), mixing.mixed_documents(docs), langid.drop_rejected(docs)):
            got = out.collect()
            assert out.columns == docs.columns and {tuple(r) for r in got} <= own and got
        assert pii.mask_documents(docs).columns == docs.columns
    docs = clashing(odd)
    assert sharding.write_shards(docs, str(tmp_path / "s")) == "shard_"
    back = spark.read.parquet(str(tmp_path / "s"))
    assert rows(back, *docs.columns) == rows(docs, *docs.columns)
    assert {r["shard_"] for r in back.collect()} == {r["shard"] for r in sharding.place_documents(odd).collect()}


# -- 3 personal data --------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    keep = {
        "email": lambda s, d: True, "ip": lambda s, d: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s, d: 16 <= len(d) <= 19 and pii.luhn(d), "phone": lambda s, d: 8 <= len(d) <= 15,
    }
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if keep[k](m[0], re.sub("[^0-9]", "", m[0]))]


def test_long_secrets_are_whole_candidates():
    for n in (12, 128, 129, 240, 100_000):
        secret = ("aB3_" * n)[:n]
        text = f"see token={secret}. And on"
        assert pii.candidates(text, pii.base_spans(text)) == [("secret", 10, 10 + n + 1)]  # the stop is of the run's letters


def test_base_spans_equal_plain_patterns(documents):
    rng = random.Random(5)
    for alphabet in ("a@.1 2-+(9x.@", "12345678905 -", "+1 ()-.59", "1.25.@a%"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50)))
            assert pii.base_spans(text) == plain_spans(text), text
    for _, text in texts_of(documents):
        assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_are_linear():
    assert pii.base_spans("a" * 2_000_000 + "@") == [] and pii.base_spans("1" * 300_000 + ".") == []
    assert pii.base_spans("a@" * 200_000)[:0] == []


def test_pii_rows(odd, documents):
    out = pii.find_personal_data(documents).collect()
    for r, (d, text) in zip(sorted(out, key=lambda r: r["doc_id"]), sorted(texts_of(documents)), strict=True):
        base = plain_spans(text)
        assert r["doc_id"] == d and r["n_card"] == sum(k == "card" for k, _, _ in base)
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(r["spans"].split(","))
    got = pii.find_personal_data(odd).collect()
    assert len(got) == 10 and all(r["spans"] == "" for r in got) and pii.find_personal_data(odd.limit(0)).count() == 0


def test_masking_keeps_the_rest(spark, odd):
    docs = spark.createDataFrame([(1, "mail a.b@x.org or +1 (017) 555-7713, token = \"2abc3ff2ca8fb1e4c565a0eb63815530a948bdde\" end", "k")], "doc_id long, text string, extra string")
    assert pii.mask_documents(docs).first()["text"].startswith("mail |||EMAIL||| or |||PHONE|||, token = ")
    assert rows(pii.mask_documents(odd), *odd.columns) == rows(odd, *odd.columns)


def planted():
    """Rows of ``(doc_id, text, kind, found)``: personal data in other shapes, and what only looks like it."""
    rng = random.Random(1)
    w = lambda n=1: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(n))
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    personal = {
        "at": lambda: f"mail {w()}.{w()} (at) {w()} dot com", "brackets": lambda: f"contact: {w()}[at]{w()}[dot]org", "phone": lambda: f"phone: ({d(3)}) {d(3)}-{d(4)}",
        "call": lambda: f"call {d(3)}-{d(3)}-{d(4)}", "token": lambda: f'token = "{rng.randbytes(20).hex()}"', "password": lambda: f"password={w()}{d(6)}X{w()}y{d(4)}",
    }
    decoys = {
        "order": lambda: f"order {d(8)} = {d(3)}", "page": lambda: f"see page {d(3)}.{d(4)} % of", "version": lambda: f"version {d(2)}.{d(3)}.{d(4)}.{d(2)}.{d(3)}",
        "look": lambda: f"looked at {w()}.{w()} then", "word": lambda: f"secret: {'a' * 13}",
    }
    bases = [lambda: f"{w()}@{w()}.com", lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}", lambda: f"10.0.0.{rng.randint(1, 250)}", lambda: "4111 1111 1111 1111"]
    out = []
    for found, kinds in ((True, personal), (False, decoys)):
        for kind, make in kinds.items():
            out += [(len(out) + i, f"{w(6)} {make()}, {w(5)} {rng.choice(bases)()} {w(3)}", kind, found) for i in range(40)]
    return out


def test_planted_spans_are_added_and_decoys_are_not(spark):
    docs = spark.createDataFrame(planted(), "doc_id long, text string, kind string, found boolean")
    out = pii.find_personal_data(docs, with_masked=True).join(docs.select("doc_id", "kind", "found"), "doc_id").collect()
    for kind in {r["kind"] for r in out}:
        share = np.mean([r["n_added"] > 0 for r in out if r["kind"] == kind])
        assert share > 0.9 if next(r["found"] for r in out if r["kind"] == kind) else share == 0, kind
    for r in out:
        assert ("|||SECRET|||" in r["masked"]) == (r["kind"] in ("token", "password") and r["n_added"] > 0)


def test_candidates_are_whole_runs():
    for text, body in (
        (f"x {'a' * 300}(at){'b' * 200} dot {'c' * 90}.d.e.f.g.h.i y", f"{'a' * 300}(at){'b' * 200} dot {'c' * 90}.d.e.f.g.h.i"), ("n (12) 345-67 89.01.23, z", "(12) 345-67 89.01.23"), ("in 555-123-4567 5th st", "555-123-4567"),
    ):
        (kind, s, e), = pii.candidates(text, [])
        assert text[s:e] == body
    for text in ("a.b " * 100_000 + "1 " * 200_000 + "( at " * 50_000, "1 " * 300_000 + "1x", "a at " * 200_000, "a(at)b" + ".c" * 200_000 + "@", "token=" * 100_000):
        began = time.process_time()
        pii.candidates(text, [])
        assert time.process_time() - began < 5


def test_em_finds_reliable_labelers():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < q, truth, ~truth) for q in (0.95, 0.9, 0.8, 0.55)], axis=1).astype(int)
    post, table, prior = pii.expectation_maximisation(votes, np.ones(4000), np.zeros(4000, bool))
    assert ((post > 0.5) == truth).mean() > 0.93 and abs(prior - 0.4) < 0.05 and table[0, 1, 1] > table[3, 1, 1]


# -- 4 FLAC -----------------------------------------------------------------------------------


def test_flac_round_trips_and_checksums():
    rng = random.Random(2)
    raw = [b"", b"a", b"ab" * 700, bytes(range(256)) * 9, rng.randbytes(9000), ("grün " * 900).encode(), b"\0" * 64 + b"\xff" * 5000]
    payloads = [flac.payload(x) for x in raw]
    media = flac.encode(payloads)
    assert flac.decode(media) == payloads and all(len(p) % 64 == 0 and p for p in payloads)
    assert flac.crc8(b"123456789") == 0xF4 and flac.crc16(np.frombuffer(b"123456789", np.uint8), np.array([0]), np.array([9]))[0] == 0xFEE8
    for at in (60, len(media[4]) // 2, len(media[4]) - 1):
        broken = bytearray(media[4])
        broken[at] ^= 0x10
        with pytest.raises(flac.DamagedStream):
            flac.decode([bytes(broken)])
    with pytest.raises(flac.DamagedStream):
        flac.open_stream(b"nope")


def test_flac_seeks():
    data = flac.payload(random.Random(1).randbytes(7000))
    stream = flac.encode([data])[0]
    for at, n in ((0, 10), (1020, 10), (5000, 1500)):
        assert flac.seek(stream, at, n) == bytes(b ^ 128 for b in data[at : at + n])


def test_flac_rows(odd):
    got = {(r["doc_id"], r["payload_sha256"]): r for r in flac.media_digests(odd).collect()}
    for d, t in texts_of(odd):
        p = flac.payload((t or "").encode())
        r = got[(d, hashlib.sha256(p).hexdigest())]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len((t or "").encode()), len(p), zlib.crc32(p[-64:]))
    blocks = flac.pcm_blocks(flac.store_texts(odd.where("doc_id = 6"))).orderBy("block").collect()
    pcm = b"".join(bytes(b["pcm"]) for b in blocks).translate(flac._SIGNED)
    assert pcm == flac.payload(odd.where("doc_id = 6").first()["text"].encode()) and blocks[3]["sample_offset"] == 3 * 1024
    assert flac.media_digests(odd.limit(0)).count() == 0


# -- 5 licences, 6 shards ---------------------------------------------------------------------


def test_licences(spark, odd):
    mit = licenses.KNOWN[0][1]
    spelled = "Copyright (c) 2020 Someone\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace(", ", " -- ").replace("PERMISSION", "# Permission", 1)
    texts = [mit, spelled, "Released under the MIT Licence!", mit + " and more", None, "", "The MIT License (MIT)\n\nCopyright 2021, A. Person\nAll rights reserved.\n\n" + mit]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan_licenses(docs).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: "MIT"}
    assert licenses.scan_licenses(odd).count() == 10 and licenses.scan_licenses(odd.limit(0)).count() == 0


def test_wrapped_licences_and_copyright_lines(spark):
    """Every known text, wrapped as files are, under a copyright line; SQL says the same of them."""
    rows_ = []
    for i, (name, text) in enumerate(licenses.KNOWN):
        for width in (50, 72, 79):
            body = "\n".join("\n".join(textwrap.wrap(p, width)) for p in text.split("\n"))
            rows_.append((len(rows_), name, f"Copyright (c) 19{i:02d}-2024, Some Body <body@x.org>\n\n{body}\n"))
    docs = spark.createDataFrame(rows_, "doc_id long, name string, text string")
    got = rows(licenses.scan_licenses(docs), "doc_id", "digest", "license_id")
    assert [x[2] for x in sorted(got)] == [name for _, name, _ in rows_]
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert sorted(con.sql(licenses.licenses_sql()).fetchall(), key=str) == got
    assert licenses.canonical("copyright notice and this\nCopyright 2020 X\n(c) 1999 y\nAll rights reserved\nper cent non commercial non commercial") == "copyright notice and this percent noncommercial noncommercial"


def test_published_licence_files(spark):
    folder = pathlib.Path("/usr/share/common-licenses")
    if not folder.is_dir():
        pytest.skip("no licence files on this machine")
    files = [f for f in sorted(folder.iterdir()) if not f.is_symlink()]
    got = {f.name: licenses.known_digests().get(licenses.digest(f.read_text(errors="replace"))) for f in files}
    assert None not in got.values() and {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause"}.items() <= got.items()


def test_lookup_table_takes_turns(odd):
    table = sharding.lookup_table((("a", 1), ("b", 1), ("c", 2)), 13)
    n = Counter(table)
    assert len(table) == 13 and max(n[0], n[1]) - min(n[0], n[1]) <= 1 and n[2] >= 2 * n[0] - 2
    full = Counter(sharding.lookup_table())
    assert max(full.values()) - min(full.values()) <= 1
    before, after = sharding.lookup_table(sharding.SHARDS), sharding.lookup_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != 63)
    assert moved < 0.05 * len(before)
    for wrong in (dict(size=12), dict(shards=()), dict(shards=(("a", 0),)), dict(shards=(("a", 1), ("a", 1)))):
        with pytest.raises(ValueError):
            sharding.lookup_table(**wrong)
    assert sharding.place_documents(odd).count() == 10 and sharding.place_documents(odd.limit(0)).count() == 0


def test_written_shards(spark, odd, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 10 and {r["shard"] for r in back.collect()} == {r["shard"] for r in sharding.place_documents(odd).collect()}


# -- 7 mixing ---------------------------------------------------------------------------------


def slow_mix(rows_):
    """Serve copies one by one by finish time."""
    sized = [(d, s, len(WORD.findall(t or "")), t or "") for d, t, s in rows_]
    names = sorted({s for _, s, _, _ in sized}, key=lambda s: (s is None, s or ""))
    weight = {s: 1.0 + i % 3 for i, s in enumerate(names)}
    total = {s: sum(n for _, x, n, _ in sized if x == s) for s in names}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    place = lambda x: md5(f"{'' if x[0] is None else x[0]}:{md5(x[3])}")
    queue = []
    for s in names:
        at = 0
        for d, _, n, t in sorted((x for x in sized if x[1] == s), key=lambda x: (place(x), x[0] if x[0] is not None else -1, x[2])):
            at += n
            for e in range(3):
                queue.append(((total[s] * e + at) / weight[s], names.index(s), e, place((d, s, n, t)), d if d is not None else -1, n, (d, s, n)))
    used, taken, budget = 0, Counter(), sum(total.values())
    for *_, n, key in sorted(queue):
        used += n
        if used > budget or not budget:
            break
        taken[key] += n
    return taken


@pytest.mark.parametrize("bucket_rows", [200_000, 3])
def test_mix_equals_a_served_queue(documents, odd, bucket_rows):
    for docs in (documents, odd):
        got = Counter()
        for r in mixing.mix_sources(docs, bucket_rows=bucket_rows, carry=("source",)).collect():
            got[(r["doc_id"], r["source"], r["size"])] += r["taken"]
            assert r["taken"] <= 3 * r["size"]
        want = slow_mix([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
        assert +got == +want


def test_mix_with_weights_below_one(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    for weights in ((0.01, 0.02), (1, 2), (0.5, 1e6)):
        got = mixing.mix_sources(docs, weights).agg(F.sum("taken"), F.max(F.col("taken") / F.col("size"))).first()
        assert (got[0], got[1] <= 3) == (400, True), weights


def test_targets_share_everything(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 30 and got["c"] == 15 and got[None] == 0 and got["b"] == 970 and sum(got.values()) == 1015


def test_mix_empty(odd):
    assert mixing.mix_sources(odd.limit(0)).count() == 0
    assert {r["taken"] for r in mixing.mix_sources(odd.where("doc_id in (3, 4, 5)")).collect()} == {0}
    assert mixing.mixed_documents(odd).columns == odd.columns


# -- 8 packing --------------------------------------------------------------------------------


def check_pieces(out, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer_path())
    want = Counter()
    for d, t in docs:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for at in range(0, len(ids), 4096):
            part = ids[at : at + 4096]
            want[(d, at, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    return by


def test_pieces_and_offsets(documents, odd):
    for docs in (documents, odd):
        check_pieces(packing.pack_documents(docs).collect(), texts_of(docs))
    check_pieces(packing.pack_documents(documents, bucket_rows=9).collect(), texts_of(documents))
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_plan_uses_up_the_histogram():
    rng = np.random.default_rng(0)
    for n in (1, 50, 20_000):
        bins = np.minimum(256, rng.lognormal(3.8, 1, n).astype(int) + 1)
        histogram = {int(b): int(c) for b, c in zip(*np.unique(bins, return_counts=True), strict=True)}
        plan, used = packing.plan(histogram, 256), Counter()
        for pattern, times in plan:
            assert sum(pattern) <= 256 and times > 0
            for b in pattern:
                used[b] += times
        assert dict(used) == histogram
        if n == 20_000:
            assert sum(t for _, t in plan) * 256 < 1.01 * sum(b * c for b, c in histogram.items()) + 256


def test_nnls_against_projection():
    rng = np.random.default_rng(1)
    a, x = rng.random((12, 30)), np.where(rng.random(30) < 0.2, rng.random(30), 0)
    got = packing.nnls(a, a @ x)
    assert (got >= 0).all() and np.linalg.norm(a @ got - a @ x) < 1e-6


# -- 9 repeated spans -------------------------------------------------------------------------


def slow_repeats(rows_, window=35):
    split = [WORD.findall(t or "") for _, t in rows_]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows_, split, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("wide", [4096, 1, 3])
def test_repeats_equal_brute_force(spark, documents, odd, wide):
    rng = random.Random(3)
    loops = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 120)))) for i in range(60)] + [(70, "a " * 300), (71, "b c " * 60)]
    for docs in (documents, odd.where("doc_id <> 6 or doc_id is null"), spark.createDataFrame(loops, "doc_id long, text string")):
        got = rows(substring.remove_repeats(docs, wide=wide), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert got == slow_repeats(texts_of(docs))


@pytest.mark.parametrize("wide", [512, 16])
def test_repeats_around_a_hot_anchor(spark, wide):
    """A passage in many documents, in surroundings of their own; some of these shared by two, some rows repeated."""
    rng = random.Random(9)
    w = lambda n: [rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(n)]
    passage, sides = w(40), [w(30) for _ in range(40)]
    docs = [(i, " ".join(rng.choice(sides)[: rng.randint(0, 30)] + w(rng.randint(0, 3)) + passage[: rng.choice((30, 36, 40))] + rng.choice(sides))) for i in range(600)]
    docs += docs[:5] * 20 + [(None, docs[7][1])] * 3
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(substring.remove_repeats(table, wide=wide), "doc_id", "n_words", "n_removed", "kept_sha256") == slow_repeats(docs)


def test_windows_of_other_widths(spark, documents):
    for window in (1, 5, 90):
        got = rows(substring.remove_repeats(documents, window=window), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert got == slow_repeats(texts_of(documents), window)
    with pytest.raises(ValueError):
        substring.remove_repeats(documents, window=0)


def test_copies_go_through_an_automaton(documents, monkeypatch):
    """Without matching statistics nothing is removed, copies included."""
    batch = pa.RecordBatch.from_pylist([{"id": 1, "key": 1, "text": "a b c d", "wanted": [{"anchor": 1, "region": 2, "n": 3, "salt": 0, "salts": 1, "alone": True, "first": 0, "last": 1}]}])
    marks = lambda: [r["mark"] for part in substring._contents(iter([batch]), 3, 10) for r in part.to_pylist()]
    assert marks() == [3]
    monkeypatch.setattr(substring.SuffixAutomaton, "window_states", lambda self, words, window: [0] * (len(words) - window + 1))
    assert marks() == [0]


def test_repeats_long_and_empty(odd):
    long = substring.remove_repeats(odd.where("doc_id = 6")).first()
    assert (long["n_words"], long["n_removed"]) == (100_000, 100_000)
    assert substring.remove_repeats(odd.limit(0)).count() == 0


def test_hashes_tell_words_apart():
    words = word_hashes(b" a b\tab ba\n a  b ")
    assert len(words) == 6 and words[0] == words[4] and len(set(words[:4].tolist())) == 4
    for n in (1, 2, 3, 5):
        g = gram_hashes(words, n)
        assert len(g) == 7 - n and (n > 2 or g[0] == g[4 if n < 3 else 0])


# -- 10 neighbours ----------------------------------------------------------------------------


def exact_neighbours(ids, x, q, top=20):
    s = (x * x[q]).sum(axis=1)
    s[q] = -np.inf
    return [(int(ids[i]), float(s[i])) for i in np.lexsort((ids, -s))[:top]]


def as_table(spark, ids, x):
    x = x.astype(np.float32)
    table = pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())})
    return spark.createDataFrame(table), x.astype(np.float64)


def recall(spark, ids, x, step=20, sample=300):
    """Of ids, against brute force over a part of the queries, all of whose results are checked for order and scores."""
    table, x = as_table(spark, ids, x)
    by = {}
    for r in ann.nearest_neighbours(table, step=step).collect():
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = np.flatnonzero(ids % step == 0)
    assert set(by) == set(ids[asked].tolist())
    at = {int(i): k for k, i in enumerate(ids)}
    hits = 0
    for q in asked[:: max(1, len(asked) // sample)]:
        found = sorted(by[int(ids[q])])
        assert [f[0] for f in found] == list(range(1, 21)) and [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        assert all(abs(f[2] - (x[q] * x[at[f[1]]]).sum()) < 1e-9 for f in found)
        hits += len({i for i, _ in exact_neighbours(ids, x, q)} & {f[1] for f in found}) / 20
    return hits / len(asked[:: max(1, len(asked) // sample)])


def test_recall_on_the_table(spark):
    rows_ = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    assert recall(spark, np.array([r["vec_id"] for r in rows_]), np.array([r["embedding"] for r in rows_])) >= 0.9


@pytest.mark.parametrize("clusters", [0, 500])
def test_recall_below_half_the_comparisons(spark, clusters):
    """50,000 vectors without structure, and around cluster centres."""
    rng = np.random.default_rng(clusters)
    x = rng.normal(size=(50_000, 64))
    if clusters:
        x = rng.normal(size=(clusters, 64))[rng.integers(0, clusters, len(x))] + 0.5 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert ann.comparisons(len(x)) < len(x) / 2
    assert recall(spark, rng.permutation(len(x)), x) >= 0.9


def test_large_groups_of_equal_vectors(spark):
    """Ties go to the smallest ids, however many there are; repeated ids are rows of their own."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 8))
    x[1000:2500] = x[0]
    ids = np.concatenate([rng.permutation(2990) + 5, np.arange(20, 220, 20)])
    table, x = as_table(spark, ids, x)
    got = {}
    for r in ann.nearest_neighbours(table).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = {}
    for q in np.flatnonzero(ids % 20 == 0):
        want.setdefault(int(ids[q]), []).extend((k, *x) for k, x in enumerate(exact_neighbours(ids, x, q), 1))
    same = total = 0
    for q, rows_ in want.items():
        near = lambda some: Counter((k, i, round(s, 9)) for k, i, s in some)
        assert len(got[q]) == len(rows_)
        same += (near(got[q]) & near(rows_)).total()
        total += len(rows_)
    assert same / total > 0.99
    group = set(ids[1000:2500].tolist()) | {int(ids[0])}
    assert all(near(got[q]) == near(want[q]) for q in want if q in group and len(want[q]) == 20)


def test_neighbours_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows_ = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [inf, 1.0]), (8, [nan, 1.0]), (9, [1.0]), (40, [2.0]), (10, []), (None, [0.25, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0])]
    table = spark.createDataFrame(rows_, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("cid", F.lit(1))
    got = {}
    for r in ann.nearest_neighbours(table, top=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {0: [(1, 1.0), (2, 1.0), (3, 0.5)], 20: [(20, 1.0)] * 2 + [(3, 0.5)] * 2 + [(0, 0.0)] * 2, 40: [(9, 2.0)]}
    every = ann.nearest_neighbours(table, top=30).where("query_id = 0").orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in every] == [(1, 1.0), (2, 1.0), (3, 0.5), (None, 0.25), (20, 0.0), (20, 0.0)]
    assert ann.nearest_neighbours(table.limit(0)).count() == 0
    assert ann.nearest_neighbours(table.where("vec_id = 0")).count() == 0


def test_hilbert_is_a_walk():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = ann.hilbert_keys(cells, 3)
    walk = cells[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
