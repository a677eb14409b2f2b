import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millgauge.llm import language
from millgauge.llm.language import code_lengths, identify, places, trees
from millgauge.llm.quality import STATISTICS, classify, isotonic, keep_good, statistics

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, score double"


def test_quality_on_rows_held_out(spark):
    found = entry.queries()["op9_quality"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = found.where("held_out").join(labels, "doc_id").select("quality", "predicted", "score").collect()
    right = np.mean([r.quality == r.predicted for r in rows])
    bad = [r.score for r in rows if not r.quality]
    good = [r.score for r in rows if r.quality]
    order = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert right > 0.93 and order > 0.95 and len(rows) > 50
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_edge_rows(frame):
    rows = [(k, "the good text of words " * 5 if k % 2 else "Nd " * 40, "en", "s", 0.0) for k in range(60)]
    odd = [(None, "the good text", None, None, None), (900, None, "en", "s", 0.0), (901, "", "en", "s", 0.0), (902, "\n" * 40, "en", "s", 0.0), (5, rows[5][1], "en", "s", 0.0), (903, "wort " * 100_000, "de", "s", 0.0)]
    labels = frame([(k, k % 2) for k in range(60)] + [(3, None), (None, 1), (777, 0)], "doc_id long, quality int")
    docs = frame(rows + odd, DOCS)
    found = classify(docs, labels).collect()
    assert len(found) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in found)
    assert all(r.predicted == r.doc_id % 2 for r in found if r.doc_id is not None and r.doc_id < 60)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id < 60").count() == 31
    none = frame([], "doc_id long, quality int")
    assert {r.score for r in classify(docs, none).collect()} == {0.5}
    assert classify(frame([], DOCS), labels).collect() == []
    assert {r.score for r in classify(docs, frame([(1, 1)], "doc_id long, quality int")).collect()} == {1.0}


def test_statistics_do_not_depend_on_the_batch():
    texts = ["Ab c.\nab", None, "", "ÉÉ x|x 12", "w " * 3000]
    whole = statistics(pa.array(texts))
    single = np.vstack([statistics(pa.array([t], pa.string())) for t in texts])
    assert whole.shape == (5, STATISTICS) and np.allclose(whole, single)
    assert not whole[1:3].any()


def test_statistics_of_a_large_batch_hold_little_memory():
    texts = [f"Ab{k} c.\n" + "some words | and more " * 150 for k in range(3000)]  # 10 MB
    batch = pa.array(texts)
    statistics(batch.slice(0, 3))
    tracemalloc.start()
    found = statistics(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    some = [0, 77, 78, 1500, 2999]
    assert np.allclose(found[some], np.vstack([statistics(pa.array([texts[k]])) for k in some]))


def test_isotonic_is_the_least_squares_fit():
    draw = random.Random(1)
    x = np.arange(60.0)
    n = np.array([draw.randint(1, 9) for _ in x], float)
    p = np.array([draw.uniform(0, 1) * k for k in n])
    knots, values = isotonic(x, n, p)
    fitted = np.interp(x, knots, values)
    assert (np.diff(fitted) >= -1e-12).all()
    # The minimax form of isotonic regression.
    mean = lambda a, b: p[a : b + 1].sum() / n[a : b + 1].sum()
    expected = [max(min(mean(a, b) for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert np.allclose(fitted, expected)


def test_language_on_rows_held_out(spark):
    found = entry.queries()["op7_language"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    rows = found.where("held_out").join(docs, "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and len(rows) > 200
    assert found.count() == docs.count()


def test_language_edge_rows(frame):
    rows = [(k, ("der die und ist nicht" if k % 2 else "the and of is not") + f" {k}", "de" if k % 2 else "en", "s", 0.0) for k in range(40)]
    odd = [(None, "und die der", None, None, None), (901, None, "de", "s", 0.0), (902, "", "de", "s", 0.0), (903, "12 !?\n", "de", "s", 0.0), (904, "the of and " * 60_000, None, "s", 0.0), (905, "x", "en", "s", 0.0)]
    docs = frame(rows + odd, DOCS)
    found = {r.doc_id: r for r in identify(docs, docs).collect()}
    assert all(found[k].lang_pred == ("de" if k % 2 else "en") for k in range(40))
    assert found[None].lang_pred == "de" and found[904].lang_pred == "en" and found[905].lang_pred in ("de", "en")
    assert all(found[k].lang_pred == "und" and found[k].score == 0 for k in (901, 902, 903))
    assert all(0 <= r.score <= 1 for r in found.values())
    unknown = identify(docs, docs.where("1 = 0")).collect()
    assert {(r.lang_pred, r.score) for r in unknown} == {("und", 0.0)} and len(unknown) == len(rows) + len(odd)
    assert identify(frame([], DOCS), docs).collect() == []


def test_languages_in_several_passes(frame, monkeypatch):
    docs = frame([(k, w * 30, f"l{k}", "s", 0.0) for k, w in enumerate(["abc ", "abd ", "xyz ", "xyw ", "qrs "])], DOCS)
    whole = sorted(identify(docs, docs).collect())
    monkeypatch.setattr(language, "LANGUAGES", 2)
    parts = sorted(identify(docs, docs).collect())
    assert [r.lang_pred for r in whole] == [f"l{k}" for k in range(5)] == [r.lang_pred for r in parts]
    assert np.allclose([r.score for r in whole], [r.score for r in parts])


def plain_bits(train, text, codes, rare_kinds):
    """Code length of a text by walking the contexts of each byte."""
    size = language.ALPHABET

    def symbols(t):
        return [language.RARE] * 2 + [int(codes[b]) for b in t.encode()]

    seen = {}
    for t in train:
        s = symbols(t)
        for k in range(2, len(s)):
            for n in (0, 1, 2):
                seen.setdefault(tuple(s[k - n : k]), {}).setdefault(s[k], 0)
                seen[tuple(s[k - n : k])][s[k]] += 1
    bits, s = 0.0, symbols(text)
    for k in range(2, len(s)):
        chance = 1.0
        for n in (2, 1, 0):
            counts = seen.get(tuple(s[k - n : k]), {})
            total, kinds = sum(counts.values()), len(counts)
            if s[k] in counts:
                chance *= counts[s[k]] / (total + kinds)
                break
            chance *= kinds / (total + kinds) if total else 1.0
        else:
            chance /= size
        bits += -math.log2(chance) + (math.log2(rare_kinds) if s[k] == language.RARE else 0)
    return bits


def test_code_lengths_are_those_of_a_context_walk(frame):
    train = ["das und der", "derdiedas", "é über"]
    learn = frame([("de", t, k) for k, t in enumerate(train)], "lang string, text string, pick long")
    tables, codes = trees(learn, 10**6)
    lengths = np.frombuffer(tables.first().bits, np.float32)
    for text in ("der und", "xyz q", "é", "das\nDAS"):
        data = np.frombuffer(text.encode(), np.uint8)
        got = lengths[places(data, np.array([0, len(data)]), codes)].astype(float).sum()
        rare = 256 - len(set("".join(train).encode()))
        assert got == pytest.approx(plain_bits(train, text, codes, rare), rel=1e-5)
    assert np.allclose(np.exp2(-code_lengths(np.zeros(language.ALPHABET**3, int), 1)), 1 / language.ALPHABET)


def test_folds_do_not_look_at_the_languages_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    changed = docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang")))
    one, two = (sorted(identify(d, d.where(~held)).collect()) for d in (docs, changed))
    assert one == two


def sparse_bits(train, text):
    """Code length of a text by walking the contexts of each byte, over all 256 values."""
    seen = {}
    for s in ([0] * language.ORDER + [*t.encode()] for t in train):
        for k in range(language.ORDER, len(s)):
            for n in range(language.ORDER + 1):
                counts = seen.setdefault(tuple(s[k - n : k]), {})
                counts[s[k]] = counts.get(s[k], 0) + 1
    bits, s = 0.0, [0] * language.ORDER + [*text.encode()]
    for k in range(language.ORDER, len(s)):
        chance = 1.0
        for n in range(language.ORDER, -1, -1):
            counts = seen.get(tuple(s[k - n : k]), {})
            total, kinds = sum(counts.values()), len(counts)
            if s[k] in counts:
                chance *= counts[s[k]] / (total + kinds)
                break
            chance *= kinds / (total + kinds) if total else 1.0
        else:
            chance /= 256
        bits -= math.log2(chance)
    return bits


def test_sparse_code_lengths_are_those_of_a_context_walk():
    def cut(texts):
        blobs = [t.encode() for t in texts]
        return np.frombuffer(b"".join(blobs), np.uint8), np.cumsum([0, *map(len, blobs)])

    train = ["das und der", "derdiedas", "", "é über", "ж"]
    found, n = np.unique(language.grams(*cut(train)), return_counts=True)
    table = language.tree(found, n)
    for text in ("der und", "xyz q", "é", "das\nDAS", "жжж", "d"):
        assert language.gram_bits(language.grams(*cut([text])), table).sum() == pytest.approx(sparse_bits(train, text), rel=1e-5)


def test_two_rare_languages_of_one_script_beside_a_large_latin_one(frame):
    draw = random.Random(5)
    letters = [chr(c) for c in range(0x430, 0x450)]
    latin = "".join(map(chr, range(33, 127)))
    words = {}
    for lang in ("bg", "uk"):
        words[lang] = ["".join(draw.sample(letters, 5)) for _ in range(12)]
    line = lambda lang: " ".join(draw.choices(words[lang], k=10))
    rows = [(k, "".join(draw.sample(latin, 94)) * 10, "en", "s", 0.0) for k in range(300)]
    rows += [(1000 + k, line(lang), lang, "s", 0.0) for k, lang in enumerate(["bg", "uk"] * 10)]
    fresh = [(2000 + k, line(lang), lang, "s", 0.0) for k, lang in enumerate(["bg", "uk"] * 10)]
    found = {r.doc_id: r.lang_pred for r in identify(frame(fresh, DOCS), frame(rows, DOCS)).collect()}
    assert found == {r[0]: r[2] for r in fresh}
