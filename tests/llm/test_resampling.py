import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from millgauge.llm import resampling
from millgauge.llm.resampling import Features, matrix_checksums, resample

DOCS = "doc_id long, text string, rank long, weight string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = {65 + k: 97 + k for k in range(26)}


def features(text):
    words = WORD.findall((text or "").translate(UPPER))
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return words, [zlib.crc32(r.encode()) % 10_000 for r in runs]


def brute(rows, target, min_words=20):
    own = [features(r[1]) for r in rows]
    s, t = np.zeros(10_000), np.zeros(10_000)
    for _, buckets in own:
        np.add.at(s, buckets, 1)
    for text in target:
        np.add.at(t, features(text)[1], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s, t)]
    out = []
    for (doc, *_), (words, buckets) in zip(rows, own):
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(words), len(buckets), weight, score, None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for k, row in enumerate(able[: len(able) * 5 // 100], 1):
        row[5] = k
    return sorted(map(tuple, out), key=str)


def corpus():
    draw = random.Random(3)
    words = ["The", "the", "été", "x9", "A", "Straße", "日本", "long" * 80, "b"] + [f"w{k}" for k in range(40)]
    signs = [" ", "\n", ", ", "-", "\x7f", "  ", "@"]
    rows = [(k, "".join(draw.choice(words) + draw.choice(signs) for _ in range(draw.randint(0, 60))), 7, "w") for k in range(400)]
    rows += [(500, None, None, "w"), (501, "", 1, None), (502, " ,- ", 1, "w"), (None, "the b " * 15, 1, "w"), (503, "a the " * 30_000, 1, "w")]
    return rows + [(600, "b the w1 " * 9, 1, "w")] * 3 + [(601, "one", 1, "w"), (602, "one two", 1, "w")]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_checksums_of_slices():
    data = np.frombuffer(random.Random(1).randbytes(5_000), np.uint8)
    draw = np.random.default_rng(2)
    start, size = draw.integers(0, 4_000, 500), draw.integers(1, 400, 500)
    expected = [zlib.crc32(data[a : a + n]) for a, n in zip(start, size)]
    assert matrix_checksums(data, start, size).tolist() == expected


def test_buckets_stay_within_texts_and_blocks(monkeypatch):
    texts = [r[1] for r in corpus()]
    for words in (3, 1 << 18):
        monkeypatch.setattr(resampling, "BLOCK_WORDS", words)
        texts = texts if words > 3 else texts[:60]
        got, at = [], 0
        own = Features()
        for n_words, buckets in own(pa.array(texts)):
            for n in own.count(n_words):
                got.append(sorted(buckets[at : at + n].tolist()))
                at += n
            at = 0
        assert got == [sorted(features(t)[1]) for t in texts]


def test_resampling_as_by_brute_force(frame):
    rows, target = corpus(), ["the été b x9 w1", "w2 w3", None, "THE B", ""]
    got = resample(frame(rows, DOCS), frame([(t,) for t in target], "text string"))
    assert found(got) == brute(rows, target)


def test_slices_do_not_change_the_draw(frame):
    rows = corpus()
    docs, target = frame(rows, DOCS), frame([("the b",)], "text string")
    assert found(resample(docs, target, hot_rows=40)) == brute(rows, ["the b"])


def test_no_target_and_no_documents(frame):
    rows, empty = corpus()[:50], frame([], "text string")
    assert found(resample(frame(rows, DOCS), empty)) == brute(rows, [])
    assert resample(frame([], DOCS), empty).collect() == []
