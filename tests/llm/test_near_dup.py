import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from millgauge.llm.components import components
from millgauge.llm.near_dup import band_keys, near_duplicates, parities, signature
from millgauge.llm.words import shingle_sets

DOCS = "doc_id long, text string, lang string, component_id string"


def brute_sets(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size):
    """doc -> (n, component) by comparing all pairs."""
    sets = {d: brute_sets(t, size) for d, t in rows}
    parent = {d: d for d, _ in rows}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a_, b_ = sorted((root(a), root(b)))
                parent[b_] = a_
    return {d: (len(sets[d]), root(d)) for d in ids}


def some_docs(seed):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(25):
        base = [draw.choice(words) for _ in range(draw.choice((3, 30, 80)))]
        for _ in range(draw.choice((1, 1, 2, 6))):
            own = list(base)
            for _ in range(draw.choice((0, 0, 1, 2, 5))):
                own[draw.randrange(len(own))] = draw.choice(words)
            rows.append((len(rows), draw.choice((" ", "\n", "\t  ")).join(own).replace("w1", "W1")))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "w1"), (904, "W1 ")]


@pytest.mark.parametrize("size", [2, 5])
def test_components_equal_those_of_all_pairs(frame, size):
    rows = some_docs(size)
    found = near_duplicates(frame([(d, t, None, "x") for d, t in rows], DOCS), shingle_words=size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_null_ids_repeated_rows_and_empty_tables(frame):
    text = "a b c d e f g h"
    rows = [(5, text, None, None), (5, text, None, None), (7, text, None, None), (None, text, None, None), (8, None, None, None)]
    found = sorted(near_duplicates(frame(rows, DOCS)).collect(), key=str)
    kept = [(r.doc_id, r.component_id, r.kept) for r in found]
    assert sorted(kept, key=str) == sorted([(5, 5, True), (5, 5, True), (7, 5, False), (None, None, True), (8, 8, True)], key=str)
    assert near_duplicates(frame([], DOCS)).collect() == []


def test_a_chain_is_one_component(frame):
    rows = [(k, k + 1) for k in range(40)] + [(100, 99), (99, 100), (7, 7)]
    found = dict(components(frame(rows, "a long, b long")).collect())
    assert {k: found[k] for k in range(41)} == dict.fromkeys(range(41), 0)
    assert found[99] == found[100] == 99


def test_shingles_of_a_batch_are_those_of_each_text():
    texts = ["A b  c", None, "", "x\x0by\r\nZ", "été É a b c", "one"]
    got = [len(s) for s in shingle_sets(pa.array(texts), 2)]
    assert got == [len(brute_sets(t, 2)) for t in texts]
    one, two = shingle_sets(pa.array(["THE cat sat", "the\ncat  sat "]), 2)
    assert (one == two).all()


def test_signature_agrees_as_often_as_the_sets_are_alike():
    draw = np.random.default_rng(0)
    common = draw.integers(0, 2**63, 800).astype(np.uint64)
    a = np.unique(np.concatenate([common, draw.integers(0, 2**63, 100).astype(np.uint64)]))
    b = np.unique(np.concatenate([common, draw.integers(0, 2**63, 100).astype(np.uint64)]))
    mix = np.uint64(0x9E3779B97F4A7C15)
    same = (signature(a * mix, 1024) == signature(b * mix, 1024)).mean()
    assert abs(same - 0.8) < 0.06
    assert len(band_keys(signature(a * mix, 160), 32, 5)) == 32


def test_parities_bound_the_difference():
    draw = np.random.default_rng(1)
    a = np.unique(draw.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2))
    b = a[:-30]
    bits = sum(int(x).bit_count() for x in (parities(a) ^ parities(b)).view(np.uint64))
    assert 0 < bits <= 30


def test_shingle_sets_of_a_large_batch_hold_little_memory():
    texts = [f"Ab{k} c.\n" + "some words | and more " * 150 for k in range(3000)]  # 10 MB
    batch = pa.array(texts)
    tracemalloc.start()
    found = [(len(s), int(s.sum())) for s in shingle_sets(batch, 5)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    for k in (0, 77, 78, 1500, 2999):
        (alone,) = shingle_sets(pa.array([texts[k]]), 5)
        assert found[k] == (len(alone), int(alone.sum()))
