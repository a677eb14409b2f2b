import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from millgauge.llm.mixing import mix, mixed_documents, sainte_lague
from millgauge.llm.sharding import RoomTree, balanced_shards, best_fit_decreasing, fixed_capacity_shards

DOCS = "doc_id long, text string, source string, n_chars long, size string"


def highest_quotients(weights, seats, most):
    out = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i in range(len(weights)) if weights[i] > 0 and out[i] < most[i]]
        if not open_:
            break
        out[max(open_, key=lambda i: (weights[i] / (2 * out[i] + 1), -i))] += 1
    return out


@pytest.mark.parametrize("seed", range(20))
def test_sainte_lague_takes_the_highest_quotients(seed):
    draw = random.Random(seed)
    n = draw.randint(1, 12)
    weights = [draw.choice((0, 1, 2, 5, draw.random() * 100)) for _ in range(n)]
    most = [draw.choice((0, 3, 1000)) for _ in range(n)]
    seats = draw.randint(0, 300)
    assert list(sainte_lague(weights, seats, most)) == highest_quotients(weights, seats, most)


def corpus(seed=1):
    draw = random.Random(seed)
    sources = ["a", "b", "B", None, "é", "z"] + ["hot"] * 6
    rows = [(k, " ".join("w" * draw.randint(1, 5) for _ in range(draw.choice((0, 1, 40, 200)))), draw.choice(sources), 0, "x") for k in range(600)]
    return rows + [(900, None, "a", 0, "x"), (901, "", None, 0, "x"), (None, "p q r", "z", 0, "x"), (5, "again", "a", 0, "x"), (5, "again", "a", 0, "x")]


def wanted(rows):
    """Targets by sharing the excess again and again."""
    sizes = defaultdict(int)
    for _, text, source, _, _ in rows:
        sizes[source] += len((text or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = budget - sum(2 * sizes[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        targets = {s: 2 * sizes[s] if s in full else rest * weight[s] / total for s in names}
        over = {s for s in names if s not in full and targets[s] > 2 * sizes[s]}
        if not over:
            return sizes, targets
        full |= over


def test_mix_meets_the_targets(frame):
    rows = corpus()
    sizes, targets = wanted(rows)
    docs = frame(rows, DOCS)
    found = mix(docs, carry=["doc_id"], shard_rows=100).collect()
    again = mix(docs.repartition(7), carry=["doc_id"], shard_rows=100).collect()
    assert Counter((r.row.doc_id, r.size, r.taken) for r in found) == Counter((r.row.doc_id, r.size, r.taken) for r in again)
    taken = Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        shards = 1 + len(rows) // 100
        assert abs(taken[s] - targets[s]) <= 16 + shards, s
    assert len(found) == len(rows)


def test_mixed_documents_hold_the_words_taken(frame):
    rows = corpus(2)
    docs = frame(rows, DOCS)
    words = Counter()
    for r in mixed_documents(docs).collect():
        words[r.source] += len((r.text or "").split())
    taken = Counter()
    for r in mix(docs).collect():
        taken[r.source] += r.taken
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n}
    assert mixed_documents(docs).columns == docs.columns
    assert mix(frame([], DOCS)).collect() == [] and mixed_documents(frame([], DOCS)).collect() == []


@pytest.mark.parametrize("seed", range(10))
def test_best_fit_takes_the_tightest_bin(seed):
    draw = random.Random(seed)
    sizes = [draw.randint(1, 60) for _ in range(300)]
    bins, left = best_fit_decreasing(np.array(sizes), capacity=100)
    room = []
    for i in sorted(range(300), key=lambda i: -sizes[i]):
        fits = [(r, k) for k, r in enumerate(room) if r >= sizes[i]]
        if not fits:
            room.append(100)
            fits = [(100, len(room) - 1)]
        room[min(fits)[1]] -= sizes[i]
    assert sorted(left) == sorted(room)
    assert sum(np.bincount(bins, sizes)) == sum(sizes) and np.bincount(bins, sizes).max() <= 100


def test_room_tree_is_a_sorted_set():
    draw, tree, held = random.Random(3), RoomTree(), []
    for k in range(3000):
        if held and draw.random() < 0.4:
            size = draw.randint(0, 1000)
            fits = [x for x in held if x[0] >= size]
            got = tree.take_fitting(size)
            assert got == (min(fits) if fits else None)
            if got:
                held.remove(got)
        else:
            item = (draw.randint(0, 1000), k)
            held.append(item)
            tree.add(*item)
    while held:
        assert tree.take_widest() == max(held)
        held.remove(max(held))


def test_shards_are_even_and_groups_whole(frame):
    draw = random.Random(4)
    texts = [draw.choice("abcé") * draw.randint(0, 400) for _ in range(1500)] + ["copy " * 30] * 900 + [None, "", None, "x" * 20000]
    rows = [(k if k % 50 else None, t, "s", 0, "y") for k, t in enumerate(texts)]
    found = balanced_shards(frame(rows, DOCS), shards=6).collect()
    assert len(found) == len(rows)
    load, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in found:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[r.text_crc32].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(load.values()) - min(load.values()) < 0.02 * sum(load.values()) / 6
    big = zlib.crc32(("copy " * 30).encode())
    assert all(len(v) == 1 for k, v in homes.items() if k != big)
    assert Counter((r.size, r.text_crc32) for r in found) == Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts)
    assert balanced_shards(frame([], DOCS)).collect() == []


def weighed(seed=3):
    """Texts from a byte to several shards of 3,000, copies, one text with a third of all rows, and odd rows."""
    draw = random.Random(seed)
    rows = [(k, "x" * draw.choice([0, 1, 3, 40, 300, 900, 1_400, 2_000]) + str(k % draw.choice([7, 400]))) for k in range(400)]
    rows += [(1_000 + k, "copy" * 20) for k in range(250)]
    return rows + [(2_000, "y" * 10_000), (2_001, "z" * 2_992), (None, "é" * 100), (None, None), (2_002, None), (2_003, "")]


@pytest.mark.parametrize("capacity, cell_shards", [(3_000, 1_000), (3_000, 20), (60_000, 1_000), (10**9, 1_000), (100, 50)])
def test_as_few_shards_of_a_capacity_as_needed(frame, capacity, cell_shards):
    rows = weighed()
    docs = frame([(d, t, 1, "c") for d, t in rows], "doc_id long, text string, shard long, cell string")
    found = fixed_capacity_shards(docs, capacity, cell_shards=cell_shards).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert sorted(((r.doc_id, r.size) for r in found), key=str) == sorted(((d, size(t)) for d, t in rows), key=str)
    held, homes, weight = {}, {}, {}
    for r in found:
        held.setdefault(r.shard, []).append(r.size)
        homes.setdefault((r.text_crc32, r.size), set()).add(r.shard)
        weight[r.text_crc32, r.size] = weight.get((r.text_crc32, r.size), 0) + r.size
    assert sorted(held) == list(range(len(held)))
    assert all(sum(s) <= capacity or len(s) == 1 for s in held.values())
    assert all(len(h) == 1 for g, h in homes.items() if weight[g] <= capacity)
    _, local = best_fit_decreasing(np.array([n for g, w in weight.items() for n in ([w] if w <= capacity else [g[1]] * (w // g[1]))]), capacity=capacity)
    cells = max(1, sum(map(sum, held.values())) // (capacity * cell_shards))
    assert len(held) <= len(local) * 1.05 + cells + 1


def test_capacity_without_documents(frame):
    docs = frame([], "doc_id long, text string")
    assert fixed_capacity_shards(docs, 10).collect() == []
    with pytest.raises(ValueError):
        fixed_capacity_shards(docs, 0)
