import json
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from millgauge.llm.packing import Encoder, pack

FILE = str(public_tokenizers.path("byte_bpe_50k.json"))
DOCS = "doc_id long, text string, source string, n long, ids string"


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(FILE)
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return Encoder(open(FILE, encoding="utf-8").read())


def test_ids_are_those_of_the_tokenizer(spark, whole, encoder):
    assert encoder.words is not None
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        if r.text:
            assert list(np.frombuffer(encoder(r.text), "<u4")) == whole(r.text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("ab 's\n\té\u00a0\u3000\u2028.,12'!ßЖ中\x85\x1c")), max_size=30) | st.text(max_size=20))
def test_ids_of_any_text(text):
    t = test_ids_of_any_text
    if not hasattr(t, "both"):
        tokens = Tokenizer.from_file(FILE)
        t.both = Encoder(open(FILE, encoding="utf-8").read()), tokens
    own, tokens = t.both
    assert list(np.frombuffer(own(text), "<u4")) == tokens.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_are_used_as_they_are():
    file = str(public_tokenizers.path("word_bpe_49k.json"))
    own = Encoder(open(file, encoding="utf-8").read())
    assert own.words is None
    assert list(np.frombuffer(own("Some Words"), "<u4")) == Tokenizer.from_file(file).encode("Some Words", add_special_tokens=False).ids


def corpus():
    rows = [(k, f"word{k} " * (k % 50), ["a", "b", None, "hot", "hot", "hot"][k % 6], 0, "x") for k in range(400)]
    return rows + [(900, None, "a", 0, "x"), (901, "", "a", 0, "x"), (None, "no id", "a", 0, "x"), (5, "same id", "b", 0, "x"), (5, "same id", "b", 0, "x"), (902, "long text, " * 9000, "c", 0, "x")]


def test_windows_round_trip(frame, whole):
    rows = corpus()
    pieces = pack(frame(rows, DOCS), FILE, window=256, packet=64).collect()
    docs, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[(p.row, p.doc_id, p.doc_tokens)].append((p.start, p.length, bytes(p.ids)))
        windows[p.sequence_id].append((p.offset, p.length))
    got = []
    for (_, doc_id, n), parts in docs.items():
        parts.sort()
        assert [p[0] for p in parts] == list(np.cumsum([0] + [p[1] for p in parts])[:-1])
        ids = b"".join(p[2] for p in parts)
        assert len(ids) == 4 * n
        got.append((doc_id, ids))
    expected = [(d, np.array([*whole(t or ""), 1], "<u4").tobytes()) for d, t, *_ in rows]
    key = lambda x: (str(x[0]), x[1])
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert sorted(windows) == list(range(len(windows)))
    for w, parts in windows.items():
        parts.sort()
        assert [p[0] for p in parts] == list(np.cumsum([0] + [p[1] for p in parts])[:-1])
        if w < len(windows) - 1:
            assert sum(p[1] for p in parts) == 256


def test_windows_hold_the_proportions(frame):
    rows = [(k, f"w{k} " * 40, "ab"[k % 2], 0, "x") for k in range(600)]
    pieces = pack(frame(rows, DOCS), FILE, proportions={"a": 3, "b": 1}, window=512, packet=64).collect()
    own = {d: s for d, _, s, *_ in rows}
    tokens = defaultdict(lambda: defaultdict(int))
    for p in pieces:
        tokens[p.sequence_id][own[p.doc_id]] += p.length
    total = defaultdict(int)
    for r in pieces:
        total[own[r.doc_id]] += r.length
    both = int(total["a"] / (512 * 0.75)) - 1  # windows until the larger share is used up
    sums = defaultdict(int)
    for w in range(both):
        for s in "ab":
            sums[s] += tokens[w][s]
        assert abs(sums["a"] - 0.75 * 512 * (w + 1)) <= 2 * 64 + 1  # the deficit that is carried
    assert sum(total.values()) == sum(sum(t.values()) for t in tokens.values())


def test_round_robin_is_that_of_a_queue_by_queue_run(frame):
    """The order of packets is the one that deficit counters give."""
    rows = [(k, f"w{k} " * (1 + k % 30), "abc"[k % 3], 0, "x") for k in range(90)]
    shares = {"a": 4.0, "b": 2.0, "c": 1.0}
    pieces = pack(frame(rows, DOCS), FILE, proportions=shares, window=10**6, packet=32).collect()
    own = {d: s for d, _, s, *_ in rows}
    order = sorted(pieces, key=lambda p: p.offset)
    queues = {s: [p for p in order if own[p.doc_id] == s] for s in shares}
    quantum = {s: shares[s] / 7 * 10**6 for s in shares}
    expected, deficit = [], dict.fromkeys(shares, 0.0)
    while any(queues.values()):
        for s in sorted(queues):
            if queues[s]:
                deficit[s] += quantum[s]
                while queues[s] and queues[s][0].length <= deficit[s]:
                    deficit[s] -= queues[s][0].length
                    expected.append(queues[s].pop(0))
    assert order == expected


def test_empty_table_and_checksum(spark, frame):
    assert pack(frame([], DOCS), FILE).collect() == []
    one = pack(frame([(1, "a", "s", 0, "x")], DOCS), FILE).selectExpr("crc32(ids) AS c").first().c
    assert one == zlib.crc32(np.array([64, 1], "<u4").tobytes())
    with pytest.raises(ValueError):
        pack(frame([], DOCS), FILE, window=8, packet=9)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext|", "<", "|>", "a", "b", " ", "  ", "\n", "'s", "é", "1"]), max_size=12).map("".join))
def test_added_tokens_in_a_text_are_ids_of_their_own(text):
    t = test_added_tokens_in_a_text_are_ids_of_their_own
    if not hasattr(t, "both"):
        t.both = Encoder(open(FILE, encoding="utf-8").read()), Tokenizer.from_file(FILE)
    own, tokens = t.both
    assert list(np.frombuffer(own(text), "<u4")) == tokens.encode(text, add_special_tokens=False).ids
    assert list(np.frombuffer(own("a <|endoftext|> b"), "<u4")) == [64, 220, 50256, 275]


def test_added_tokens_of_other_tokenizers():
    file = str(public_tokenizers.path("word_bpe_49k.json"))
    own, text = Encoder(open(file, encoding="utf-8").read()), "a <|endoftext|> b<|startoftext|>"
    ids = Tokenizer.from_file(file).encode(text, add_special_tokens=False).ids
    assert 49407 in ids and list(np.frombuffer(own(text), "<u4")) == ids


def test_added_tokens_with_rules_are_left_to_the_tokenizer():
    spec = json.load(open(FILE, encoding="utf-8"))
    spec["added_tokens"][0]["lstrip"] = True
    own, tokens = Encoder(json.dumps(spec)), Tokenizer.from_str(json.dumps(spec))
    for text in ("a  <|endoftext|> b", "<|endoftext|>", "a b"):
        assert list(np.frombuffer(own(text), "<u4")) == tokens.encode(text, add_special_tokens=False).ids


def test_packed_documents_hold_added_tokens(frame):
    found = pack(frame([(1, "a <|endoftext|> b", "s", 0, "x")], DOCS), FILE).collect()
    assert [(list(np.frombuffer(bytes(r.ids), "<u4")), r.doc_tokens) for r in found] == [([64, 220, 50256, 275, 1], 5)]


def test_a_source_without_a_proportion_is_an_error(frame):
    docs = frame([(k, "some words", ["a", "b", None][k % 3], 0, "x") for k in range(9)], DOCS)
    for given in ({"a": 1.0, "b": 1.0}, {"a": 1.0, None: 2.0}):
        with pytest.raises(ValueError, match="without a proportion"):
            pack(docs, FILE, proportions=given)
    whole = pack(docs, FILE, proportions={"a": 1.0, "b": 1.0, None: 2.0, "unused": 1.0})
    assert {r.doc_id for r in whole.collect()} == set(range(9))


def test_ids_of_many_texts(spark, whole, encoder):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    texts += [f"{a}{s}{b}" for s in spaces for a in ("", "x", "x ", " ", "x.") for b in ("", "y", " y", " y z", "\u0300 z")]
    texts += [None, "", " ", "  two", "a b", "a <|endoftext|> b", "a<|endoftext|", "same same  same", "x" * 3_000]
    expected = [np.array(whole(t or ""), "<u4").tobytes() for t in texts]
    for part in (slice(None), slice(7, 900), slice(-9, None), slice(-9, -8), slice(0, 0)):
        assert encoder.many(pa.array(texts, pa.string())[part]) == expected[part]
    file = str(public_tokenizers.path("word_bpe_49k.json"))
    other = Encoder(open(file, encoding="utf-8").read())
    assert other.many(pa.array(["a b", None, ""])) == [other("a b"), b"", b""]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from(list("ab 's\n\té\u00a0\u3000\u2028.,12'!ßЖ中\x85\x1c")), max_size=20) | st.text(max_size=9), max_size=6))
def test_ids_of_any_texts(texts):
    t = test_ids_of_any_texts
    if not hasattr(t, "own"):
        t.own = Encoder(open(FILE, encoding="utf-8").read())
    assert t.own.many(pa.array(texts, pa.string())) == [t.own.ids(x or "") for x in texts]


def test_many_texts_encode_a_distinct_word_once(monkeypatch):
    own = Encoder(open(FILE, encoding="utf-8").read())
    texts = ["start " + " ".join(f"w{k}x{j % 7}" for j in range(200)) for k in range(50)] * 20
    seen = []
    for name in ("ids", "long_ids"):
        monkeypatch.setattr(own, name, lambda text, run=getattr(own, name): (seen.append(len(text)), run(text))[1])
    own.words.encode = own.ids
    own.many(pa.array(texts))
    assert sum(seen) < 10 * (50 * 7 + len(texts)) and len(seen) == 1 + len(texts)
