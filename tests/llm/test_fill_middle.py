import hashlib
import random
import re

import numpy as np
import pytest

from millgauge.llm import fill_middle
from millgauge.llm.fill_middle import Memory, Units, chunk_ends, fill_in_middle, restored

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, row string, output string"


def brute(doc, text, percent=50):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return doc, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def corpus(seed=2):
    draw = random.Random(seed)
    words = ["a", "été", "日本語", "x" * 70, "<", "<S", "P>", ">", "word,", " ", "😀", " "]
    blanks = [" ", "\n", "  \t", "\r\n", "\x0b", "\x0c "]
    text = lambda n: draw.choice(["", " "]) + "".join(draw.choice(words) + draw.choice(blanks) for _ in range(n)) + draw.choice(["", "end"])
    shared = text(800)
    rows = [(k, text(draw.randint(0, 40)), "r", "o") for k in range(300)]
    rows += [(400 + k, text(3) + shared + text(k), "r", None) for k in range(30)]
    rows += [(500, None, "r", "o"), (501, "", "r", "o"), (502, " \n ", None, "o"), (None, "a b c d e f", "r", "o"), (503, "y" * 50_000, "r", "o")]
    rows += [(504 + k, f"a <{c}> b c", "r", "o") for k, c in enumerate("PSMps")]
    return rows + [(600, shared * 40, "r", "o")] * 2 + [(601, " " * 30_000 + "x", "r", "o"), (602, "é" * 40_000 + " z", "r", "o")]


@pytest.mark.parametrize("percent", [50, 100])
def test_texts_are_cut_as_by_the_pattern(frame, percent):
    rows = corpus()
    found = fill_in_middle(frame(rows, DOCS), percent=percent).withColumn("back", restored("output", "form")).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found), key=str)
    assert got == sorted((brute(d, t, percent) for d, t, *_ in rows), key=str)
    assert sorted(r.back for r in found) == sorted(t or "" for _, t, *_ in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert {(r.row.row, r.row.output) for r in found} >= {("r", "o"), ("r", None), (None, "o")}


def test_every_cut_of_a_text(monkeypatch):
    for bits, longest in ((3, 40), (10, 8_192)):
        monkeypatch.setattr(fill_middle, "CUT_BITS", bits)
        monkeypatch.setattr(fill_middle, "CHUNK_BYTES", longest)
        monkeypatch.setattr(fill_middle, "REMEMBERED_BYTES", 2_000)
        memory = Memory()
        for _, text, *_ in corpus(5)[:330]:
            data = (text or "").encode()
            edges = chunk_ends(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
            units = Units(data, edges[1:].tolist() if len(edges) > 1 else [], memory)
            ends = np.cumsum([0] + [len(u) for u in UNIT.findall(text or "")])
            assert units.total == len(ends) - 1
            for k, chars in enumerate(ends):
                assert units.end(k) == (len((text or "")[:chars].encode()), chars)


def test_shared_passages_give_shared_chunks():
    draw = random.Random(1)
    passage = " ".join("".join(draw.choices("abcdefg", k=6)) for _ in range(3_000)).encode()
    memory = Memory()
    for k in range(20):
        data = b"x" * (7 * k + 1) + b" " + passage
        edges = chunk_ends(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        Units(data, edges[1:].tolist(), memory)
    assert sum(map(len, memory)) < 2 * len(passage)


def test_chunks_do_not_depend_on_other_texts():
    draw = random.Random(3)
    texts = [draw.randbytes(draw.randint(0, 9_000)) for _ in range(30)]
    cuts = np.cumsum([0] + [len(t) for t in texts])
    together = chunk_ends(np.frombuffer(b"".join(texts), np.uint8), cuts)
    for text, low, high in zip(texts, cuts, cuts[1:]):
        alone = chunk_ends(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert together[(together >= low) & (together <= high)].tolist() == (alone + low).tolist()


def test_sentinels_that_could_be_mistaken(frame):
    docs = frame([(1, "a b")], "doc_id long, text string")
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "<P>x", "<M>"), ("<<P", "<S>", "<M>"), ("", "a", "b")):
        with pytest.raises(ValueError):
            fill_in_middle(docs, sentinels=bad)


def test_no_documents(frame):
    assert fill_in_middle(frame([], DOCS)).collect() == []
