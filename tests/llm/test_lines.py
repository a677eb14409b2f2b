import random

from millgauge.llm.line_dedup import dedup_lines

DOCS = "doc_id long, text string, row string, lines string"


def brute(rows, min_docs, min_chars):
    upper = {chr(65 + k): chr(97 + k) for k in range(26)}
    key = lambda line: "".join(upper.get(c, c) for c in line.strip(" \t\n\x0b\f\r"))
    counts = {}
    for _, text, *_ in rows:
        for k in {key(line) for line in (text or "").split("\n")}:
            counts[k] = counts.get(k, 0) + 1
    gone = {k for k, n in counts.items() if n >= min_docs and len(k) >= min_chars}
    out = []
    for d, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if key(line) not in gone]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def corpus():
    draw = random.Random(5)
    lines = ["Share me", " share ME\t", "Été", "été", "", "  ", "x"] + [f"own line {k}" for k in range(300)]
    rows = [(k, "\n".join(draw.choice(lines[:7] if draw.random() < 0.3 else lines) for _ in range(draw.randint(0, 30))), "r", "l") for k in range(120)]
    rows += [(200 + k, "copied\nwhole text\n", "r", "l") for k in range(12)]
    return rows + [(300, None, None, "l"), (301, "", "r", None), (None, "share me\nalone", "r", "l"), (302, "\n" * 5000 + "x", "r", "l")]


def test_lines_go_as_by_counting(frame):
    rows = corpus()
    found = dedup_lines(frame(rows, DOCS), min_docs=10).collect()
    got = [(r.row.doc_id, r.kept_text or "", r.n_lines, r.n_dropped) for r in found]
    assert sorted(got, key=str) == sorted(brute(rows, 10, 1), key=str)
    assert {r.row.lines for r in found} == {"l", None}


def test_batches_do_not_change_what_goes(frame):
    docs = frame(corpus(), DOCS)
    runs = [
        sorted(dedup_lines(docs, min_docs=10, min_chars=3, batches=b, fanout=f).select("row.doc_id", "kept_text").collect(), key=str)
        for b, f in ((1, 2), (5, 2), (3, 4))
    ]
    assert runs[0] == runs[1] == runs[2]


def test_the_first_document_keeps_its_lines(frame):
    rows = corpus()
    found = dedup_lines(frame(rows, DOCS), min_docs=10, keep_first=True).collect()
    copies = [r for r in found if 200 <= (r.row.doc_id or 0) < 212]
    assert sorted(r.n_dropped for r in copies) == [0] + [2] * 11
    assert next(r for r in copies if not r.n_dropped).row.doc_id == 200
    shared = [r for r in found if "share me" in (r.kept_text or "").lower()]
    assert len(shared) == 1


def test_no_documents(frame):
    assert dedup_lines(frame([], DOCS)).collect() == []
