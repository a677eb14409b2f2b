import random
import re
from collections import Counter

from millgauge.llm.quality_rules import BASE_RULES, RULES, Rule, judge_text, keep_by_rules

DOCS = "doc_id long, text string, kept string, n_words string"
WORD = "[^\x20\x09-\x0d]+"


def brute(text, span=3):
    words = re.findall(WORD, text or "")
    windows = [tuple(words[i : i + span]) for i in range(len(words) - span + 1)]
    counts = Counter(windows)
    places = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(span)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(places)


def corpus():
    draw = random.Random(9)
    words = ["the", "The", "of,", "a#b", "été", "日本", "x", "|", "of", "…", " "]
    rows = [(k, "".join(draw.choice(words[: draw.randint(1, 11)]) + draw.choice([" ", "\n", "\t ", "\r\n"]) for _ in range(draw.randint(0, 90))), "k", "n") for k in range(300)]
    rows += [(400, None, "k", None), (401, "", "k", "n"), (402, " \n\t", None, "n"), (None, "the of x " * 40, "k", "n"), (403, "a b " * 40_000, "k", "n")]
    return rows + [(404, " ".join(f"the{k} of" for k in range(30_000)), "k", "n"), (405, "x" * 300_000, "k", "n")] * 2


def test_measures_as_by_counting(frame):
    rows = corpus()
    for span in (3, 2):
        found = judge_text(frame(rows, DOCS), span=span).collect()
        got = sorted(((r.row.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found), key=str)
        expected = [(d, *(m := brute(t, span)), m[0] < 50 or 100 * m[4] > 50 * m[0]) for d, t, *_ in rows]
        assert got == sorted(expected, key=str)
        assert {r.row.kept for r in found} == {"k", None}


def failed(frame, text):
    return judge_text(frame([(1, text)], "doc_id long, text string")).first().failed


def test_each_rule_fails_what_it_names(frame):
    draw = random.Random(4)
    plain = [f"{draw.choice(['the', 'of', 'and', 'to'])} {''.join(draw.choices('abcdefgh', k=6))}" for _ in range(60)]
    line = lambda words, k=10: "\n".join(" ".join(words[i : i + k]) for i in range(0, len(words), k))
    assert failed(frame, line(plain)) == []
    assert failed(frame, line(plain[:20])) == ["enough words"]
    assert failed(frame, line([p + "$$" for p in plain])) == ["few symbols"]
    assert failed(frame, line([p.upper() + "!!" for p in plain])) == ["few shouted words"]
    assert failed(frame, line([p.replace("a", "1").split()[1] + "q" for p in plain])) == ["stop words"]
    assert failed(frame, line([f"the {k}" for k in range(100, 160)])) == ["words of letters"]
    assert failed(frame, line([p + "..." for p in plain], 1)) == ["few broken lines"]
    assert failed(frame, line(["-is " + p for p in plain], 1)) == ["few listed lines"]
    assert failed(frame, line(plain) + "\nthe same line" * 4) == ["few repeated lines"]
    assert failed(frame, line([p.split()[0] + " " + p.split()[1] * 6 for p in plain])) == ["length of words"]
    assert failed(frame, "the same few words of it " * 20) == ["no repeated passages"]


def test_a_share_at_its_bound_is_allowed(frame):
    """The first of equal lines repeats none: 3 of 10 lines are the 30 percent allowed, 4 of 11 are above."""
    draw = random.Random(4)
    plain = [f"{draw.choice(['the', 'of', 'and', 'to'])} {''.join(draw.choices('abcdefgh', k=6))}" for _ in range(60)]
    lines = ["\n".join(" ".join(plain[i : i + 10]) for i in range(0, 60, 10))]
    assert failed(frame, "\n".join(lines + ["the same line"] * 4)) == []
    assert failed(frame, "\n".join(lines + ["the same line"] * 5)) == ["few repeated lines"]
    assert failed(frame, " ".join(p.split()[0] + " " + p.split()[1] * 6 for p in plain)) == ["length of words"]
    assert failed(frame, "the same few words of it " * 20) == ["no repeated passages"]


def test_another_table_of_rules(frame):
    docs = frame([(1, "one two"), (2, "one"), (3, None)], "doc_id long, text string")
    kept = keep_by_rules(docs, base=(), rules=[Rule("two", "n_words", low=2)])
    assert [tuple(r) for r in kept.collect()] == [(1, "one two")]
    share = Rule("share", "n_stop_words", "n_words", low=1)
    assert keep_by_rules(docs, base=[share], rules=(), stop_words=["one"]).count() == 2


def test_one_projection_without_user_functions(frame):
    plan = judge_text(frame(corpus()[:5], DOCS))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Exchange", "Python", "Arrow", "Pandas", "Window"))
    assert len({r.name for r in [*BASE_RULES, *RULES]}) == len(BASE_RULES) + len(RULES)


def test_no_documents(frame):
    assert judge_text(frame([], DOCS)).collect() == []
