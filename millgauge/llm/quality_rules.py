"""Rule-based document quality: a table of thresholds compiled into columns of one projection.

A rule bounds the ratio of two measures of a text. Measures are built-in expressions over the text, its words
and its lines; only those that a table of rules uses are computed. Nothing is shuffled and no user function
runs, so a row costs what its own text costs.

A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Words of a window whose repetition counts.
SPAN = 3

#: Common function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is it for on as was are by this from or at "
    "de la le les des et un une du en que qui dans est pour par sur au il elle ne pas plus "
    "der die das und den von zu mit ist im ein eine nicht dem auf als auch sich es "
    "el los las del y se por con para su al lo como más o pero sus ha"
).split()


@dataclass(frozen=True)
class Rule:
    """``low`` <= 100 * part / whole <= ``high``, in whole numbers; a missing bound does not bind.

    Without a ``whole`` the part itself is compared. A text whose ``whole`` is 0 keeps the rule only if
    ``low`` is missing or 0.
    """

    name: str
    part: str
    whole: str | None = None
    low: int | None = None
    high: int | None = None

    def holds(self) -> Column:
        part = F.col(self.part)
        scaled, by = (part, F.lit(1)) if self.whole is None else (100 * part, F.col(self.whole))
        out = F.lit(True)
        if self.low is not None:
            out &= scaled >= self.low * by
            if self.whole is not None and self.low > 0:
                out &= by > 0
        if self.high is not None:
            out &= scaled <= self.high * by
        return out


#: A text that breaks one of these fails before the other rules count.
BASE_RULES = (
    Rule("enough words", "n_words", low=50),
    Rule("no repeated passages", "n_repeat_words", "n_words", high=50),
)
#: The other thresholds, percentages but for the length of a word (characters of 100 words).
RULES = (
    Rule("length of words", "word_chars", "n_words", low=250, high=1_200),
    Rule("few symbols", "n_symbols", "n_words", high=10),
    Rule("words of letters", "n_letter_words", "n_words", low=70),
    Rule("few shouted words", "n_shouted_words", "n_words", high=30),
    Rule("stop words", "n_stop_words", "n_words", low=5),
    Rule("few repeated lines", "n_dup_lines", "n_full_lines", high=30),
    Rule("few listed lines", "n_listed_lines", "n_full_lines", high=90),
    Rule("few broken lines", "n_broken_lines", "n_full_lines", high=30),
)


def repeated_words(words: Column, span: int = SPAN) -> Column:
    """Words that lie in a window of ``span`` words which the array holds twice or more.

    Windows are sorted with their places, so equal ones are neighbours; the places that have an equal
    neighbour are put in order, and each adds what its window covers beyond the one before.
    """
    shifted = [F.slice(words, k + 1, F.size(words)).alias(f"w{k}") for k in range(span)]
    whole = F.slice(F.arrays_zip(*shifted), 1, F.greatest(F.size(words) - span + 1, F.lit(0)))
    fields = [f"w{k}" for k in range(span)]
    listed = F.sort_array(F.transform(whole, lambda x, i: F.struct(*[x[f].alias(f) for f in fields], i.alias("at"))))

    def places_of(sorted_: Column) -> Column:
        def equal(x: Column, y: Column) -> Column:
            out = F.lit(True)
            for f in fields:
                out &= x[f] == y[f]
            return out

        same = lambda x, i: equal(F.get(sorted_, i - 1), x) | equal(F.get(sorted_, i + 1), x)
        return F.sort_array(F.transform(F.filter(sorted_, same), lambda x: x["at"]))

    # the array of one element binds the sorted windows to a name, so they are built once
    repeated = F.transform(F.array(listed), places_of)[0]
    start = F.struct(F.lit(-span).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        repeated,
        start,
        lambda state, p: F.struct(p.alias("last"), (state["n"] + F.least(F.lit(span), p - state["last"])).alias("n")),
        lambda state: state["n"],
    )


def count_of(values: Column, holds: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(values, holds))


def measures(text: Column, words: Column, lines: Column, stop_words: Sequence[str], span: int) -> dict[str, Column]:
    """Every measure by name. ``lines`` are those that hold a word."""
    plain = lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?")))
    return {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOL)),
        "n_letter_words": count_of(words, lambda w: F.rlike(w, F.lit(r"\p{L}"))),
        "n_shouted_words": count_of(words, lambda w: F.rlike(w, F.lit(r"(?s)\p{Lu}.*\p{Lu}")) & ~F.rlike(w, F.lit(r"\p{Ll}"))),
        "n_stop_words": count_of(words, lambda w: plain(w).isin(list(stop_words))),
        "n_repeat_words": repeated_words(words, span),
        "n_full_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_listed_lines": count_of(lines, lambda x: F.rlike(x, F.lit(r"^[\x20\x09-\x0D]*[-*•]"))),
        "n_broken_lines": count_of(lines, lambda x: F.rlike(x, F.lit(r"(\.\.\.|…)[\x20\x09-\x0D]*\z"))),
    }


def judge_text(
    docs: DataFrame,
    text_col: str = "text",
    base: Sequence[Rule] = BASE_RULES,
    rules: Sequence[Rule] = RULES,
    stop_words: Sequence[str] = STOP_WORDS,
    span: int = SPAN,
    also: Sequence[str] = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
) -> DataFrame:
    """Every row as ``row``, with the measures ``also`` (long), base_failed, failed (names of broken rules), kept.

    Defined results: null, empty and blank texts have no words, so all measures are 0, and the rules decide
    (with the given base they fail); a null id changes nothing; repeated rows are judged alike; ties do not
    occur, as a bound belongs to what it allows; an empty table gives an empty table; the columns of the
    rows stay inside ``row`` and clash with nothing.
    """
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    split = docs.select(F.struct("*").alias("row")).withColumns(
        {
            "_words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
            "_lines": F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(WORD))),
        }
    )
    used = dict.fromkeys([*also, *(m for r in [*base, *rules] for m in (r.part, r.whole) if m)])
    known = measures(text, F.col("_words"), F.col("_lines"), stop_words, span)
    measured = split.select("row", *[known[m].cast("long").alias(m) for m in used])
    broken = [F.when(~r.holds(), F.lit(r.name)) for r in [*base, *rules]]
    base_failed = F.lit(False)
    for r in base:
        base_failed |= ~r.holds()
    out = measured.select("row", *also, base_failed.alias("base_failed"), F.array_compact(F.array(*broken)).alias("failed"))
    return out.withColumn("kept", F.size("failed") == 0)


def keep_by_rules(docs: DataFrame, text_col: str = "text", **given) -> DataFrame:
    """The rows that break no rule, whole. Nulls, repeated rows and empty tables as in ``judge_text``."""
    return judge_text(docs, text_col, also=(), **given).where("kept").select("row.*")
