"""Fill-in-middle transformation: prefix, middle and suffix of a text, rearranged around sentinels.

A unit is a word with the blanks before it; blanks at the end of a text are a unit of their own. To cut after
a given unit without reading every text twice, texts are chunked where a rolling hash of their bytes hits a
pattern, so equal passages give equal chunks wherever they stand. A task remembers what it found in a chunk:
how many words begin in it, whether its first and last bytes belong to a word, where its first blank is, and
how many characters it holds. The memory is keyed by the bytes of the chunk, so a chunk is never taken for another
one. Running sums over the chunks of a text, with a word that reaches over a border counted once, give the
number of units and the chunk that holds a cut; only that chunk is searched.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from millgauge.llm.words import mixed, runs, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of the rolling window, binary logarithm of the mean distance of cuts, and the longest chunk.
WINDOW, CUT_BITS, CHUNK_BYTES = 32, 10, 8_192
#: A task forgets its chunks when they hold this many bytes.
REMEMBERED_BYTES = 32 << 20

BLANKS = b" \t\n\x0b\x0c\r"
CONTINUED = bytes(range(0x80, 0xC0))  # bytes of a character after its first one


class Chunk:
    """What is known of a chunk. ``first_blank`` is its length if it has no blank."""

    __slots__ = ("words", "begins", "ends", "first_blank", "chars")
    word = re.compile(rb"[^ \t\n\x0b\x0c\r]+")
    blank = re.compile(rb"[ \t\n\x0b\x0c\r]")

    def __init__(self, data: bytes) -> None:
        self.words = len(self.word.findall(data))
        self.begins, self.ends = data[0] not in BLANKS, data[-1] not in BLANKS
        found = self.blank.search(data)
        self.first_blank = found.start() if found else len(data)
        self.chars = characters(data)


def characters(data: bytes) -> int:
    """Code points that begin in these UTF-8 bytes."""
    return len(data.translate(None, CONTINUED))


class Memory(dict):
    """Chunks by their bytes."""

    held = 0

    def __missing__(self, data: bytes) -> Chunk:
        if self.held > REMEMBERED_BYTES:
            self.clear()
            self.held = 0
        self.held += len(data) + 200
        found = self[data] = Chunk(data)
        return found


def chunk_ends(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where chunks end: at the ends of texts (``cuts``), where the rolling hash says so, and in long stretches."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
    sums = np.concatenate([np.zeros(1, np.uint32), np.cumsum(values[data], dtype=np.uint32)])
    rolling = sums[WINDOW:] - sums[:-WINDOW] if len(sums) > WINDOW else sums[:0]
    hit = np.flatnonzero((rolling * np.uint32(0x9E3779B1)) >> np.uint32(32 - CUT_BITS) == 0) + WINDOW
    start = cuts[np.searchsorted(cuts, hit, "left") - 1]  # a window must not reach into the text before
    edges = np.union1d(cuts, hit[hit - start >= WINDOW])
    gaps = np.diff(edges)
    long = np.flatnonzero(gaps > CHUNK_BYTES)
    if len(long):
        more = [np.arange(edges[k] + CHUNK_BYTES, edges[k + 1], CHUNK_BYTES) for k in long]
        edges = np.union1d(edges, np.concatenate(more))
    return edges


class Units:
    """The units of one text, from its chunks."""

    def __init__(self, data: bytes, ends: list[int], memory: Memory) -> None:
        self.data, self.edges = data, [0, *ends]
        self.chunks = [memory[data[a:b]] for a, b in zip(self.edges, ends)]
        count = np.array([c.words for c in self.chunks], np.int64)
        begins = np.array([c.begins for c in self.chunks], bool)
        stops = np.array([c.ends for c in self.chunks], bool)
        count[1:] -= begins[1:] & stops[:-1]  # a word that reaches over the border is counted once
        self.upto = np.cumsum(count)
        self.words = int(self.upto[-1]) if len(count) else 0
        self.total = self.words + int(len(data) > 0 and not stops[-1])

    def end(self, unit: int) -> tuple[int, int]:
        """(bytes, characters) of the first units, so many of them."""
        if unit <= 0:
            return 0, 0
        if unit > self.words:
            return len(self.data), sum(c.chars for c in self.chunks)
        k = int(np.searchsorted(self.upto, unit))
        chunk, low, high = self.chunks[k], self.edges[k], self.edges[k + 1]
        joined = k > 0 and chunk.begins and self.chunks[k - 1].ends
        skip = unit - (int(self.upto[k - 1]) if k else 0) + int(joined)  # which word of the chunk it is
        at = low
        for _, found in zip(range(skip), Chunk.word.finditer(self.data, low, high)):
            at = found.end()
        while at == high and k + 1 < len(self.chunks):  # it may go on in the next chunks
            k, low, high = k + 1, high, self.edges[k + 2]
            at = low + self.chunks[k].first_blank
        return at, sum(c.chars for c in self.chunks[:k]) + characters(self.data[low:at])


def drawn(id_col: str, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 50,
    spm_percent: int = 80,
    seed: int = 42,
    sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output, row) of every row.

    ``n`` is the number of units, ``form`` plain, psm (prefix, suffix, middle) or spm (suffix, prefix,
    middle). ``percent`` of the rows are transformed, ``spm_percent`` of those as spm; the id draws both
    and the two cuts. ``row`` is the whole row of ``docs`` without its text.

    Defined results: null and empty texts are plain with 0 units and an empty output; a text that holds a
    sentinel stays plain; blank texts are one unit; parts may be empty; a null id draws from the seed
    alone; repeated rows, and texts of one id, use the same numbers; an empty table gives an empty table;
    other columns stay inside ``row``.
    """
    p, s, m = marks = [x.encode() for x in sentinels]
    if not all(marks) or any(x[:1] in y[1:] for x in marks for y in marks):
        raise ValueError("no sentinel may hold the first byte of one behind its own first byte")
    if sum(y.startswith(x) for x in marks for y in marks) > len(marks):
        raise ValueError("no sentinel may begin with another one")

    def turn(batches):
        memory = Memory()
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            numbers = [batch.column(k).to_pylist() for k in range(2, 6)]
            for first, last in runs(offsets):
                base = offsets[first]
                part = data[base : offsets[last]]
                cuts = offsets[first : last + 1] - base
                edges = chunk_ends(part, cuts)
                places = np.searchsorted(edges, cuts)
                whole = part.tobytes()
                rows = []
                for k in range(last - first):
                    low, high = int(cuts[k]), int(cuts[k + 1])
                    text = whole[low:high]
                    units = Units(text, (edges[places[k] + 1 : places[k + 1] + 1] - low).tolist(), memory)
                    n = units.total
                    h1, h2, h3, h4 = (x[first + k] for x in numbers)
                    if not text or h3 % 100 >= percent or p in text or s in text or m in text:
                        rows.append((n, "plain", None, None, text))
                        continue
                    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                    (x, chars), (y, upto) = units.end(a), units.end(b)
                    before, middle, after = text[:x], text[x:y], text[y:]
                    if h4 % 100 < spm_percent:
                        rows.append((n, "spm", chars, upto - chars, b"".join((s, after, p, before, m, middle))))
                    else:
                        rows.append((n, "psm", chars, upto - chars, b"".join((p, before, s, after, m, middle))))
                n, form, chars, middle, output = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(n, pa.int64()),
                        pa.array(form, pa.string()),
                        pa.array(chars, pa.int64()),
                        pa.array(middle, pa.int64()),
                        pa.array(output, pa.binary()).cast(pa.string()),
                    ],
                    names=["row", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    narrow = docs.select(F.struct(*others).alias("row"), F.col(text_col).cast("string").alias("text"), *drawn(id_col, seed))
    kind = StructType([narrow.schema["row"]])
    for name, type_ in (("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string")):
        kind = kind.add(name, type_)
    found = narrow.mapInArrow(turn, kind)
    return found.select(F.col(f"row.{id_col}").alias(id_col), "n", "form", "prefix_chars", "middle_chars", "output", "row")


def restored(output: str, form: str, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output was made of, from the output and its form."""
    p, s, m = sentinels
    out = F.col(output)

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        """What stands behind each sentinel; no part holds one, so the first place is the right one."""
        rest = F.substring_index(out, first, -1)
        one, rest = F.substring_index(rest, second, 1), F.substring_index(rest, second, -1)
        return one, F.substring_index(rest, m, 1), F.substring_index(rest, m, -1)

    a, c, b = parts(p, s)
    psm = F.concat(a, b, c)
    c, a, b = parts(s, p)
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", F.concat(a, b, c)).otherwise(out)
