"""Packing documents into windows by deficit round-robin over source queues.

Every source is a queue of packets, cut from its documents in a seeded order. In each turn a queue gets its
share of one window as credit and sends packets while the credit that it has carried covers them. As the
queues are filled from the start, a packet whose tokens end at place b of its queue leaves in turn
ceil(b / quantum), with the deficits of all turns before it contained in b; so the turns of all packets
are known from running sums, and the order (turn, source, place) is that of the round-robin, over windows
and partitions alike. Running sums are taken per bounded range and offset by the sums of the ranges.

The stream is cut every ``window`` tokens; only the last window can be short.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from millgauge.sources.staged import cut_lineage, scratch

WINDOW, PACKET, END = 2_048, 512, 1
#: Rows, and turns, of a range that one task numbers (speed only).
RANGE_ROWS, RANGE_TURNS = 20_000, 4_000
#: Words whose ids an encoder remembers; it starts anew when there are more.
REMEMBERED = 300_000
#: Bytes of text that a task encodes at once, but for a longer text (speed only).
AT_ONCE = 2_000_000

#: Fixed value: the split pattern of byte-level tokenizers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Words(dict):
    """Ids of a space and a word, as bytes of little-endian 32-bit numbers."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise KeyError(word)
        ids = self.encode(" " + word)
        if len(word) <= 64:
            self[word] = ids
        return ids


class Encoder:
    """Token ids of texts by a tokenizer file, without the special tokens that it would add to a text.

    The file's added tokens that stand in a text are ids of their own, as in the tokenizer.

    A byte-level tokenizer never joins a space between two other visible characters to what stands before
    it, so a text is cut there: of single texts the ids of a word are remembered, of many texts each distinct
    word is encoded once. With the plain vocabulary (ids in the order of the merges) the words are encoded by
    tiktoken, which gives the same ids as the tokenizer and is faster; any other file is used through its
    tokenizer.
    """

    def __init__(self, file: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(file)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) == ("ByteLevel", False, True)
        plain = plain and model["type"] == "BPE" and not spec.get("normalizer") and not model.get("ignore_merges")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])] if plain else []
        plain = plain and all(model["vocab"].get(a + b) == 256 + k for k, (a, b) in enumerate(merges))
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t["content"]}
        plain = plain and not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip"))
        self.cut, self.added = None, {}
        if plain:
            back = self.byte_of()
            if added:
                self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
                self.added = {t: np.array([n], "<u4").tobytes() for t, n in added.items()}
            ranks = {bytes(back[c] for c in t): n for t, n in model["vocab"].items() if t not in added}
            own = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
            self.bytes_of[list(ranks.values())] = list(map(len, ranks))
            self.long_ids = own.encode_to_numpy
            self.ids = lambda text: np.array(own.encode_ordinary(text), "<u4").tobytes()
        else:
            whole = Tokenizer.from_str(file)
            self.ids = lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self.words = Words(self.ids) if plain else None

    @staticmethod
    def byte_of() -> dict[str, int]:
        """The byte that each character of a byte-level vocabulary stands for: itself if visible."""
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in seen]
        return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}

    def __call__(self, text: str) -> bytes:
        if self.words is None:
            return self.ids(text)
        if self.cut is None or not self.cut.search(text):
            return self.piece(text)
        return b"".join(self.added[t] if k % 2 else self.piece(t) for k, t in enumerate(self.cut.split(text)))

    def many(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text; a null has none."""
        texts = texts.fill_null("")
        if self.words is None:
            return [self.ids(t) if t else b"" for t in texts.to_pylist()]
        if not len(texts):
            return []
        words = pc.split_pattern(texts, " ")
        starts = words.offsets.to_numpy() - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        codes, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        blank = pc.not_equal(pc.utf8_trim_whitespace(known), known)
        blank = pc.or_(blank, pc.equal(pc.binary_length(known), 0)).to_numpy(zero_copy_only=False)
        # all distinct words in one text; a word's ids end where its bytes end
        clear = known.filter(pa.array(~blank))
        line = pc.binary_join(pa.ListArray.from_arrays([0, len(clear)], clear), " ")[0].as_py()
        ids = np.asarray(self.long_ids(" " + line) if line else [], "<u4")
        ends = np.cumsum(pc.binary_length(clear).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        sizes = np.zeros(len(known), np.int64)
        sizes[~blank] = np.diff(np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1, prepend=0)
        # the first word has no space before it; a text that is not cut stands there whole
        first = starts[:-1]
        odd = blank[codes]
        odd[first] = False
        whole = np.add.reduceat(odd, first, dtype=np.int64) > 0
        heads, single = [], np.diff(starts) == 1
        for k, (text, head) in enumerate(zip(texts.to_pylist(), known.take(pa.array(codes[first])).to_pylist())):
            whole[k] |= bool(single[k] or head[-1:].isspace() or self.cut and self.cut.search(text))
            heads.append(self(text) if whole[k] else self.ids(head) if head else b"")
        codes[np.repeat(whole, np.diff(starts))] = len(known) + len(heads)
        codes[first] = len(known) + np.arange(len(heads))
        spans = np.concatenate([[0], 4 * sizes, [len(h) for h in heads], [0]]).cumsum()
        held = pa.py_buffer(ids.tobytes() + b"".join(heads))
        blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(spans) - 1, [None, pa.py_buffer(spans), held])
        _, places, data = blobs.take(pa.array(codes)).buffers()
        cuts = np.frombuffer(places, np.int64)[starts].tolist()
        return [data[a:b].to_pybytes() for a, b in zip(cuts, cuts[1:])]

    def piece(self, text: str) -> bytes:
        """Ids of a text that holds no added token."""
        first, *rest = text.split(" ")
        if rest and first and first[-1].isspace():
            return self.ids(text)
        if len(self.words) > REMEMBERED:
            self.words.clear()
        try:
            return (self.ids(first) if first else b"") + b"".join(map(self.words.__getitem__, rest))
        except KeyError:
            return self.ids(text)


def tokenized(docs: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: str, end: int) -> DataFrame:
    """row, id, source, n and the compressed ids of each document, written to the shared folder."""
    import zstandard

    with open(tokenizer, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())
    last = np.array([end], "<u4").tobytes()

    def encode(batches):
        encoder, press = Encoder(spec.value), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            sizes = pc.binary_length(batch.column(3)).fill_null(0).to_numpy(zero_copy_only=False)
            filled = np.cumsum(sizes, dtype=np.int64) // AT_ONCE
            bounds = [0, *(np.flatnonzero(np.diff(filled)) + 1).tolist(), len(batch)]
            for at, to in zip(bounds, bounds[1:]):
                part = batch.slice(at, to - at)
                n, blobs = [], []
                for ids in encoder.many(part.column(3)):
                    n.append(len(ids) // 4 + 1)
                    blobs.append(press.compress(ids + last))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(n, pa.int64()), pa.array(blobs, pa.binary())], names=["row", "id", "source", "n", "ids"]
                )

    narrow = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.col(text_col).cast("string").alias("text"),
    )
    path = scratch(docs.sparkSession, "tokens")
    narrow.mapInArrow(encode, "row long, id long, source string, n long, ids binary").write.option("compression", "none").parquet(path)
    return docs.sparkSession.read.parquet(path)


def running(rows: DataFrame, amount: str, whole: list[str], part: str, order: list[Column | str]) -> DataFrame:
    """``rows`` with ``end``, the running sum of ``amount`` per ``whole``, over the ranges ``part``."""
    sums = rows.groupBy(*whole, part).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*whole).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    line = Window.partitionBy(*whole, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    left, right = rows.withColumn("_end", F.sum(amount).over(line)).alias("l"), sums.alias("r")
    same = F.lit(True)
    for c in [*whole, part]:
        same &= F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.join(right, same).select("l.*", (F.col("_start") + F.col("_end")).alias("end")).drop("_end")


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    proportions: Mapping[str | None, float] | None = None,
    window: int = WINDOW,
    packet: int = PACKET,
    end: int = END,
    seed: int = 5,
) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian 32-bit numbers), doc_tokens, sequence_id, offset, row.

    ``row`` tells rows of ``docs`` apart that share an id.
    A document is the ids of its text and the id ``end``. ``proportions`` are the target shares of the
    sources, each above 0; without them they are the shares of the sources in the tokens, so that all
    queues end together, and a source of ``docs`` that they leave out (null included) is an error. When a queue is empty the others go on in their proportions. Defined results:
    null and empty texts are the end id alone; null is a source like any other; a null id is kept as it
    is; repeated rows are packed as often as they occur; an empty table gives an empty table; other
    columns are ignored.
    """
    if not 0 < packet <= window:
        raise ValueError("a packet must fit into a window")
    tokens = tokenized(docs, id_col, text_col, source_col, tokenizer, end)
    narrow = tokens.select("row", "source", "n")
    sizes = narrow.groupBy("source").agg(F.sum("n").alias("share"))
    count, total = narrow.agg(F.count("*"), F.sum("n")).first()
    if proportions is not None:
        missing = sorted((str(r.source) for r in sizes.collect() if r.source not in proportions))
        if missing:
            raise ValueError(f"sources without a proportion: {', '.join(missing)}")
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in proportions.items()], "source string, share double")
        sizes, total = given, sum(proportions.values())
    quanta = sizes.select("source", (F.col("share") / F.lit(float(total or 1)) * window).alias("quantum"))
    ranges = max(1, math.ceil(count / RANGE_ROWS))
    mark = F.xxhash64(F.lit(seed), "row")
    queued = narrow.withColumn("mark", mark).withColumn("range", F.pmod("mark", F.lit(ranges)))
    queued = running(queued, "n", ["source"], "range", ["mark", "row"]).alias("q")
    queued = queued.join(quanta.alias("s"), F.col("q.source").eqNullSafe(F.col("s.source"))).select("q.*", "quantum")
    cut = queued.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(packet).cast("long"))))
    length = F.least(F.lit(packet), F.col("n") - F.col("start"))
    place = F.col("end") - F.col("n") + F.col("start") + length
    packets = cut.select("row", "source", "start", length.alias("length"), place.alias("place"), F.ceil(place / F.col("quantum")).alias("turn"))
    packets = cut_lineage(packets.withColumn("range", F.floor(F.col("turn") / RANGE_TURNS)), "packets")
    sent = running(packets, "length", [], "range", ["turn", "source", "place"])
    at = F.col("end") - F.col("length")
    room = F.lit(window) - at % window
    first = F.least("length", room)

    def windows(tokens: Column) -> Column:
        """Whole windows before a place, in integers."""
        return ((tokens - tokens % window) / window).cast("long")

    halves = F.array(
        *(
            F.struct(part.alias("start"), size.alias("length"), windows(begin).alias("sequence_id"), (begin % window).alias("offset"))
            for part, size, begin in (
                (F.col("start"), first, at),
                (F.col("start") + first, F.col("length") - first, at + first),
            )
        )
    )
    pieces = sent.groupBy("row").agg(F.flatten(F.collect_list(F.filter(halves, lambda h: h["length"] > 0))).alias("pieces"))

    def filled(batches):
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                held = part.column(3)
                spans = held.flatten()
                number = np.repeat(np.arange(len(part)), held.value_lengths().to_numpy())
                start, size = spans.field("start").to_numpy(), spans.field("length").to_numpy()
                ids = [open_.decompress(b.as_buffer()) for b in part.column(2)]
                own = [ids[k][4 * a : 4 * (a + n)] for k, a, n in zip(number, start, size)]
                take = pa.array(number)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), spans.field("start"), spans.field("length"), pa.array(own, pa.binary()), part.column(1).take(take), spans.field("sequence_id"), spans.field("offset"), part.column(4).take(take)],
                    names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "row"],
                )

    whole = tokens.join(pieces, "row").select("id", "n", "ids", "pieces", "row")
    out = whole.mapInArrow(filled, "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, row long")
    return out.withColumnRenamed("id", id_col)
