"""Language identification by prediction by partial matching.

Every language has a context tree of bytes: how often a byte followed the ORDER, .. one or no bytes before it.
A byte that a context has not shown costs an escape, with the chance t / (n + t) after n bytes of t kinds,
and is then coded in the next shorter context, at last among all 256 values. The statistics are frozen after
training, so the code length of a byte depends on the ORDER + 1 bytes at its place alone. A text belongs to
the language that codes it shortest.

Trees are sparse: Spark sums the counts per language and run of ORDER + 1 bytes, and a language is two sorted
tables, of the code lengths of bytes in contexts and of the escapes of contexts. Distinct runs are looked up
once per batch of texts. Languages are scored in passes of bounded size, so any number fits in memory.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millgauge.llm.words import runs, text_bytes
from millgauge.sources.staged import cut_lineage

#: Bytes of the longest context.
ORDER = 4
#: Languages scored in one pass over the texts, and the bytes of their tables unless one has more.
LANGUAGES, PASS_BYTES = 32, 128 << 20
#: Symbols of the dense table of order 2.
ALPHABET = 64
#: Labelled texts of a language that train its tree, at most about this many, chosen by a hash.
TRAIN_ROWS = 20_000
RARE = ALPHABET - 1


def places(data: np.ndarray, cuts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For every byte the number of the three symbols that end there; rare ones stand before a text."""
    now = codes[data[cuts[0] : cuts[-1]]]
    before, second = np.full_like(now, RARE), np.full_like(now, RARE)
    before[1:], second[2:] = now[:-1], now[:-2]
    starts = cuts[:-1][np.diff(cuts) > 0] - cuts[0]
    before[starts] = second[starts] = RARE
    second[starts[starts + 1 < len(now)] + 1] = RARE
    return (second * ALPHABET + before) * ALPHABET + now


def code_lengths(counts: np.ndarray, rare_kinds: int) -> np.ndarray:
    """Bits of each symbol after each two symbols, from the counts of all three."""
    counts = counts.reshape(ALPHABET, ALPHABET, ALPHABET).astype(float)
    chance = np.full(ALPHABET, 1 / ALPHABET)
    for table in (counts.sum((0, 1)), counts.sum(0), counts):
        n, kinds = table.sum(-1, keepdims=True), (table > 0).sum(-1, keepdims=True)
        whole = np.maximum(n + kinds, 1)
        escape = np.where(n > 0, kinds / whole, 1.0)
        chance = np.where(table > 0, table / whole, escape * chance)
    bits = -np.log2(chance)
    bits[..., RARE] += np.log2(max(rare_kinds, 1))
    return bits.astype(np.float32).ravel()


def sampled(labelled: DataFrame, train_rows: int) -> DataFrame:
    """(lang, text) of about ``train_rows`` rows of every language of (lang, text, pick)."""
    # Only languages with more rows than that, so there are few; a join would move every text.
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("rows")).where(F.col("rows") > train_rows).collect()
    share = F.lit(1_000_000)
    for r in sizes:
        share = F.when(F.col("lang") == r.lang, int(1_000_000 * train_rows / r.rows)).otherwise(share)
    chosen = labelled.where(F.pmod("pick", F.lit(1_000_000)) < share)
    return cut_lineage(chosen.select("lang", "text"), "sample")


def grams(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For every byte the number of the ORDER + 1 bytes that end there; zeros stand before a text."""
    now = data[cuts[0] : cuts[-1]].astype(np.int64)
    at = np.arange(len(now)) - np.repeat(cuts[:-1] - cuts[0], np.diff(cuts))
    out = now.copy()
    for back in range(1, min(ORDER, len(now) - 1) + 1):
        out[back:] |= np.where(at[back:] >= back, now[:-back], 0) << (8 * back)
    return out


def tree(found: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Sorted numbers and bits of the bytes in contexts, and of the escapes, from counts of distinct grams.

    The order stands above the bytes of a number.
    """
    tables = [[], [], [], []]
    for order in range(ORDER + 1):
        runs_, own = np.unique(found & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
        count = np.bincount(own, n)
        contexts, of = np.unique(runs_ >> 8, return_inverse=True)
        kinds = np.bincount(of).astype(float)
        whole = np.bincount(of, count) + kinds
        new = (runs_ | order << 48, -np.log2(count / whole[of]), contexts | order << 48, -np.log2(kinds / whole))
        for column, values in zip(tables, new):
            column.append(values)
    return [np.concatenate(c).astype(t) for c, t in zip(tables, (np.int64, np.float32, np.int64, np.float32))]


def looked_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each wanted number in the sorted keys, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def gram_bits(wanted: np.ndarray, table: list[np.ndarray]) -> np.ndarray:
    """Bits of the last byte of each gram."""
    keys, bits, contexts, escapes = table
    out, left = np.zeros(len(wanted)), np.arange(len(wanted))
    for order in range(ORDER, -1, -1):
        run = wanted[left] & ((1 << 8 * (order + 1)) - 1)
        at, hit = looked_up(keys, run | order << 48)
        out[left[hit]] += bits[at[hit]]
        left, run = left[~hit], run[~hit]
        at, hit = looked_up(contexts, run >> 8 | order << 48)
        out[left[hit]] += escapes[at[hit]]
    out[left] += 8
    return out


def sparse_trees(labelled: DataFrame, train_rows: int) -> DataFrame:
    """(lang, keys, bits, contexts, escapes) for every language of (lang, text, pick)."""

    def counted(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            names, own = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            for first, last in runs(offsets):
                cuts = offsets[first : last + 1]
                found, lang = grams(data, cuts), np.repeat(own[first:last], np.diff(cuts))
                for k in np.unique(own[first:last]):
                    distinct, n = np.unique(found[lang == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([names[k]] * len(distinct), pa.string()), pa.array(distinct), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    def table(group: pd.DataFrame) -> pd.DataFrame:
        made = tree(group["gram"].to_numpy(), group["n"].to_numpy())
        return pd.DataFrame({"lang": group["lang"].iloc[:1]} | {k: [v.tobytes()] for k, v in zip(("keys", "bits", "contexts", "escapes"), made)})

    rows = sampled(labelled, train_rows).mapInArrow(counted, "lang string, gram long, n long")
    summed = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    kind = "lang string, keys binary, bits binary, contexts binary, escapes binary"
    return cut_lineage(summed.groupBy("lang").applyInPandas(lambda g: table(g), kind), "trees")


def trees(labelled: DataFrame, train_rows: int) -> tuple[DataFrame, np.ndarray]:
    """(lang, table) of order 2 over frequent bytes, for every language, and the code of each byte.

    The dense form, which its tests compare; ``identify`` uses the sparse one.
    """
    sample = sampled(labelled, train_rows)

    def bytes_seen(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            total += np.bincount(data[offsets[0] : offsets[-1]], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["byte", "n"])

    seen = sample.mapInArrow(bytes_seen, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).where("n > 0")
    frequent = [r.byte for r in seen.orderBy(F.desc("n"), "byte").limit(RARE).collect()]
    codes = np.full(256, RARE, np.int64)
    codes[frequent] = np.arange(len(frequent))

    def contexts(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            langs = batch.column(0).to_pylist()
            for first, last in runs(offsets):
                cuts = offsets[first : last + 1]
                where = places(data, cuts, codes)
                names = sorted(set(langs[first:last]))
                at = {name: k for k, name in enumerate(names)}
                own = np.repeat([at[x] for x in langs[first:last]], np.diff(cuts))
                for name, k in at.items():
                    held.setdefault(name, np.zeros(ALPHABET**3, np.int64))
                    held[name] += np.bincount(where[own == k], minlength=ALPHABET**3)
            if len(held) > LANGUAGES:
                yield from given(held)
                held = {}
        yield from given(held)

    def given(held):
        for name, counts in held.items():
            found = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(found), pa.string()), pa.array(found), pa.array(counts[found])], names=["lang", "place", "n"]
            )

    rare_kinds = 256 - len(frequent)

    def table(group: pd.DataFrame) -> pd.DataFrame:
        counts = np.bincount(group["place"], group["n"], ALPHABET**3)
        return pd.DataFrame({"lang": group["lang"].iloc[:1], "bits": [code_lengths(counts, rare_kinds).tobytes()]})

    counted = sample.mapInArrow(contexts, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    return cut_lineage(counted.groupBy("lang").applyInPandas(lambda g: table(g), "lang string, bits binary"), "trees"), codes


def scored(docs: DataFrame, langs: list[str], tables: list[list[np.ndarray]]) -> DataFrame:
    """Add these languages to what docs (.., text, best, bits, rest) has found.

    ``rest`` is the sum of 2 ** (bits - own bits) over all languages.
    """
    schema = docs.schema

    def score(batches):
        for batch in batches:
            names = batch.schema.names
            data, offsets = text_bytes(batch.column(names.index("text")))
            best = np.array(batch.column(names.index("best")).to_pylist(), object)
            bits = batch.column(names.index("bits")).to_numpy(zero_copy_only=False).astype(float)
            rest = batch.column(names.index("rest")).to_numpy(zero_copy_only=False).astype(float)
            for first, last in runs(offsets):
                cuts = offsets[first : last + 1]
                sizes = np.diff(cuts)
                full = np.flatnonzero(sizes)
                distinct, where = np.unique(grams(data, cuts), return_inverse=True)
                for name, table in zip(langs, tables):
                    own = np.zeros(last - first)
                    if len(full):
                        own[full] = np.add.reduceat(gram_bits(distinct, table)[where], (cuts[:-1] - cuts[0])[full])
                    part = slice(first, last)
                    with np.errstate(over="ignore", invalid="ignore"):
                        better = own < bits[part]
                        gap = np.where(np.isinf(bits[part]), -np.inf, np.exp2(-np.abs(bits[part] - own)))
                        gap = np.where(np.isinf(gap), 0.0, gap)
                    rest[part] = np.where(better, 1 + rest[part] * gap, rest[part] + gap)
                    best[part] = np.where(better, name, best[part])
                    bits[part] = np.where(better, own, bits[part])
            new = {"best": pa.array(list(best), pa.string()), "bits": pa.array(bits), "rest": pa.array(rest)}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(k)) for k, n in enumerate(names)], names=names)

    return docs.mapInArrow(score, schema)


def identify(
    docs: DataFrame,
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """(id, lang_pred, score) of every row of ``docs``, learned from the rows of ``labelled``.

    The score is the chance of the language among the learned ones, from the code lengths of the whole
    text. Defined results: ``und`` with score 0 if the text is null or has no letter, or if nothing was
    learned; of languages that code a text alike the one first by code point; rows of ``labelled``
    without text or language teach nothing; repeated rows are scored alike; an empty table gives an empty
    table; other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    learn = labelled.select(
        F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("pick")
    ).where("lang is not null and text <> ''")
    tables = sparse_trees(learn, train_rows)
    columns = {"keys": np.int64, "bits": np.float32, "contexts": np.int64, "escapes": np.float32}
    sizes = tables.select("lang", sum(F.octet_length(c) for c in columns).alias("bytes")).orderBy("lang").collect()
    passes, held = [], 0
    for r in sizes:
        if not passes or len(passes[-1]) >= LANGUAGES or held + r.bytes > PASS_BYTES:
            passes, held = [*passes, []], 0
        passes[-1].append(r.lang)
        held += r.bytes
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.when(text.rlike(r"\p{L}"), text).alias("text"),
        F.lit(None).cast("string").alias("best"),
        F.lit(float("inf")).alias("bits"),
        F.lit(0.0).alias("rest"),
    )
    for langs in passes:
        part = tables.where(F.col("lang").isin(langs)).orderBy("lang").collect()
        rows = scored(rows, [r.lang for r in part], [[np.frombuffer(r[c], t) for c, t in columns.items()] for r in part])
    known = F.col("text").isNotNull() & F.col("best").isNotNull()
    return rows.select(
        F.col("id").alias(id_col),
        F.when(known, F.col("best")).otherwise("und").alias("lang_pred"),
        F.when(known, F.least(F.lit(1.0), 1 / F.col("rest"))).otherwise(0.0).alias("score"),
    )
