"""One query per operator over its whole table, with SQL twins where SQL can express the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from millgauge.llm.fill_middle import fill_in_middle, restored
from millgauge.llm.language import identify
from millgauge.llm.line_dedup import dedup_lines
from millgauge.llm.mixing import mix
from millgauge.llm.near_dup import near_duplicates
from millgauge.llm.neighbours import nearest
from millgauge.llm.packing import pack
from millgauge.llm.quality import classify
from millgauge.llm.quality_rules import STOP_WORDS, judge_text
from millgauge.llm.resampling import resample
from millgauge.llm.sharding import balanced_shards
from millgauge.llm.top_scores import top_scores
from millgauge.llm.url_filter import judge

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(build: Callable) -> Callable:
        LLM_QUERIES[name] = build
        if sql is not None:
            LLM_ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Words of a lower-cased text, as DuckDB lists.
WORDS_SQL = r"""regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""


@query(
    "op3_near_duplicates",
    f"""
    WITH RECURSIVE words AS (SELECT doc_id, {WORDS_SQL.format(text="text")} AS w FROM documents),
    sets AS (
        SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2
            THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s
        FROM words
    ),
    classes AS (SELECT list_sort(s) AS s, min(doc_id) AS rep, len(any_value(s)) AS n FROM sets GROUP BY 1),
    shingles AS (SELECT rep, n, unnest(s) AS h FROM classes),
    links AS (
        SELECT a.rep AS a, b.rep AS b
        FROM shingles a JOIN shingles b ON a.h = b.h AND a.rep < b.rep
        GROUP BY a.rep, b.rep, a.n, b.n
        HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
    ),
    edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT rep, rep FROM classes),
    reach AS (
        SELECT a AS node, b AS other FROM edges
        UNION
        SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other
    ),
    comps AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
    SELECT t.doc_id, len(t.s)::BIGINT AS n_shingles, coalesce(c.component, t.doc_id) AS component_id,
        coalesce(c.component, t.doc_id) = t.doc_id AS kept
    FROM sets t
    LEFT JOIN classes k ON k.s = list_sort(t.s) AND k.n > 0
    LEFT JOIN comps c ON c.node = k.rep
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


def fold(parts: int):
    """The remainder of the checksum of the document number."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def tokenizer() -> str:
    """The tokenizer file; Spark tasks get its contents from the driver."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2,048 tokens in the proportions of their sources."""
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer())
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


@query("op2_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150% of all words takes of each document."""
    mixed = mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


PAGE_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


@query("op4_url_filter")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page addresses; the number in a path names the document whose label it bears."""
    number = F.regexp_extract("path", r"/(\d{1,18})(?:\D|$)", 1)
    key = F.when(number != "", number.cast("long"))
    judged = judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), PAGE_RULES, key=key)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op5_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, equal texts together."""
    placed = balanced_shards(table(spark, sf_dir, "documents"))
    grown = F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), grown)


BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    "op6_line_dedup",
    f"""
    WITH docs AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
    lines AS (SELECT r, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM docs),
    keyed AS (
        SELECT *, translate(trim(line, {BLANKS_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM lines
    ),
    common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
    marked AS (SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON c.key = k.key),
    kept AS (
        SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
        FROM marked GROUP BY r
    )
    SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM docs JOIN kept USING (r)
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents or more share."""
    kept = dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    text = F.coalesce("kept_text", F.lit("")).cast("binary")
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2(text, 256).alias("kept_sha256"))


@query("op7_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold(3) == 1
    found = identify(docs, docs.where(F.coalesce(~held_out, F.lit(False))))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


VECTORS_SQL = """
    vectors AS (
        SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
        WHERE len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    )"""


@query(
    "op8_neighbours",
    f"""
    WITH {VECTORS_SQL},
    searched AS (SELECT * FROM vectors WHERE len(list_filter(v, lambda x: x <> 0)) > 0),
    pairs AS (
        SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: (c.v[i] - q.v[i]) * (c.v[i] - q.v[i])))) AS score
        FROM searched q JOIN searched c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
    )
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INTEGER AS rank, vec_id, score
    FROM pairs QUALIFY rank <= 10
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    return nearest(table(spark, sf_dir, "embeddings"))


@query("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from the labels of four fifths of them."""
    labels = table(spark, sf_dir, "labels").where(F.coalesce(fold(5) != 0, F.lit(False)))
    found = classify(table(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


@query(
    "op10_top_scores",
    f"""
    WITH {VECTORS_SQL},
    whole AS (SELECT vec_id, list_transform(v, lambda x: floor(1024 * x)) AS v FROM vectors),
    pairs AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
        FROM whole q JOIN whole c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
    )
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
    FROM pairs QUALIFY rank <= 10
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every hundredth vector."""
    return top_scores(table(spark, sf_dir, "embeddings"))


#: Distinct runs of one to three words of every text of a table, with how often each stands in it.
RUNS_SQL = r"""
    {name}_words AS (
        SELECT {key} AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM {table}
    ),
    {name}_places AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM {name}_words),
    {name}_runs AS (
        SELECT r, f, count(*) AS n FROM (
            SELECT r, w[i] AS f FROM {name}_places
            UNION ALL SELECT r, w[i] || ' ' || w[i + 1] FROM {name}_places WHERE i + 1 <= len(w)
            UNION ALL SELECT r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM {name}_places WHERE i + 2 <= len(w)
        ) GROUP BY r, f
    )"""


@query(
    "op11_resampling",
    f"""
    WITH RECURSIVE docs AS (SELECT doc_id, text, row_number() OVER () AS k FROM documents),
    {RUNS_SQL.format(name="own", key="k", table="docs")},
    {RUNS_SQL.format(name="aim", key="item_id", table="benchmark")},
    bits AS (
        SELECT range AS b, range::BIGINT AS v, 0 AS step FROM range(256)
        UNION ALL
        SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM bits WHERE step < 8
    ),
    bytes AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE step = 8),
    texts AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM own_runs UNION SELECT f FROM aim_runs)),
    sums AS (
        SELECT f, h, 4294967295::BIGINT AS v, 0 AS pos FROM texts
        UNION ALL
        SELECT f, h, xor(v >> 8, (SELECT t FROM bytes)[(xor(v, ('0x' || substr(h, 2 * pos + 1, 2))::BIGINT) & 255) + 1]), pos + 1
        FROM sums WHERE 2 * pos < len(h)
    ),
    buckets AS (SELECT f, xor(v, 4294967295) % 10000 AS bucket FROM sums WHERE 2 * pos = len(h)),
    own AS (SELECT r, bucket, sum(n)::DOUBLE AS n FROM own_runs JOIN buckets USING (f) GROUP BY ALL),
    s AS (SELECT bucket, sum(n) AS s FROM own GROUP BY bucket),
    t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM aim_runs JOIN buckets USING (f) GROUP BY bucket),
    gains AS (
        SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM s) + 10000)
            / ((s + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000)))) AS gain
        FROM s LEFT JOIN t USING (bucket)
    ),
    weights AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM own JOIN gains USING (bucket) GROUP BY r),
    scored AS (
        SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
        FROM docs JOIN own_words ON own_words.r = k LEFT JOIN weights ON weights.r = k
    ),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
    SELECT doc_id, n_features, weight, score,
        CASE WHEN n_words >= 20 AND place <= (SELECT 5 * count(*) // 100 FROM scored WHERE n_words >= 20) THEN place END AS rank
    FROM ranked
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their importance for the benchmark texts; five of a hundred are drawn."""
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


STOP_WORDS_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query(
    "op12_quality_rules",
    rf"""
    WITH docs AS (
        SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
        FROM documents
    ),
    spans AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS span FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
    twice AS (SELECT r, span FROM spans GROUP BY r, span HAVING count(*) > 1),
    places AS (SELECT DISTINCT r, i + k.range AS place FROM spans JOIN twice USING (r, span), range(3) k),
    repeats AS (SELECT r, count(*) AS n FROM places GROUP BY r),
    measured AS (
        SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, coalesce(repeats.n, 0) AS n_repeat_words,
            len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
            len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS letters,
            len(list_filter(w, lambda x: regexp_matches(x, '(?s)\p{{Lu}}.*\p{{Lu}}') AND NOT regexp_matches(x, '\p{{Ll}}'))) AS shouted,
            len(list_filter(w, lambda x: lower(rtrim(x, '.,;:!?')) IN ({STOP_WORDS_SQL}))) AS stops,
            len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS listed,
            len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*\z'))) AS broken
        FROM docs LEFT JOIN repeats USING (r)
    ),
    judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND 100 * word_chars BETWEEN 250 * n_words AND 1200 * n_words AND 100 * n_symbols <= 10 * n_words
        AND 100 * letters >= 70 * n_words AND 100 * shouted <= 30 * n_words AND 100 * stops >= 5 * n_words
        AND 100 * n_dup_lines <= 30 * n_lines AND 100 * listed <= 90 * n_lines AND 100 * broken <= 30 * n_lines AS kept
    FROM judged
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of all documents and whether they keep the table of quality rules."""
    judged = judge_text(table(spark, sf_dir, "documents"))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query(
    "op13_fill_in_middle",
    r"""
    WITH cut AS (
        SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
            list_transform(range(4), lambda k: ('0x' || substr(sha256('42:' || doc_id), 8 * k + 1, 8))::BIGINT) AS h
        FROM documents
    ),
    placed AS (
        SELECT *, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
                WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
        FROM cut
    ),
    parts AS (
        SELECT doc_id, t, form, len(u) AS n, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m,
            array_to_string(u[b + 1:], '') AS s
        FROM placed
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
        sha256(t) AS restored_sha256
    FROM parts
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with half of them rearranged for filling in their middle."""
    turned = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = [F.sha2(c.cast("binary"), 256).alias(n) for n, c in (("output_sha256", F.col("output")), ("restored_sha256", restored("output", "form")))]
    return turned.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
