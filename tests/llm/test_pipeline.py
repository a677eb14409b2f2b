import numpy as np
import pytest

import corpus_pipeline
from millgauge.llm.packing import Encoder
from millgauge.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    folder = tmp_path_factory.mktemp("pipeline")
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def test_stages_return_documents(outputs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    for name in names[:-1]:
        assert outputs[name].dtypes == outputs["documents"].dtypes and outputs[name].count() > 0


def test_quality_keeps_rows_whole_and_drops_the_bad(spark, outputs):
    kept = {r.doc_id: r.text for r in outputs["quality"].collect()}
    whole = {r.doc_id: r.text for r in outputs["documents"].collect()}
    assert all(whole[d] == t for d, t in kept.items()) and len(kept) < len(whole)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q]
    assert np.mean([d in kept for d in good]) > 0.95


def test_line_dedup_removes_lines_alone(outputs):
    before = {r.doc_id: r.text or "" for r in outputs["quality"].collect()}
    for r in outputs["line_dedup"].collect():
        lines = iter(before[r.doc_id].split("\n"))
        assert all(line in lines for line in (r.text or "").split("\n")) and r.n_chars == len(r.text or "")


def test_near_dedup_keeps_a_document_of_each_group(outputs):
    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    before = {r.doc_id: shingles(r.text) for r in outputs["line_dedup"].collect()}
    after = {r.doc_id for r in outputs["near_dedup"].collect()}
    alike = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    kept = sorted(after)
    assert not any(alike(before[a], before[b]) for i, a in enumerate(kept) for b in kept[i + 1 :])
    reach = {d for d in before if any(alike(before[d], before[k]) for k in after)} | after
    frontier = reach
    while frontier := {d for d in before if d not in reach and any(alike(before[d], before[k]) for k in frontier)}:
        reach |= frontier
    assert reach == set(before)


def test_packing_holds_the_mixed_texts(outputs):
    encoder = Encoder(open(tokenizer(), encoding="utf-8").read())
    texts = sorted(np.array([*np.frombuffer(encoder(r.text or ""), "<u4"), 1], "<u4").tobytes() for r in outputs["mixing"].collect())
    rows = {}
    for p in outputs["packing"].collect():
        rows.setdefault(p.row, []).append((p.start, bytes(p.ids)))
    assert sorted(b"".join(ids for _, ids in sorted(parts)) for parts in rows.values()) == texts


def test_run_gives_the_last_stage(spark, outputs):
    assert corpus_pipeline.run(spark, SF).count() == outputs["packing"].count()


def odd_documents(spark):
    """Repeated rows, null ids and texts, ids with several texts, and columns named like those inside the stages."""
    words = [f"w{k}" for k in range(400)]
    text = lambda a: " ".join(words[a : a + 90])
    rows = [(9005, text(0)), (9005, text(0)), (9005, text(0)), (None, text(100)), (None, text(100)), (9006, text(100)), (None, text(200))]
    rows += [(9007, text(250)), (9007, text(300)), (9008, text(250)), (9009, None), (9009, None), (None, None), (9010, ""), (9011, " ")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, kept string, n int"
    return spark.createDataFrame([(d, t, "en", None, len(t or ""), "k", "r", "x", 1) for d, t in rows], kind)


def test_repeated_rows_and_rows_without_an_id_stay_once(spark):
    docs = odd_documents(spark)
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert kept.dtypes == docs.dtypes
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    text = {r.doc_id: r.text for r in docs.collect()}
    alone = [r.text for r in docs.where("doc_id is null").collect()]
    expected = [(9005, text[9005]), (9006, text[9006]), (None, alone[2]), (9007, text[9008]), (9007, text[9007])]
    expected += [(9009, None), (None, None), (9010, ""), (9011, " ")]
    assert got == sorted(expected, key=str)


def test_stages_take_odd_and_empty_tables(spark):
    for docs in (odd_documents(spark), odd_documents(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "packing" or out.dtypes == docs.dtypes
            assert docs.isEmpty() <= out.isEmpty()
