"""The pipeline's stages work on all that their predecessors keep, and run() chains them."""

import re

import corpus_pipeline
import pytest

from legwork.llm import neardup, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_keep_the_columns(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(s.columns == columns for s in stages[:-1])


def test_decisions_take_effect(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in stages]
    assert ids[0] == {i for i, s in scores.items() if s < 0.7}
    assert ids[1] == {r["representative"] for r in neardup.classes(stages[0]).collect()}
    assert ids[1] - ids[2] == set() or len(ids[1] - ids[2]) < 5  # only texts that are benchmark passages go as a whole
    assert ids[2] == ids[3] == ids[4]
    before = " ".join(r["text"] for r in stages[2].collect())
    after = " ".join(r["text"] for r in stages[3].collect())
    mails = set(re.findall(r"[\w.]+@[\w.]+\w", before))
    assert mails and not any(m in after for m in mails)


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, stages[-1].select(key).collect()))


NAMES = ["_new", "_n", "node", "label", "score", "bands", "cell", "held_out", "ranges", "c0", "piece"]


@pytest.fixture(scope="module")
def odd_rows(spark):
    """Documents with null and empty texts, ties, repeated rows, a very long text and columns whose names the operators use."""
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(1, None), (2, ""), (3, "some words that are the same in two rows"), (3, "some words that are the same in two rows"), (4, "some words that are the same in two rows"), (None, "a text without id"), (5, "long words " * 40_000)]
    rows += [(6, benchmark), (7, f"Before it. {benchmark} After it all, a few more words of its own stay here, as they should, since most of this text is not a test item. " + "Word of its own. " * 400), (8, "card 4111 1111 1111 1111")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return frame.withColumns({c: F.lit(1) for c in NAMES})


def test_stages_take_odd_rows(spark, odd_rows):
    docs, seen = odd_rows, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == odd_rows.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = docs.collect()
    ids = lambda name: sorted((r["doc_id"] for r in seen[name]), key=str)
    assert len(seen["toxicity"]) == odd_rows.count()
    assert ids("near_dedup") == [1, 3, 5, 6, 7, 8, None]
    assert ids("decontamination") == [1, 3, 5, 7, 8, None]
    left = {r["doc_id"]: r for r in seen["decontamination"]}
    assert left[7]["text"].startswith("Before it.") and left[7]["n_chars"] == len(left[7]["text"]) and left[1]["text"] is None
    private = {r["doc_id"]: r["text"] for r in seen["pii"]}
    assert private[8].startswith("card ") and "4111 1111" not in private[8] and private[3] == left[3]["text"]
    assert {r["doc_id"] for r in seen["packing"]} == set(private)


def test_stages_take_empty_tables(spark, odd_rows):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_rows.limit(0), SF).count() == 0


def test_personal_data_stage_takes_long_chains(spark):
    """The matcher overflowed its stack on such texts and ended the executors that read them."""
    docs = spark.createDataFrame([(1, "12 345 6789 " * 700, 8400), (2, f"jo@{'b.' * 20_000}com 4111 1111 1111 1111", 40_026), (3, "none", 4)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in dict(corpus_pipeline.STAGES)["pii"](spark, docs, SF).collect()}
    assert all(len(r["text"]) == r["n_chars"] for r in got.values())
    assert got[3]["text"] == "none" and not got[2]["text"].startswith("jo@") and "4111 1111" not in got[2]["text"]
