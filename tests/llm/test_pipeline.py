"""The pipeline's stages, each against what it has to do on its own input."""

import corpus_pipeline
from nitrogrid.llm import decontamination, near_dedup, toxicity
from nitrogrid.llm.common import documents
from tests.llm.conftest import frame
from tests.llm.test_operators import brute_classes

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "packing"]
    docs = documents(spark, SF)
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)

    mild = steps["toxicity"](spark, docs, SF)
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rejected = {r["doc_id"] for r in toxicity.graded(docs, model).where("rejected").collect()}
    assert {r["doc_id"] for r in mild.collect()} == {r["doc_id"] for r in docs.collect()} - rejected
    flags = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(flags[i] == 0 for i in rejected if i in flags) == 0

    single = steps["exact dedup"](spark, mild, SF)
    texts = [" ".join((r["text"] or "").split()) for r in single.collect()]
    assert len(texts) == len(set(texts)) == len({" ".join((r["text"] or "").split()) for r in mild.collect()})

    apart = steps["near dedup"](spark, single, SF)
    classes = brute_classes([(r["doc_id"], r["text"], None) for r in single.collect()])
    assert sorted(r["doc_id"] for r in apart.collect()) == sorted(set(classes.values()))

    clean = steps["decontamination"](spark, apart, SF)
    items = [" ".join(decontamination.words_of(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = lambda t: any(f" {i} " in f" {' '.join(decontamination.words_of(t or ''))} " for i in items)
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in apart.collect() if not holds(r["text"])}
    assert mild.columns == single.columns == apart.columns == clean.columns == columns

    packed = steps["packing"](spark, clean, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in clean.collect()}


def test_run_over_everything(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "sequence_id", "offset", "length"} <= set(rows[0].asDict())


def test_stages_on_odd_rows(spark, odd_rows):
    docs = frame(spark, odd_rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    ids = [r["doc_id"] for r in docs.collect()]
    assert 10 in ids and 11 not in ids and 12 not in ids
    assert near_dedup.SIMILAR == 0.8


def test_stages_bound_their_batches(spark):
    """One session serves all stages, so each of them asks for smaller Arrow batches than an operator alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = frame(spark, [(1, "a text", "en")])
    try:
        for _, stage in [s for s in corpus_pipeline.STAGES if s[0] in ("exact dedup", "packing")]:
            spark.conf.set(key, "8388608")
            stage(spark, docs, SF)
            assert int(spark.conf.get(key).removesuffix("b")) <= 2 << 20
    finally:
        spark.conf.set(key, before)
