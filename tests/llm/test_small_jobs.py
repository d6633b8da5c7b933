"""Work that is done once, and few rows in one task."""

import os

import numpy as np
from pyspark.sql import functions as F

from inkfold.llm import minhash_dedup as M
from inkfold.llm.components import connected_components
from inkfold.llm.queries import bpe_digests
from inkfold.plans import shared


def test_few_edges_make_no_rounds(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-60, 60, (70, 2))] + [(i, i + 1) for i in range(1000, 1300)] + [(5, None), (None, 6)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    folder = spark.conf.get("spark.checkpoint.dir")
    before = len(os.listdir(folder)) if os.path.isdir(folder) else 0
    few = sorted(map(tuple, connected_components(edges).collect()))
    assert len(os.listdir(folder)) == before + 1  # the edges; each round left more
    assert few == sorted(map(tuple, connected_components(edges, few=0).collect()))
    assert dict(few)[1300] == 1000
    assert connected_components(edges.where("a > 5000")).collect() == []


def test_index_is_made_once_with_hot_entries(spark):
    rows = [(e, r) for e in (7, 8, 9) for r in range(200)] + [(10, 1), (11, 2), (11, 3), (12, 5)]
    entries = spark.createDataFrame(rows, "entry long, rep long")
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    got = M._shared(entries.mapInArrow(counted, entries.schema), [9, 7]).collect()
    assert made.value == len(rows)
    assert sorted((r.entry, r.rep) for r in got) == sorted(x for x in rows if x[0] not in (10, 12))
    for part in {(r.entry, r.part) for r in got}:
        mine = [r for r in got if (r.entry, r.part) == part]
        assert {r.centre for r in mine} == {min(r.rep for r in mine)}
    assert len({r.part for r in got if r.entry == 9}) > 30 and {r.part for r in got if r.entry in (8, 11)} == {0}


def test_hot_parts_of_one_member_stay_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        rows = [(e, r) for e in (1, 2, 3) for r in range(9)] + [(4, 1), (5, 2)]
        got = M._shared(spark.createDataFrame(rows, "entry long, rep long"), [2]).collect()
        assert sorted((r.entry, r.rep) for r in got) == sorted(x for x in rows if x[0] < 4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_full_heap_is_asked_to_shrink(spark, monkeypatch):
    monkeypatch.setattr(shared, "FULL_HEAP", 0.0)
    monkeypatch.setattr(shared, "_rested", -1e9)
    shared.materialise(spark.range(3).where(F.col("id") > 0))
    assert shared._rested > 0


def test_executors_are_asked_to_shrink(spark):
    assert shared.rest_executors(spark) == spark.sparkContext.defaultParallelism


def test_plans_of_the_encoder_name_its_ranks(spark):
    texts = spark.createDataFrame([(1, "unbelievably misspeled wrds"), (2, None)], "doc_id long, text string")
    made = bpe_digests(texts)
    plan = made._jdf.queryExecution().executedPlan()
    # The driver keeps both for each execution; with the ranks spelled out they had 6 MB.
    assert len(plan.toString()) < 200_000
    assert len(spark._jvm.org.apache.spark.sql.execution.SparkPlanInfo.fromSparkPlan(plan).toString()) < 200_000
    # The ranks are no column, of which each row would have a copy.
    names = [c.name() for c in _outputs(made._jdf.queryExecution().optimizedPlan())]
    assert "place" in names and "ranks" not in names
    assert {r.doc_id: r.n_tokens > 0 for r in made.collect()} == {1: True, 2: False}


def _outputs(plan):
    """The columns of a plan and of all below it."""
    out = [plan.output().apply(i) for i in range(plan.output().size())]
    return out + [c for i in range(plan.children().size()) for c in _outputs(plan.children().apply(i))]
