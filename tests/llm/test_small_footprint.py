"""What keeps an executor's memory and its files few: one Python worker a task, small graphs in one task, no tokenizer kept."""

import random

import public_tokenizers
import pytest

from auditloom.llm import bpe, common, jaccard


def test_sets_are_built_by_one_worker_a_task(spark, monkeypatch):
    made = []
    write = jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda df, name, **k: made.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name, **k))
    texts = spark.createDataFrame([(i, f"a b c d e f{i}" if i else None) for i in range(30)], "id long, text string")
    got = jaccard._sets(texts, spark.range(0, 30, 2), 3)
    got = {r["id"]: r["n"] for r in got.collect()}
    assert got == {i: 4 if i else 0 for i in range(0, 30, 2)}
    assert made and all(plan.count("MapInArrow") == 1 for plan in made)


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_small_and_large_graphs_have_the_same_components(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_EDGES", few)
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(170)] + [(5, 5), (None, 7), (8, None)]
    least = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(len(edges)):
        for a, b in edges:
            if a in least and b in least:
                least[a] = least[b] = min(least[a], least[b])
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5))
    assert got.columns == ["node", "component"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(least) and dict(rows) == least
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_other_work_lets_the_tokenizer_go():
    bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    assert bpe.load.cache_info().currsize
    common.let_go()
    assert not bpe.load.cache_info().currsize
