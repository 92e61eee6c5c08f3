import random

import pytest

from netloom.llm import common


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_components_against_a_search(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_LINKS", few)
    monkeypatch.setattr(common, "LEAST_HOT", 3)
    monkeypatch.setattr(common, "KEYS", 20)
    rng = random.Random(2)
    # A hub with a third of all links, a long chain, small groups, loops and repeats; some numbers negative.
    links = [(-7, 1000 + i) for i in range(200)] + [(i, i + 1) for i in range(200, 320)] + [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(200)] + [(5, 5), (9, 8), (9, 8), (8, 9)]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        if start in want:
            continue
        todo = [start]
        while todo:
            n = todo.pop()
            if n not in want:
                want[n] = start
                todo += near[n]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {k: v for k, v in want.items() if k != 5} == got
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_keys_are_joined_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 10)
    monkeypatch.setattr(common, "KEYS", 10)
    rows = [(1, i) for i in range(500)] + [(k, k) for k in range(2, 300)]
    named = [(1, "a", 500)] + [(k, f"n{k}", 1) for k in range(2, 290)]
    r, n = spark.createDataFrame(rows, "k long, i long"), spark.createDataFrame(named, "k long, name string, n long")
    got = sorted(map(tuple, common.join_named(r, n, "k").select("k", "i", "name").collect()))
    assert got == sorted((k, i, dict((x[0], x[1]) for x in named)[k]) for k, i in rows if k < 290)


def test_folder_of_a_cluster_must_be_named():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="checkpoint.dir"):
        common.shared_folder(Session())
    Context.master = "local[4]"
    assert common.shared_folder(Session()) == common.OWN_FOLDER


def test_names_that_are_taken():
    assert common.free("a", []) == "a" and common.free("a", ["a", "a_found"]) == "a_found_found"
