"""Components of few links in one partition, of more in rounds."""

import random

import pytest

from meterlake.llm import components


def smallest(links):
    """Every node but the smallest of a component to that one."""
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root if find(x) != x}


def some_links():
    rng = random.Random(4)
    path = list(range(-300, 300))
    rng.shuffle(path)
    links = list(zip(path, path[1:])) + [(1000, 1000 + i) for i in range(1, 200)]  # a path in no order, a star
    links += [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(300)] + [(9, 9), (5000, 5000), (1001, 1000)]
    rng.shuffle(links)
    return links


@pytest.mark.parametrize("each", [8, 100, 1 << 17])
def test_components_are_those_of_all_links(spark, monkeypatch, each):
    monkeypatch.setattr(components, "EACH", each)
    df = spark.createDataFrame(some_links(), "a long, b long").repartition(7)
    rows = components.components(df).collect()
    assert len(rows) == len({r.node for r in rows})
    assert {r.node: r.root for r in rows} == smallest(some_links())


def test_components_of_no_links_and_of_text(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert components.components(spark.createDataFrame([(3, 3)], "a long, b long")).collect() == []
    text = spark.createDataFrame([("b", "a"), ("b", "c")], "a string, b string")
    assert {r.node: r.root for r in components.components(text).collect()} == {"b": "a", "c": "a"}


def test_few_links_take_few_stages(spark):
    """The driver keeps a record of every stage and task: links that fit a partition must not take rounds of them."""
    links = spark.createDataFrame(some_links(), "a long, b long").repartition(7)
    spark.sparkContext.setJobGroup("few links", "")
    try:
        components.components(links).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    assert 0 < len(tracker.getJobIdsForGroup("few links")) <= 8
