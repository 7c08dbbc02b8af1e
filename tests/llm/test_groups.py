import random

import pytest

from daftar.llm import groups


def hand(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("hops", [1, 2, 12])
def test_against_union_find(spark, hops):
    rng = random.Random(hops)
    name = lambda i: f"r{i:03d}"
    chain = [(name(i + 1), name(i)) for i in range(40, 90)]
    hub = [(name(60), name(i)) for i in range(100, 130)]
    noise = [(name(rng.randint(150, 220)), name(rng.randint(150, 220))) for _ in range(40)]
    nodes, pairs = [name(i) for i in range(230)], [*chain, *hub, *noise, *noise[:5], (name(3), name(3)), (name(4), None)]
    records = spark.createDataFrame([(n, "x") for n in nodes], "record_id string, group_id string")
    links = spark.createDataFrame([(*p, 1.0) for p in pairs], "left_record_id string, right_record_id string, confidence double")
    got = groups.group_records(records.drop("group_id"), links, hops=hops).collect()
    assert {r["record_id"]: r["group_id"] for r in got} == hand(nodes, pairs) and len(got) == 230


def test_empty(spark):
    records = spark.createDataFrame([("a",), ("a",)], "record_id string")
    links = spark.createDataFrame([], "left_record_id string, right_record_id string")
    assert [tuple(r) for r in groups.group_records(records, links).collect()] == [("a", "a"), ("a", "a")]
    assert groups.group_records(records.limit(0), links).count() == 0
