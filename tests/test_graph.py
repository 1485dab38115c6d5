"""Components and hierarchies against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators.graph import ancestor_pairs, connected_components, hierarchy


def labels_of(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def walk(parents):
    out = {}
    for k in parents:
        x, seen = k, [k]
        while parents.get(x) in parents and parents[x] not in seen:
            x = parents[x]
            seen.append(x)
        if parents.get(x) in seen:
            at = seen.index(parents[x])
            out[k] = (min(seen[at:]), at, 1, seen[: at + 1][::-1])
        else:
            out[k] = (x, len(seen) - 1, 0, seen[::-1])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(50)] + [(300, 300)] + [(500, 600 + i) for i in range(30)]
    names = list(range(700))
    r.shuffle(names)
    edges = [(names[a], names[b]) for a, b in edges]
    rows = edges + edges[:9] + [(b, a) for a, b in edges[:9]] + [(None, 5), (5, None)]
    got = {x.node: x.label for x in connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert got == labels_of(edges)


def test_components_of_strings_and_of_nothing(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "src string, dst string")
    assert {x.node: x.label for x in connected_components(df).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert connected_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_hierarchy(spark, seed):
    r = random.Random(seed)
    parents = {i: (r.randrange(90) if r.random() < 0.8 else None) for i in range(80)} | {i: i + 1 for i in range(200, 260)} | {260: None, 300: 300, 301: 300, 302: 999}
    rows = spark.createDataFrame(list(parents.items()), "a long, b long")
    found = hierarchy(rows.withColumn("node", F.lit("x")).withColumn("depth", F.lit(None)), F.col("a"), F.col("b"), with_path=True).collect()
    assert {x.node: (x.root, x.depth, x.in_cycle, x.path) for x in found} == walk(parents)
    assert len(found) == len(parents)


def test_hierarchy_is_the_same_in_one_partition(spark):
    rows = spark.createDataFrame([(i, i - 1 if i % 7 else None) for i in range(40)], "a long, b long")
    one, four = (sorted(map(tuple, hierarchy(rows.repartition(n), F.col("a"), F.col("b")).collect()), key=str) for n in (1, 4))
    assert one == four


def test_descendants_and_empty(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 4)], "a long, b long")
    tree = hierarchy(rows, F.col("a"), F.col("b"), with_path=True)
    assert {tuple(x) for x in ancestor_pairs(tree).collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1)}
    assert hierarchy(rows.limit(0), F.col("a"), F.col("b")).count() == 0


def test_many_children_of_one_parent(spark):
    rows = spark.range(5000).select(F.col("id").alias("a"), F.when(F.col("id") > 0, F.lit(0)).cast("long").alias("b"))
    found = hierarchy(rows, F.col("a"), F.col("b"))
    assert found.where("root = 0 and depth <= 1").count() == 5000
