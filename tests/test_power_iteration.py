import math
from collections import defaultdict

import pytest

from keyspan.models import power_iteration
from keyspan.models.power_iteration import grid_cells, neighbours

FEATURES = ["x", "y"]


def table(spark, groups):
    rows = [(None, 0.5, 0.5), ("open", None, 0.5), ("nan", 0.5, float("nan"))]
    rows += [(f"{name}-{k}", float(x), float(y)) for name, points in groups.items() for k, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, "name string, x double, y double")


# A ring around a heap: no centre tells them apart. Three rows of four are copies of one.
RING = [(math.cos(a / 40 * math.pi), math.sin(a / 40 * math.pi)) for a in range(80)]
HEAP = [(0.0, 0.0)] * 200 + [(0.05 * math.cos(a), 0.05 * math.sin(a)) for a in range(40)]


def test_groups_that_no_centre_tells_apart(spark):
    df = table(spark, {"ring": RING, "heap": HEAP})
    got = {r["name"]: r["prediction"] for r in power_iteration(df, "name", FEATURES, k=2, max_iter=100).collect()}
    assert len(got) == len(RING) + len(HEAP)
    clusters = {group: {p for name, p in got.items() if name.startswith(group)} for group in ("ring", "heap")}
    assert len(clusters["ring"]) == len(clusters["heap"]) == 1 and clusters["ring"] != clusters["heap"]


def test_again_and_in_another_order(spark):
    df = table(spark, {"a": [(0, 0)] * 5, "b": [(1, 1), (0.99, 1)], "c": [(0, 1)] * 3})
    first, again = (power_iteration(d, "name", FEATURES, k=3, max_iter=50).collect() for d in (df, df.repartition(5)))
    assert sorted(first) == sorted(again) and len({r["prediction"] for r in first}) == 3


@pytest.mark.parametrize("n_features", [1, 2, 3])
def test_neighbours_against_all_pairs(spark, n_features):
    cells = 4
    points = [tuple((k * 7919 * (i + 3) % 101) / 100 for i in range(n_features)) for k in range(60)]
    place = lambda p: tuple(min(int(x * cells), cells - 1) for x in p)
    held = defaultdict(list)
    for p in points:
        held[place(p)].append(p)
    number = lambda c: sum(x * cells**i for i, x in enumerate(c))
    mean = {c: [sum(x) / len(ps) for x in zip(*ps)] for c, ps in held.items()}
    expected = {
        frozenset((number(a), number(b))): len(held[a]) * len(held[b]) * math.exp(-sum((x - y) ** 2 for x, y in zip(mean[a], mean[b])) * cells**2 / 2)
        for a in held
        for b in held
        if a != b and all(abs(x - y) <= 1 for x, y in zip(a, b))
    }
    rows = spark.createDataFrame([(number(place(p)), list(p)) for p in points], "cell long, point array<double>")
    found = neighbours(grid_cells(rows, n_features, cells), n_features, cells).collect()
    assert len(found) == len(expected)
    for r in found:
        assert r["weight"] == pytest.approx(expected[frozenset((r["src"], r["dst"]))])


def test_no_rows_one_row_and_constant_features(spark):
    df = table(spark, {"a": [(3, 4)]})
    assert power_iteration(df.where("name = 'open'"), "name", FEATURES, k=2).collect() == []
    assert [r["name"] for r in power_iteration(df, "name", FEATURES, k=2).collect()] == ["a-0"]


def test_wrong_requests(spark):
    df = table(spark, {"a": [(0, 0), (1, 1)]})
    for wrong in ({"k": 1}, {"k": 2, "cells": 1}, {"k": 2, "cells": 10**9}, {"k": 2, "features": []}, {"k": 2, "features": ["x"] * 8}):
        with pytest.raises(ValueError):
            power_iteration(df, "name", **({"features": FEATURES} | wrong))
