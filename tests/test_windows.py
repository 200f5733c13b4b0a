import datetime as dt

import pytest
from pyspark.sql import functions as F

from keyspan.operators import windows

COLUMNS = "county string, day date, id long, cases double"


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def frame(spark, rows):
    return spark.createDataFrame([(k, None if d is None else day(d), i, v) for k, d, i, v in rows], COLUMNS)


def brute_force(rows, days):
    """Averages by plain loops: (key, date, id, average)."""
    out, by_key = [], {}
    for k, d, i, v in rows:
        if k is not None and v is not None:
            by_key.setdefault(k, []).append((-1 if d is None else d, i, v))
    for k, points in by_key.items():
        points.sort()
        for end in range(days, len(points) + 1):
            window = points[end - days : end]
            d, i, _ = window[-1]
            out.append((k, None if d < 0 else day(d), i, round(sum(p[2] for p in window) / days, 9)))
    return sorted(out, key=repr)


def answer(df):
    return sorted(((r[0], r[1], r[2], round(r[3], 9)) for r in df.collect()), key=repr)


ARGS = ("county", "day", "cases")

SKEWED = [("hot", n // 3, n, float((n * 7) % 11)) for n in range(60)]
SKEWED += [(f"cold{n % 9}", n, 100 + n, float(n % 5)) for n in range(40)]
SKEWED += [("gap", 0, 200, None), ("gap", 1, 201, 4.0), ("gap", None, 202, 6.0), ("gap", 3, 203, 8.0)]
SKEWED += [(None, 1, 300, 1.0), ("short", 1, 301, 1.0)]


@pytest.mark.parametrize("days", [1, 2, 3, 7])
@pytest.mark.parametrize("rows_per_block", [None, 1000, 17, 5, 1])
def test_moving_average_against_loops(spark, days, rows_per_block):
    df = frame(spark, SKEWED).repartition(5)
    got = windows.moving_average(df, *ARGS, days, "id", split_rows=rows_per_block)
    assert got.columns == ["county", "day", "id", "avg"]
    assert answer(got) == brute_force(SKEWED, days)


@pytest.mark.parametrize("days", [1, 2, 7, 60, 61])
@pytest.mark.parametrize("rows_per_block", [None, 13])
def test_runs_of_rows_give_the_same(spark, monkeypatch, days, rows_per_block):
    monkeypatch.setattr(windows, "FRAME_DAYS", 0)
    got = windows.moving_average(frame(spark, SKEWED).repartition(5), *ARGS, days, "id", split_rows=rows_per_block)
    assert answer(got) == brute_force(SKEWED, days)


def test_long_windows_have_no_frame_per_row(spark):
    df = frame(spark, SKEWED)
    plans = [windows.moving_average(df, *ARGS, days, "id", split_rows=None)._jdf.queryExecution().executedPlan().toString() for days in (500, 5000)]
    assert all("RowFrame, -499, currentrow" not in p and "RowFrame, -4999, currentrow" not in p for p in plans) and all(p.count("Exchange hashpartitioning") == 1 for p in plans)


@pytest.mark.parametrize("array_rows", [1000, 10])
def test_array_form_gives_the_same(spark, array_rows):
    df = frame(spark, SKEWED)
    got = windows.moving_average_from_arrays(df, *ARGS, 3, "id", array_rows=array_rows)
    assert answer(got) == brute_force(SKEWED, 3)


def test_lengths_around_the_window(spark):
    rows = [("a", n, n, float(n)) for n in range(2)] + [("b", n, 10 + n, float(n)) for n in range(3)]
    got = windows.moving_average(frame(spark, rows), *ARGS, 3, "id").collect()
    assert [(r["county"], r["avg"]) for r in got] == [("b", 1.0)]


def test_ties_follow_the_row_id(spark):
    rows = [("a", 0, i, v) for i, v in ((3, 30.0), (1, 10.0), (2, 20.0))]
    got = windows.moving_average(frame(spark, rows), *ARGS, 2, "id").orderBy("id").collect()
    assert [(r["id"], r["avg"]) for r in got] == [(2, 15.0), (3, 25.0)]


@pytest.mark.parametrize("days", [0, -1])
def test_window_needs_a_row(spark, days):
    with pytest.raises(ValueError):
        windows.moving_average(frame(spark, SKEWED), *ARGS, days, "id")


@pytest.mark.parametrize("array_rows", [1000, 8])
def test_arrays_are_whole_and_bounded(spark, array_rows):
    got = windows.moving_average_arrays(frame(spark, SKEWED), *ARGS, 3, "id", array_rows=array_rows)
    rows = got.collect()
    assert all(len(r["moving_averages"]) <= array_rows for r in rows)
    flat = []
    for r in sorted(rows, key=lambda r: (r["county"], r["part"])):
        flat += [(r["county"], p["date"], round(p["avg"], 9)) for p in r["moving_averages"]]
    assert sorted(flat, key=repr) == sorted([(k, d, a) for k, d, _, a in brute_force(SKEWED, 3)], key=repr)
    short = [r for r in rows if r["county"] == "short"]
    assert [(r["part"], r["moving_averages"], r["start_date"], r["num_days"]) for r in short] == [(0, [], day(1), 3)]
    hot = [r for r in rows if r["county"] == "hot"]
    assert sorted(r["part"] for r in hot) == list(range(len(hot)))
    assert {r["start_date"] for r in hot} == {day(0)}
    assert {r["start_date"] for r in rows if r["county"] == "gap"} == {None}


@pytest.mark.parametrize("array_rows", [1000, 7])
def test_series(spark, array_rows):
    rows = windows.series(frame(spark, SKEWED), *ARGS, "id", array_rows=array_rows).collect()
    hot = sorted((r for r in rows if r["county"] == "hot"), key=lambda r: r["part"])
    points = [(p["date"], p["value"]) for r in hot for p in r["series"]]
    assert points == [(day(d), v) for k, d, _, v in SKEWED if k == "hot"]


@pytest.mark.parametrize("array_rows", [1000, 10])
def test_request_repeats_and_unknown_keys(spark, array_rows):
    asked = ["hot", "nowhere", "short", "hot"]
    got = windows.moving_average_request(frame(spark, SKEWED), asked, *ARGS, 3, "id", array_rows=array_rows)
    rows = got.orderBy("pos", "part").collect()
    by_pos = {pos: [r for r in rows if r["pos"] == pos] for pos in range(4)}
    assert {pos: by_pos[pos][0]["county"] for pos in by_pos} == dict(enumerate(asked))
    averages = {pos: [p["avg"] for r in by_pos[pos] for p in r["moving_averages"]] for pos in by_pos}
    assert len(averages[0]) == 58 and averages[0] == averages[3]
    assert averages[1] == averages[2] == []
    assert by_pos[1][0]["start_date"] is None and by_pos[2][0]["start_date"] == day(1)


def test_short_series_need_one_shuffle(spark, small_dir):
    events = spark.read.parquet(f"{small_dir}/events.parquet")
    got = windows.moving_average(events, "user_id", "ts", "value", 7, "event_id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "IsNotNull(user_id)" in plan and "props" not in plan


def test_blocks_stay_small(spark):
    df = frame(spark, SKEWED)
    laid, groups = windows._lay_out(df, *ARGS, "id", 2, 6)
    assert groups == ["_key", "_block"]
    largest = laid.groupBy(*groups).count().agg(F.max("count")).first()[0]
    assert largest <= 6 + 2
    assert {r[0] for r in laid.where("_first is not null").select("_key").distinct().collect()} == {"hot"}
    assert laid.where("_own").count() == len([r for r in SKEWED if r[0] is not None and r[3] is not None])


def test_parts_depend_on_their_own_key_only(spark):
    rows = [("a", i, float(i)) for i in range(25)]
    others = [("b", i, float(i)) for i in range(13)] + [("0", i, 1.0) for i in range(31)]
    alone, beside = (spark.createDataFrame(r, "k string, d int, v double") for r in (rows, rows + others))
    parts = [
        sorted((r["part"], [e["value"] for e in r["series"]]) for r in windows.series(df, "k", "d", "v", "d", array_rows=10).where("k = 'a'").collect())
        for df in (alone, beside)
    ]
    assert parts[0] == parts[1] and [len(values) for _, values in parts[0]] == [10, 10, 5]


def test_nan_is_no_value(spark):
    df = spark.createDataFrame([("a", i, float("nan") if i == 2 else float(i)) for i in range(5)], "k string, d int, v double")
    assert sorted(r["avg"] for r in windows.moving_average(df, "k", "d", "v", 2, "d").collect()) == [0.5, 2.0, 3.5]
