import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import calendar
from panelspark.operators.layout import day_chunk, with_position, with_range

SCHEMA = "series string, day date, k int, a double, b double"


def pandas_fill(rows, weekdays_only):
    out = []
    for s, g in rows.groupby("series"):
        g = g.sort_values(["day", "k"])
        days = pd.date_range(g["day"].min(), g["day"].max(), freq="D")
        if weekdays_only:
            days = days[days.dayofweek < 5]
        m = pd.DataFrame({"day": days}).merge(g[["day", "a", "b"]], on="day", how="left").ffill()
        m.insert(0, "series", s)
        out.append(m)
    return pd.concat(out)


def random_rows(seed, repeated):
    rng = np.random.default_rng(seed)
    rows = []
    for s in ("x", "y", "z"):
        days = rng.choice(400, size=90, replace=repeated)
        for i, d in enumerate(days):
            a = None if rng.random() < 0.3 else float(rng.integers(1, 100))
            b = None if rng.random() < 0.3 else float(rng.integers(1, 100))
            rows.append((s, dt.date(2020, 1, 4) + dt.timedelta(int(d)), i, a, b))
    return rows


@pytest.mark.parametrize("weekdays_only", [False, True])
@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize("chunk_days", [1, 7, 4096])
def test_fill_equals_pandas(spark, weekdays_only, repeated, chunk_days):
    rows = random_rows(1, repeated)
    df = spark.createDataFrame(rows, SCHEMA)
    got = calendar.fill_days(
        df, ["a", "b"], order=["k"], weekdays_only=weekdays_only, chunk_days=chunk_days
    ).toPandas()
    pdf = pd.DataFrame(rows, columns=["series", "day", "k", "a", "b"])
    pdf["day"] = pd.to_datetime(pdf["day"])
    want = pandas_fill(pdf, weekdays_only)

    def canonical(f):
        f = f.assign(day=pd.to_datetime(f["day"]))[["series", "day", "a", "b"]].astype({"a": float, "b": float})
        return f.fillna(-1).sort_values(["series", "day", "a", "b"]).reset_index(drop=True)

    pd.testing.assert_frame_equal(canonical(got), canonical(want), check_dtype=False)


@pytest.mark.parametrize("weekdays_only", [False, True])
def test_dense_positions(spark, weekdays_only):
    df = spark.createDataFrame(random_rows(2, False), SCHEMA)
    got = calendar.fill_days(df, ["a"], weekdays_only=weekdays_only, dense=True, chunk_days=30).toPandas()
    for _, g in got.sort_values("day").groupby("series"):
        assert list(g["pos"]) == list(range(1, len(g) + 1))
        assert (g["n"] == len(g)).all()


def test_fill_is_idempotent(spark):
    df = spark.createDataFrame(random_rows(3, False), SCHEMA)
    once = calendar.fill_days(df, ["a", "b"]).drop("is_filled")
    twice = calendar.fill_days(once, ["a", "b"]).drop("is_filled")
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_unit_rows(spark):
    d = dt.date
    df = spark.createDataFrame(
        [("gap", d(2024, 1, 5), 0, 10.0, None), ("gap", d(2024, 1, 8), 0, 12.0, 1.0),
         ("lead", d(2024, 1, 1), 0, None, None), ("lead", d(2024, 1, 2), 0, 5.0, None), ("lead", d(2024, 1, 3), 0, None, None)],
        SCHEMA,
    )
    full = {(r.series, r.day): r.a for r in calendar.fill_days(df, ["a"]).collect()}
    assert full[("gap", d(2024, 1, 6))] == full[("gap", d(2024, 1, 7))] == 10.0
    assert [full[("lead", d(2024, 1, i))] for i in (1, 2, 3)] == [None, 5.0, 5.0]
    trading = calendar.fill_days(df.filter("series = 'gap'"), ["a"], weekdays_only=True)
    assert sorted(r.day for r in trading.collect()) == [d(2024, 1, 5), d(2024, 1, 8)]


def test_weekend_rows_are_not_used(spark):
    d = dt.date
    df = spark.createDataFrame(
        [("s", d(2024, 1, 6), 0, 9.0, None), ("s", d(2024, 1, 9), 0, 1.0, None), ("s", d(2024, 1, 13), 0, 7.0, None)], SCHEMA
    )
    got = sorted((r.day, r.a) for r in calendar.fill_days(df, ["a"], weekdays_only=True).collect())
    assert got == [(d(2024, 1, 8), None)] + [(d(2024, 1, i), 1.0) for i in (9, 10, 11, 12)]


def test_completeness_can_pass_100(spark):
    week = [("s", dt.date(2024, 1, 1) + dt.timedelta(i), 0, 1.0, 1.0) for i in range(7)]
    row = calendar.quality_report(spark.createDataFrame(week, SCHEMA)).first()
    assert (row.expected_trading_days, row.missing_trading_days, row.completeness_pct) == (5, -2, 140.0)


def test_weekday_count_equals_calendar(spark):
    days = pd.date_range("1969-12-20", "1971-02-01", freq="D")
    pairs = [(a.date(), b.date()) for a in days[::17] for b in days[::13] if a <= b]
    df = spark.createDataFrame(pairs, "a date, b date")
    for r in df.select("a", "b", calendar.weekdays_between(F.col("a"), F.col("b")).alias("n")).collect():
        assert r.n == np.busday_count(r.a, r.b + dt.timedelta(1))


def test_missing_days(spark):
    rows = random_rows(4, True)
    got = calendar.missing_days(spark.createDataFrame(rows, SCHEMA), first=None).toPandas()
    for s in ("x", "y", "z"):
        seen = {r[1] for r in rows if r[0] == s}
        days = [x.date() for x in pd.date_range(min(seen), max(seen), freq="D") if x.dayofweek < 5]
        want = [x for x in days if x not in seen]
        assert list(got[got["series"] == s].sort_values("rank")["missing_day"]) == want


def test_positions_across_chunks(spark):
    df = spark.createDataFrame(random_rows(5, True), SCHEMA)
    got = with_position(df, ["series"], ["day", "k"], day_chunk("day", 9)).toPandas()
    for _, g in got.sort_values(["day", "k"]).groupby("series"):
        assert list(g["pos"]) == list(range(1, len(g) + 1)) and (g["n"] == len(g)).all()


def test_a_day_with_most_rows_is_split(spark):
    """One series and day with nine rows in ten: same rows as pandas, and no range holds many of them."""
    d = dt.date
    rng = np.random.default_rng(7)
    rows = [("hot", d(2024, 3, 4), i, None if rng.random() < 0.7 else float(i), None if i < 1500 else 1.0) for i in range(2_000)]
    rows += [("hot", d(2024, 3, 1), 5, 9.0, None), ("hot", d(2024, 3, 9), 1, None, None), ("cold", d(2024, 3, 1), 0, 1.0, 2.0), ("cold", d(2024, 3, 4), 0, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for chunk_days in (1, 64):
        got = calendar.fill_days(df, ["a", "b"], order=["k"], chunk_days=chunk_days, chunk_rows=100)
        want = pandas_fill(pd.DataFrame(rows, columns=["series", "day", "k", "a", "b"]).assign(day=lambda x: pd.to_datetime(x["day"])), False)
        key = lambda f: sorted(map(str, f.assign(day=pd.to_datetime(f["day"]))[["series", "day", "a", "b"]].astype({"a": float, "b": float}).fillna(-1).itertuples(index=False)))
        assert key(got.toPandas()) == key(want)
    ranged = with_range(df.withColumn("c", day_chunk("day", 64)), ["series", "c"], ["day", "k"], "_part", 100)
    assert ranged.groupBy("series", "c", "_day", "_part").count().agg(F.max("count")).first()[0] <= 100


@pytest.mark.parametrize("kind", ["timestamp", "date", "decimal(10,2)", "long", "string"])
def test_ranges_by_any_order_column(spark, kind):
    value = {"timestamp": "timestamp_seconds(k)", "date": "date_add(date'2024-01-01', k)", "string": "lpad(k, 5, '0')"}.get(kind, f"cast(k as {kind})")
    df = spark.range(500).selectExpr("'s' AS series", "date'2024-01-01' AS day", "CASE WHEN id = 3 THEN NULL ELSE cast(id as int) END AS k", "id").selectExpr("*", f"{value} AS o")
    got = with_range(df, ["series"], ["day", "o"], "_part", 50).orderBy("k").collect()
    assert len(got) == 500 and [r._part for r in got] == sorted(r._part for r in got)
    assert (max(r._part for r in got) == 9) == (kind != "string")
