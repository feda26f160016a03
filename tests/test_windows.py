import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelspark.operators import features, predict, metrics, windows


def panel(spark, lengths, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for s, n in lengths.items():
        for i in range(n):
            rows.append((s, dt.date(2000, 1, 1) + dt.timedelta(i), i + 1, n, float(np.round(rng.normal(100, 10), 2))))
    return spark.createDataFrame(rows, "series string, day date, pos int, n int, close double")


def values(df, series):
    return np.array([r.close for r in df.filter(F.col("series") == series).orderBy("pos").collect()])


def test_origin_windows_equal_a_loop(spark):
    lengths = {"long": 700, "edge": 360, "short": 359, "tiny": 45, "none": 35}
    df = panel(spark, lengths).cache()
    got = {(r.series, r.horizon, r.window): r for r in windows.origin_windows(df, context=100).collect()}
    seen = 0
    for s, n in lengths.items():
        v = values(df, s)
        for h in (1, 5, 10):
            count = 1 if n < 30 + (h + 10) * 30 else 30
            for w in range(count):
                end = n - (count - w) * 10 - h
                if end < 30:
                    assert (s, h, w) not in got
                    continue
                r = got[(s, h, w)]
                seen += 1
                assert r.window_end == end and r.last_price == v[end - 1]
                assert r.hist == list(v[max(0, end - 100):end]) and r.truth == list(v[end:end + h])
                assert r.window_day == dt.date(2000, 1, 1) + dt.timedelta(end - 1)
    assert seen == len(got)


def test_sliding_windows_equal_a_loop(spark):
    lengths = {"long": 400, "short": 160, "tiny": 40}
    df = panel(spark, lengths).cache()
    got = {(r.series, r.horizon, r.window): r for r in windows.sliding_windows(df).collect()}
    want = {}
    for s, n in lengths.items():
        v, split = values(df, s), int(n * 0.8)
        for h in (1, 5, 10):
            for i in range(min(20, min(50, n - split))):
                end = split + i + 30
                if end > n or end + h > n:
                    break
                want[(s, h, i)] = (list(v[end - 30:end]), list(v[end:end + h]))
    assert {k: (r.hist, r.truth) for k, r in got.items()} == want


@pytest.mark.parametrize("chunk_rows", [7, 50, 8192])
def test_lag_features_equal_pandas(spark, chunk_rows):
    df = panel(spark, {"a": 90, "b": 61}).cache()
    got = features.lag_features(df, chunk_rows=chunk_rows).toPandas().sort_values(["series", "pos"])
    parts = []
    for s in ("a", "b"):
        f = pd.DataFrame({"close": values(df, s)})
        f["pos"] = np.arange(1, len(f) + 1)
        for i in range(1, 31):
            f[f"lag_{i}"] = f["close"].shift(i)
        for k in (7, 14, 30):
            f[f"rolling_mean_{k}"] = f["close"].shift(1).rolling(k).mean()
            f[f"rolling_std_{k}"] = f["close"].shift(1).rolling(k).std()
        parts.append(f.dropna().assign(series=s))
    want = pd.concat(parts)
    cols = [c for c in want.columns if c != "series"]
    assert got[cols].values == pytest.approx(want[cols].values, rel=1e-9)


def test_missing_value_blocks_features(spark):
    df = panel(spark, {"a": 60}).withColumn("close", F.when(F.col("pos") != 20, F.col("close")))
    got = features.lag_features(df, n_lags=5, rolling=(7,)).select("pos").toPandas()["pos"]
    assert set(got) == set(range(8, 61)) - set(range(20, 28))


@pytest.mark.parametrize("chunk_rows", [5, 8192])
def test_sequences(spark, chunk_rows):
    df = panel(spark, {"a": 50, "b": 12}).cache()
    got = features.sequences(df, 10, 3, chunk_rows=chunk_rows).collect()
    assert len(got) == (50 - 10 - 3 + 1) + 0
    v = values(df, "a")
    for r in got:
        i = r.pos - 1
        assert r.x == list(v[i - 10:i]) and r.y == list(v[i:i + 3])
    assert features.sequences(df, 10, 1).count() == 40 + 2


def test_scaling_round_trip(spark):
    df = panel(spark, {"a": 50}).unionByName(
        panel(spark, {"flat": 20}).withColumn("close", F.lit(4.0))
    )
    for fit in (features.fit_minmax, features.fit_standard):
        fitted = fit(df)
        scaled = features.rescale(df, fitted)
        back = features.rescale(scaled, fitted, "scaled", inverse=True, name="back")
        assert back.filter(F.abs(F.col("back") - F.col("close")) > 1e-9).count() == 0
        assert {r.scaled for r in scaled.filter("series = 'flat'").collect()} == {0.0}


def test_window_stats(spark):
    df = panel(spark, {"a": 100}).cache()
    v = values(df, "a")
    r = windows.window_stats(windows.origin_windows(df)).filter("horizon = 5").first()
    x = v[100 - 10 - 5 - 30:100 - 10 - 5]
    assert r["mean"] == pytest.approx(x.mean()) and r["volatility"] == pytest.approx(x.std(ddof=1))
    assert r["daily_vol"] == pytest.approx(np.diff(x).std()) and r["current"] == x[-1]
    assert r["trend"] == ("upward" if x[-1] > x[0] else "downward")


def reference_da(y, p, last):
    prev = np.concatenate([[last], y[:-1]])
    up, said = np.sign(y - prev), np.sign(p - prev)
    keep = up != 0
    return None if not keep.any() else (up[keep] == said[keep]).mean() * 100


number = st.integers(1, 6).map(float)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.lists(st.tuples(number, number), min_size=1, max_size=6), number), min_size=20, max_size=40))
def test_metrics_properties(spark, cases):
    rows = [(i, [a for a, _ in ps], [b for _, b in ps], last) for i, (ps, last) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, truth array<double>, pred array<double>, last_price double")
    scored = metrics.score_windows(df)
    for r in scored.collect():
        y, p = np.array(r.truth), np.array(r.pred)
        assert r.window_rmse == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
        assert r.window_rmse >= r.sae / r.steps - 1e-12
        want = reference_da(y, p, r.last_price)
        assert (r.window_da is None) == (want is None)
        if want is not None:
            assert r.window_da == pytest.approx(want) and 0 <= r.window_da <= 100
    total = metrics.summarise(scored, []).first()
    y = np.concatenate([r[1] for r in rows])
    p = np.concatenate([r[2] for r in rows])
    assert total.rmse == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert total.mape == pytest.approx(np.abs((y - p) / y).mean() * 100)


def test_metric_edges(spark):
    schema = "id int, truth array<double>, pred array<double>, last_price double"
    df = spark.createDataFrame(
        [(1, [11.0, 11.0, 12.0], [12.0, 12.0, 11.0], 10.0), (2, [5.0, 5.0], [6.0, 6.0], 5.0),
         (3, [0.0, 2.0], [1.0, 1.0], 1.0), (4, [0.0, 0.0], [1.0, 1.0], 1.0)], schema,
    )
    rows = {r.id: r for r in metrics.summarise(metrics.score_windows(df), ["id"]).collect()}
    assert rows[1].da == 50.0 and rows[2].da is None
    assert rows[3].mape == 50.0 and rows[4].mape == float("inf")
    parity = {r.id: r.window_da for r in metrics.score_windows(df, parity=True).collect()}
    assert parity[2] == 0.0
    good, bad = metrics.split_valid(
        spark.createDataFrame([(1, [1.0], [1.0], 1.0), (2, [], [1.0], 1.0), (3, [1.0], [1.0, 2.0], 1.0)], schema)
    )
    assert good.count() == 1 and {r.reason for r in bad.collect()} == {"empty truth", "different lengths"}
    steps = df.select(metrics.direction_of_steps("truth", "pred", masked=False).alias("v"), "id")
    assert {r.id: r.v for r in steps.collect()}[2] == 100.0


def test_ar1_equals_least_squares(spark):
    df = panel(spark, {"a": 200, "b": 90}, seed=3).cache()
    for r in predict.predict_ar1(df, 4).collect():
        v = values(df, r.series)
        d = np.diff(v[:int(len(v) * 0.8)])
        slope, intercept = np.polyfit(d[:-1], d[1:], 1)
        assert (r.slope, r.intercept) == (pytest.approx(slope), pytest.approx(intercept))
        step, level, path = d[-1], v[int(len(v) * 0.8) - 1], []
        for _ in range(4):
            step = intercept + slope * step
            level += step
            path.append(level)
        assert r.pred == pytest.approx(path)


def test_order_scores_equal_refits(spark):
    df = panel(spark, {"a": 120}, seed=4).cache()
    v = values(df, "a")[:96]
    for r in predict.order_scores(df, max_p=4, max_d=2, chunk_rows=25).collect():
        y = np.diff(v, n=r.d)
        rows = np.arange(4, len(y))
        x = np.column_stack([np.ones(len(rows))] + [y[rows - i] for i in range(1, r.p + 1)])
        res = y[rows] - x @ np.linalg.lstsq(x, y[rows], rcond=None)[0]
        n = len(rows)
        assert r.pairs == n and r.aic == pytest.approx(n * np.log((res**2).sum() / n) + 2 * (r.p + 1))
    best = predict.select_order(predict.order_scores(df, max_p=2)).first()
    assert best.p in (0, 1, 2)


@pytest.mark.parametrize("p, d", [(0, 1), (1, 0), (3, 0), (2, 1), (4, 2)])
def test_ar_p_equals_least_squares(spark, p, d):
    df = panel(spark, {"a": 150, "b": 60}, seed=5).cache()
    for r in predict.predict_ar(df, 5, p, d, chunk_rows=40).collect():
        v = values(df, r.series)
        v = v[:int(len(v) * 0.8)]
        y = np.diff(v, n=d)
        rows = np.arange(p, len(y))
        x = np.column_stack([np.ones(len(rows))] + [y[rows - i] for i in range(1, p + 1)])
        beta = np.linalg.lstsq(x, y[rows], rcond=None)[0]
        assert r.intercept == pytest.approx(beta[0], rel=1e-6, abs=1e-9) and r.coefficients == pytest.approx(list(beta[1:]), rel=1e-6)
        path = list(y)
        for _ in range(5):
            path.append(beta[0] + sum(b * path[-i] for i, b in enumerate(beta[1:], 1)))
        out = np.array(path[-5:])
        for k in reversed(range(d)):
            out = np.diff(v, n=k)[-1] + np.cumsum(out)
        assert r.pred == pytest.approx(out, rel=1e-6)


@pytest.mark.parametrize("p, q, d, long", [(1, 1, 0, 4), (2, 1, 1, 5), (0, 2, 1, 3), (1, 0, 0, 4)])
def test_arma_equals_two_stages_of_least_squares(spark, p, q, d, long):
    df = panel(spark, {"a": 200, "b": 90}, seed=8).cache()
    for r in predict.predict_arma(df, 4, p, q, d, long, chunk_rows=40).collect():
        v = values(df, r.series)
        v = v[:int(len(v) * 0.8)]
        y = np.diff(v, n=d)
        rows = np.arange(long + q, len(y))
        x = np.column_stack([np.ones(len(rows))] + [y[rows - i] for i in range(1, long + 1)])
        alpha = np.linalg.lstsq(x, y[rows], rcond=None)[0]
        e = np.full(len(y), np.nan)
        for t in range(long, len(y)):
            e[t] = y[t] - alpha[0] - sum(alpha[i] * y[t - i] for i in range(1, long + 1))
        x = np.column_stack([np.ones(len(rows))] + [y[rows - i] for i in range(1, p + 1)] + [e[rows - j] for j in range(1, q + 1)])
        beta = np.linalg.lstsq(x, y[rows], rcond=None)[0]
        assert r.pairs == len(rows) and r.intercept == pytest.approx(beta[0], rel=1e-5, abs=1e-7)
        assert [*r.ar, *r.ma] == pytest.approx(list(beta[1:]), rel=1e-5, abs=1e-7)
        path, shocks = list(y), list(e)
        for _ in range(4):
            nxt = beta[0] + sum(beta[i] * path[-i] for i in range(1, p + 1)) + sum(beta[p + j] * shocks[-j] for j in range(1, q + 1))
            path.append(nxt), shocks.append(0.0)
        out = np.array(path[-4:])
        for k in reversed(range(d)):
            out = np.diff(v, n=k)[-1] + np.cumsum(out)
        assert r.pred == pytest.approx(out, rel=1e-5)


def test_orders_of_short_series(spark):
    """Series too short for some orders keep the others; nothing is scored twice."""
    df = panel(spark, {"a": 9, "b": 7, "c": 4}, seed=9).cache()
    got = {(r.series, r.p, r.d): r.pairs for r in predict.order_scores(df, max_p=3, max_d=2, chunk_rows=3).collect()}
    want = {(s, p, d): int(n * 0.8) - 3 - d for s, n in (("a", 9), ("b", 7), ("c", 4)) for d in range(3) for p in range(4) if int(n * 0.8) > 3 + d}
    assert got == want


def test_trees_as_an_expression_equal_the_fitted_model(spark):
    rng = np.random.default_rng(10)
    rows = [(*map(float, rng.normal(0, 1, 4)), 7.0, float(rng.normal())) for _ in range(600)]
    names = ["x0", "x1", "x2", "x3", "same"]
    df = spark.createDataFrame(rows, " double, ".join([*names, "close"]) + " double")
    model = predict.fit_trees(df, names, rounds=12, depth=4)
    both = model.transform(df).select("prediction", predict.tree_values(model, F.array(*names)).alias("own")).collect()
    assert len({r.own for r in both}) > 50 and all(r.own == pytest.approx(r.prediction, rel=1e-12) for r in both)


def test_no_job_after_the_fit_of_trees(spark):
    df = panel(spark, {"a": 150, "b": 150}, seed=11).cache()
    train = df.filter(predict.is_train())
    columns = [f"lag_{i}" for i in range(1, 7)] + ["rolling_mean_7", "rolling_std_7"]
    model = predict.fit_trees(predict.lag_features(train, n_lags=6, rolling=(7,)).select(*columns, "close"), columns, rounds=5, depth=3)
    context = spark.sparkContext
    context.setJobGroup("trees", "steps")
    path = predict.trees_path(model, df, 3, n_lags=6, rolling=(7,))
    assert not context.statusTracker().getJobIdsForGroup("trees")
    got = {(r.series, r.step): r.pred for r in path.collect()}
    context.setLocalProperty("spark.jobGroup.id", None)
    # step by step with the fitted model itself
    for s in ("a", "b"):
        hist = list(values(df, s)[:120])
        for step in (1, 2, 3):
            last = hist[::-1][:7]
            row = spark.createDataFrame([(*map(float, last[:6]), float(np.mean(last)), float(np.std(last, ddof=1)))], " double, ".join(columns) + " double")
            hist.append(model.transform(row).first().prediction)
            assert got[(s, step)] == pytest.approx(hist[-1], rel=1e-9)


def test_blocks_cover_the_horizon(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "hist array<double>")
    out = predict.in_blocks(
        lambda f: f.withColumn("_block", F.array_repeat(F.element_at("hist", -1) + 1, 3)), df, 7, 3
    ).first()
    assert out.pred == [3.0, 3.0, 3.0, 4.0, 4.0, 4.0, 5.0]


def test_trees_follow_the_series(spark):
    rows = []
    for s, scale in (("a", 1.0), ("b", 10.0)):
        for i in range(150):
            rows.append((s, dt.date(2000, 1, 1) + dt.timedelta(i), i + 1, 150, scale * (50 + i % 5)))
    df = spark.createDataFrame(rows, "series string, day date, pos int, n int, close double")
    out = predict.predict_trees(df, 2, n_lags=6, rolling=(7,), rounds=5, depth=3).collect()
    assert len(out) == 4
    for r in out:
        assert (40 < r.pred < 60) if r.series == "a" else (400 < r.pred < 600)


def test_small_prices_keep_their_predictions(spark):
    """A series near 6e-05 is not rounded away, and a small model step stays a move."""
    import datetime as dt

    rows = [("s", dt.date(2020, 1, 1) + dt.timedelta(days=i), 6.129e-05 * (1 + 0.01 * (i % 7)), i + 1, 400) for i in range(400)]
    df = spark.createDataFrame(rows, "series string, day date, close double, pos int, n int")
    made = predict.with_window_predictions(windows.origin_windows(df, context=30), 30).filter("horizon = 5").collect()
    by = {}
    for r in made:
        by.setdefault(r.window, {})[r.model] = r.pred
    for preds in by.values():
        assert all(abs(p[0] - 6.3e-05) < 5e-06 for p in preds.values())
        assert len({p[0] for p in preds.values()}) >= 3 and len(set(preds["ar1"])) == 5
