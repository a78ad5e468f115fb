"""Operators against independent models in pandas, numpy and plain Python."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import backtest, features, metrics, regress
from seriesloom.params import Params
from tests.test_edges import SCHEMA, T0, column, series


def walk(n, seed):
    return (100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.01, n)))).tolist()


def test_rolling_features_as_in_pandas(spark):
    p = pd.Series(walk(150, 1))
    f = features.all_features(series(spark, p.tolist()), drop_warm_up=False).orderBy("timestamp").toPandas()
    r = p.pct_change()
    want = {
        "returns": r, "ma_20": p.rolling(20).mean(), "volatility_20": r.rolling(20).std(), "vol_of_vol": r.rolling(20).std().rolling(20).std(),
        "high_50": p.rolling(50).max(), "momentum_5_pct": (p - p.shift(5)) / p.shift(5) * 100, "bb_upper": p.rolling(20).mean() + 2 * p.rolling(20).std(),
        "z_score": (p - p.rolling(20).mean()) / p.rolling(20).std(),
    }
    d = p.diff()
    g, loss = d.where(d > 0, 0).rolling(14).mean(), -d.where(d < 0, 0).rolling(14).mean()
    want["rsi"] = 100 - 100 / (1 + g / loss)
    for name, w in want.items():
        np.testing.assert_allclose(f[name].astype(float), w, rtol=1e-9, atol=1e-12, err_msg=name)


def state_machine(positions, prices, cost):
    """The trade log as a loop over rows."""
    held, entry, out = 0, None, []
    for k, (s, p) in enumerate(zip(positions, prices, strict=True)):
        if held == 0 and s != 0:
            held, entry = s, (k, p)
        elif held != 0 and s != held:
            gain = (p - entry[1]) if held == 1 else (entry[1] - p)
            out.append((entry[0], k, "LONG" if held == 1 else "SHORT", gain / entry[1] * 100 - cost))
            held, entry = s, (k, p)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_trades_as_a_state_machine(spark, seed):
    rng = np.random.default_rng(seed)
    signals = [rng.choice([-1, 0, 1], rng.integers(1, 26)).tolist() for _ in range(1 + 3 * seed)]
    rows, want = [], []
    for key, s in enumerate(signals):
        prices = walk(len(s), key)
        rows += [(str(key), k, T0 + pd.Timedelta(hours=k).to_pytimedelta(), p, v) for k, (p, v) in enumerate(zip(prices, s, strict=True))]
        want += [(str(key), *t) for t in state_machine([0, *s[:-1]], prices, 0.015)]
    df = spark.createDataFrame(rows, f"{SCHEMA}, s int")
    got = [(r[0], int((r[1] - T0).total_seconds() // 3600), int((r[2] - T0).total_seconds() // 3600), r[3], r[7]) for r in backtest.trades(backtest.with_equity(df, "s")).collect()]
    assert [g[:4] for g in sorted(got)] == [w[:4] for w in sorted(want)]
    np.testing.assert_allclose([g[4] for g in sorted(got)], [w[4] for w in sorted(want)], rtol=1e-9)


def test_equity_is_the_product_and_drawdown_is_not_positive(spark):
    df = features.add_returns(series(spark, walk(60, 5)))
    d = metrics.with_drawdown(df)
    r = np.array([x or 0.0 for x in column(df, "returns")])
    np.testing.assert_allclose([x for x in column(d, "cum_returns") if x is not None], np.cumprod(1 + r)[1:], rtol=1e-12)
    assert all(x is None or x <= 0 for x in column(d, "drawdown"))


def ridge(x, y, alpha=1.0):
    m, s = x.mean(0), x.std(0)
    z = (x - m) / s
    b = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda q: y.mean() + (q - m) / s @ b, b


def regression_frame(spark, n, seed, key="a"):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 2)) * [3.0, 0.1] + [10.0, -1.0]
    y = x @ [0.5, 2.0] + rng.normal(0, 0.3, n)
    rows = [(key, 0, (pd.Timestamp(T0) + pd.Timedelta(days=10 * k)).to_pydatetime(), 1.0, float(a), float(b), float(c)) for k, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, f"{SCHEMA}, f1 double, f2 double, y double"), x, y


def test_train_and_test_as_in_closed_form(spark):
    df, x, y = regression_frame(spark, 101, 2)
    m, w, _ = regress.train_test(df, ["f1", "f2"], target="y")
    k = int(101 * 0.6)
    f, b = ridge(x[:k], y[:k])
    row = m.first()
    assert (row["train_size"], row["test_size"]) == (k, 101 - k)
    assert row["test_rmse"] == pytest.approx(np.sqrt(np.mean((y[k:] - f(x[k:])) ** 2)))
    assert row["test_r2"] == pytest.approx(1 - np.sum((y[k:] - f(x[k:])) ** 2) / np.sum((y[k:] - y[k:].mean()) ** 2))
    np.testing.assert_allclose([r["weight"] for r in w.orderBy("feature").collect()], b, rtol=1e-8)
    poly = regress.train_test(df, ["f1", "f2"], "polynomial", target="y")[0].first()
    z = (x - x[:k].mean(0)) / x[:k].std(0)
    q = np.c_[z, z[:, 0] ** 2, z[:, 0] * z[:, 1], z[:, 1] ** 2]
    c = q[:k] - q[:k].mean(0)
    bq = np.linalg.solve(c.T @ c + np.eye(5), c.T @ (y[:k] - y[:k].mean()))
    pred = y[:k].mean() + (q[k:] - q[:k].mean(0)) @ bq
    assert poly["test_rmse"] == pytest.approx(np.sqrt(np.mean((y[k:] - pred) ** 2)))
    assert regress.train_test(df, ["f1", "f2"], "spline", target="y")[0].first()["kind"] == "linear"


def test_univariate_as_in_closed_form(spark):
    df, x, y = regression_frame(spark, 60, 3)
    got = {r["feature"]: r for r in regress.univariate(df, ["f1", "f2"], target="y").collect()}
    for j, name in enumerate(("f1", "f2")):
        f, b = ridge(x[:, [j]], y)
        rest = np.sum((y - f(x[:, [j]])) ** 2)
        assert got[name]["coefficient"] == pytest.approx(b[0])
        assert got[name]["r2"] == pytest.approx(1 - rest / np.sum((y - y.mean()) ** 2))
        assert got[name]["rmse"] == pytest.approx(np.sqrt(rest / len(y)))


def test_walk_forward_as_a_loop(spark):
    df, x, y = regression_frame(spark, 120, 4)
    p = Params(train_years=2, rebalance_months=3)
    periods, weights, predictions = regress.walk_forward(df, ["f1", "f2"], target="y", p=p)
    t = pd.date_range(T0, periods=120, freq="10D")
    at, want = t[0] + pd.DateOffset(years=2), []
    while at < t[-1]:
        end = at + pd.DateOffset(months=3)
        train, test = t < at, (t >= at) & (t < end)
        if test.any():
            f, _ = ridge(x[train], y[train])
            want.append((int(train.sum()), int(test.sum()), np.sqrt(np.mean((y[test] - f(x[test])) ** 2))))
        at = end
    got = [(r["train_size"], r["pred_size"], r["rmse"]) for r in periods.orderBy("iteration").collect()]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    np.testing.assert_allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-8)
    assert weights.count() == len(want) and predictions.count() == sum(w[1] for w in want)
    assert regress.overall(predictions).first()["num_iterations"] == len(want)
    with pytest.raises(ValueError, match="no target"):
        regress.prepare(df, ["f1"], "absent")


def squares(x, y, at, x_new):
    """Ridge of standardised features and their products of two, fitted to x[at], y[at]."""
    mean, scale = x[at].mean(0), x[at].std(0)

    def terms(v):
        z = (v - mean) / scale
        return np.column_stack([z, *[z[:, a] * z[:, b] for a in range(z.shape[1]) for b in range(a, z.shape[1])]])

    q = terms(x[at])
    c = q - q.mean(0)
    b = np.linalg.solve(c.T @ c + np.eye(c.shape[1]), c.T @ (y[at] - y[at].mean()))
    return y[at].mean() + (terms(x_new) - q.mean(0)) @ b, b


def test_walk_forward_of_second_degree_as_refits(spark):
    df, x, y = regression_frame(spark, 120, 8)
    df = df.withColumn("f1", F.col("f1") + 500.0)  # far from zero
    x = x + np.array([500.0, 0.0])
    p = Params(train_years=2, rebalance_months=1)
    periods, weights, predictions = regress.walk_forward(df, ["f1", "f2"], target="y", p=p, kind="polynomial")
    t = pd.date_range(T0, periods=120, freq="10D")
    got = {r["timestamp"]: r["prediction"] for r in predictions.collect()}
    at, n = t[0] + pd.DateOffset(years=2), 0
    while at < t[-1]:
        end = at + pd.DateOffset(months=1)
        train, test = t < at, (t >= at) & (t < end)
        if test.any():
            want, b = squares(x, y, train, x[test])
            np.testing.assert_allclose([got[v] for v in t[test].to_pydatetime()], want, rtol=1e-6)
            n += int(test.sum())
        at = end
    assert n == len(got) and weights.columns[3:] == ["f1", "f2", "f1*f1", "f1*f2", "f2*f2"]
    first = weights.orderBy("iteration").first()
    train = t < t[0] + pd.DateOffset(years=2)
    np.testing.assert_allclose([first[c] for c in weights.columns[3:]], squares(x, y, train, x[:1])[1], rtol=1e-6)


@pytest.mark.parametrize("start", ["2020-01-31", "2020-02-29", "2021-12-30 12:00:00", "2020-06-15"])
@pytest.mark.parametrize("months", [1, 2, 5])
def test_steps_as_iterated_months(spark, start, months):
    t = pd.date_range(start, periods=400, freq="3D12h")
    df = spark.createDataFrame([("a", k, v.to_pydatetime()) for k, v in enumerate(t)], "series_key string, seq bigint, timestamp timestamp")
    rows, bounds = regress._steps(df, Params(train_years=1, rebalance_months=months))
    want, at = [], t[0] + pd.DateOffset(years=1)
    while at <= t[-1] + pd.DateOffset(months=months):
        want.append(at)
        at = at + pd.DateOffset(months=months)
    found = [r["date"] for r in bounds.orderBy("iteration").collect()]
    assert found[: len(want) - 1] == [w.to_pydatetime() for w in want[:-1]]
    assert [r["iteration"] for r in rows.orderBy("seq").collect()] == [sum(w <= v for w in want) for v in t]


def test_univariate_of_second_degree(spark):
    df, x, y = regression_frame(spark, 90, 9)
    got = {r["feature"]: r for r in regress.univariate(df, ["f1", "f2"], target="y", kind="polynomial").collect()}
    for j, name in enumerate(("f1", "f2")):
        z = (x[:, j] - x[:, j].mean()) / x[:, j].std()
        q = np.c_[z, z * z]
        c = q - q.mean(0)
        rest = np.sum((y - y.mean() - c @ np.linalg.solve(c.T @ c + np.eye(2), c.T @ (y - y.mean()))) ** 2)
        assert got[name]["rmse"] == pytest.approx(np.sqrt(rest / len(y))) and got[name]["coefficient"] is None
    flat = regress.univariate(df.withColumn("f1", F.lit(3.0)), ["f1"], target="y", kind="polynomial").first()
    assert flat["rmse"] == pytest.approx(y.std()) and flat["r2"] == pytest.approx(0)


def test_logistic_of_each_series(spark):
    frames, want = None, {}
    for key, (n, seed, shift) in {"a": (80, 6, 3.0), "b": (150, 7, 0.5), "c": (60, 8, -100.0)}.items():
        df, x, y = regression_frame(spark, n, seed)
        df = df.withColumns({"series_key": F.lit(key), "y": F.col("y") - shift})
        frames = df if frames is None else frames.unionByName(df)
        k = int(n * 0.6)
        z = np.c_[(x - x[:k].mean(0)) / x[:k].std(0), np.ones(n)]
        label, w = (y - shift > 0).astype(float), np.zeros(3)
        for _ in range(200):  # damped gradient steps, another way to the same minimum
            p = 1 / (1 + np.exp(-z[:k] @ w))
            grad = z[:k].T @ (label[:k] - p) - np.array([w[0], w[1], 0])
            w = w + np.linalg.solve(z[:k].T @ (z[:k] * (p * (1 - p))[:, None]) + np.diag([1, 1, 1e-12]), grad) * 0.5
        p = 1 / (1 + np.exp(-z @ w))
        want[key] = (w, np.mean((p > 0.5) == (label > 0.5)), label)
    metrics_, weights = regress.logistic(frames, ["f1", "f2"], "y")
    rows = {r["series_key"]: r for r in metrics_.collect()}
    found = {key: [r["weight"] for r in weights.where(F.col("series_key") == key).collect()] for key in "ab"}
    for key in "ab":
        np.testing.assert_allclose(found[key], want[key][0], rtol=1e-6, atol=1e-8)
        assert rows[key]["rested"] and rows[key]["steps"] < 15
    assert rows["c"]["train_accuracy"] == 1.0  # one kind of label only
