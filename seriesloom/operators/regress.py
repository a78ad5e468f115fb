"""Ridge regressions of a series' next return on its features.

A fit needs only sums of products (the Gram matrix), which one grouped
aggregate gives for every series, or for every series and period. The small
systems are solved per series in a Pandas group whose rows are the sums of
periods, never the data; predictions are column expressions again.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import KEY, change, correlation, ratio, series_window
from ..params import DEFAULTS, Params
from ..sources.scratch import settled

TARGET = "return_1_ahead"


def prepare(df: DataFrame, features: list[str], target: str = TARGET) -> DataFrame:
    """Rows with all features and the target; a missing default target is made, another missing one is an error."""
    if target not in df.columns:
        if target != TARGET:
            raise ValueError(f"no target column {target!r}")
        df = df.withColumn("_r", change("price") * 100)
        df = df.withColumn(TARGET, F.lead("_r").over(series_window())).drop("_r")
    return df.dropna("any", subset=[*features, target])


def _gram(df: DataFrame, features: list[str], target: str, by: list[str]) -> DataFrame:
    """n, sums s, products with the target t, products of pairs q (upper triangle), y, yy."""
    x = [F.col(f).cast("double") for f in features]
    y = F.col(target).cast("double")
    pairs = combinations_with_replacement(range(len(x)), 2)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.array(*[F.sum(c) for c in x]).alias("s"), F.array(*[F.sum(c * y) for c in x]).alias("t"),
        F.array(*[F.sum(x[a] * x[b]) for a, b in pairs]).alias("q"), F.sum(y).alias("y"), F.sum(y * y).alias("yy"),
    )


def solve_ridge(n: float, s: np.ndarray, t: np.ndarray, q: np.ndarray, y: float, alpha: float, standardize: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(means, scales, weights, intercept): penalised weights of features that are centred and, if asked, divided by
    their population deviation; a constant feature is divided by one. The intercept is not penalised."""
    k = len(s)
    full = np.zeros((k, k))
    full[np.triu_indices(k)] = q
    full = full + np.triu(full, 1).T
    mean = s / n
    cov = full - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov) / n, 0)) if standardize else np.ones(k)
    scale[scale <= 1e-12 * np.maximum(1, np.abs(mean))] = 1.0
    a = cov / np.outer(scale, scale) + alpha * np.eye(k)
    return mean, scale, np.linalg.solve(a, (t - mean * y) / scale), y / n


_FIT = "mean array<double>, scale array<double>, weight array<double>, intercept double"


def _fit(gram: DataFrame, by: list[str], alpha: float, standardize: bool = True) -> DataFrame:
    kinds = ", ".join(f"{c} {gram.schema[c].dataType.simpleString()}" for c in by)

    def solve(batches):
        for g in batches:
            rows = [(*[r[c] for c in by], *map(list, (f := solve_ridge(r["n"], np.array(r["s"]), np.array(r["t"]), np.array(r["q"]), r["y"], alpha, standardize))[:3]), float(f[3])) for _, r in g.iterrows()]
            yield pd.DataFrame(rows, columns=[*by, "mean", "scale", "weight", "intercept"])

    return gram.mapInPandas(solve, f"{kinds}, {_FIT}")


def _prediction(features: list[str]) -> Column:
    terms = [F.col("weight")[k] * (F.col(f) - F.col("mean")[k]) / F.col("scale")[k] for k, f in enumerate(features)]
    return sum(terms, F.col("intercept"))


def _fit_quality(actual: Column, predicted: Column) -> tuple[Column, Column]:
    """R squared (0 if the actual values do not vary) and root mean squared error."""
    rest = F.sum(F.pow(actual - predicted, F.lit(2.0)))
    total = F.var_pop(actual) * F.count(actual)
    return F.when(total > 0, 1 - rest / total).otherwise(0.0), F.sqrt(rest / F.count(actual))


def _squares(df: DataFrame, features: list[str], fit: DataFrame) -> tuple[DataFrame, list[str]]:
    """Columns of the standardised features and all their products of two."""
    df = df.join(fit.select(KEY, "mean", "scale"), KEY)
    df = df.withColumns({f"_z{k}": (F.col(f) - F.col("mean")[k]) / F.col("scale")[k] for k, f in enumerate(features)}).drop("mean", "scale")
    names = [f"_z{k}" for k in range(len(features))]
    products = {f"{features[a]}*{features[b]}": F.col(f"_z{a}") * F.col(f"_z{b}") for a, b in combinations_with_replacement(range(len(features)), 2)}
    df = df.withColumns(dict(zip(features, map(F.col, names), strict=True)) | products).drop(*names)
    return df, [*features, *products]


def train_test(df: DataFrame, features: list[str], kind: str = "linear", target: str = TARGET, p: Params = DEFAULTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics, weights, predictions) of a fit on the first share of each series, held against the rest.

    kind: linear; polynomial (degree two); spline and unknown kinds fall back to linear, as metrics.kind tells.
    """
    used = "polynomial" if kind == "polynomial" else "linear"
    df = prepare(df, features, target)
    n = F.count(F.lit(1)).over(Window.partitionBy(KEY))
    df = df.withColumn("train", F.row_number().over(series_window()) <= F.floor(n * p.train_share))
    fit = _fit(_gram(df.where("train"), features, target, [KEY]), [KEY], p.ridge_alpha)
    names = features
    if used == "polynomial":
        df, names = _squares(df, features, fit)
        fit = _fit(_gram(df.where("train"), names, target, [KEY]), [KEY], p.ridge_alpha, standardize=False)
    predicted = df.join(fit, KEY).select(KEY, "seq", "timestamp", "train", F.col(target).cast("double").alias("actual"), _prediction(names).alias("prediction"))
    both = {}
    for part, rows in (("train", F.col("train")), ("test", ~F.col("train"))):
        r2, rmse = _fit_quality(F.when(rows, F.col("actual")), F.when(rows, F.col("prediction")))
        both |= {f"{part}_size": F.count_if(rows), f"{part}_r2": r2, f"{part}_rmse": rmse}
    metrics = predicted.groupBy(KEY).agg(*[c.alias(k) for k, c in both.items()]).withColumn("kind", F.lit(used))
    weights = fit.select(KEY, F.inline(F.arrays_zip(F.array(*map(F.lit, names)).alias("feature"), F.col("weight")))).toDF(KEY, "feature", "weight")
    return metrics, weights, predicted


def importance(weights: DataFrame) -> DataFrame:
    w = Window.partitionBy(KEY).orderBy(F.abs("weight").desc(), "feature")
    return weights.select(KEY, "feature", "weight", F.abs("weight").alias("abs_weight"), F.row_number().over(w).alias("rank"))


def _steps(df: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """(rows with start and iteration, bounds (series_key, iteration, date) of the steps of each series that has one).

    Bounds are whole months apart, so a row's month tells its step but for the days of a bound's own month: a row meets one
    bound and no list of them.
    """
    ends = df.groupBy(KEY).agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"))
    first = F.expr(f"start + make_ym_interval({p.train_years}, 0)")
    count = F.greatest(F.ceil(F.months_between("end", first) / p.rebalance_months).cast("int") + 1, F.lit(1))
    ends = ends.where(first < F.col("end")).withColumns({"first": first, "count": count})
    dates = f"aggregate(sequence(1, count), array(first), (a, k) -> concat(a, array(element_at(a, -1) + make_ym_interval(0, {p.rebalance_months}))))"
    bounds = ends.select(KEY, F.posexplode(F.expr(dates)).alias("iteration", "date")).withColumn("iteration", F.col("iteration") + 1)
    month = lambda c: F.year(c) * 12 + F.month(c)
    rows = df.join(ends.select(KEY, "start", month("first").alias("_first")), KEY)
    past = month("timestamp") - F.col("_first")
    rows = rows.withColumn("_k", F.floor(past / p.rebalance_months).cast("int"))
    near = bounds.select(KEY, (F.col("iteration") - 1).alias("_k"), F.col("date").alias("_bound"))
    rows = rows.join(near, [KEY, "_k"], "left")
    step = F.when(F.col("_k") < 0, 0).otherwise(F.col("_k") + F.when(F.col("timestamp") >= F.col("_bound"), 1).otherwise(0))
    return rows.withColumn("iteration", step.cast("int")).drop("_first", "_k", "_bound"), bounds


def _raw_terms(features: list[str]) -> list[tuple[int, ...]]:
    return [(k,) for k in range(len(features))] + list(combinations_with_replacement(range(len(features)), 2))


def polynomial_sums(n: float, s: np.ndarray, q: np.ndarray, t: np.ndarray, y: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, sums, products and products with the target) of k standardised features and their products of two.

    Takes the same sums of the features and products as they are. Standardising is affine, so each term is a sum of the
    terms of no higher degree: with that matrix the sums change without a look at the rows.
    """
    terms = [(), *_raw_terms([""] * k)]
    size = len(terms)
    full = np.zeros((size, size))
    full[0, 0], full[0, 1:] = n, s
    upper = np.zeros((size - 1, size - 1))
    upper[np.triu_indices(size - 1)] = q
    full[1:, 1:] = upper
    full = full + np.triu(full, 1).T
    mean = s[:k] / n
    scale = np.sqrt(np.maximum(full[range(1, k + 1), range(1, k + 1)] / n - mean**2, 0))
    scale[scale <= 1e-12 * np.maximum(1, np.abs(mean))] = 1.0
    at = {term: i for i, term in enumerate(terms)}
    change_ = np.zeros((size, size))
    change_[0, 0] = 1
    for term in terms[1:]:
        if len(term) == 1:
            (a,) = term
            change_[at[term], at[term]], change_[at[term], 0] = 1 / scale[a], -mean[a] / scale[a]
        else:
            a, b = term
            unit = scale[a] * scale[b]
            change_[at[term], at[term]] += 1 / unit
            change_[at[term], at[(a,)]] -= mean[b] / unit
            change_[at[term], at[(b,)]] -= mean[a] / unit
            change_[at[term], 0] += mean[a] * mean[b] / unit
    new = change_ @ full @ change_.T
    return mean, scale, new[0, 1:], new[1:, 1:][np.triu_indices(size - 1)], (change_ @ np.concatenate([[y], t]))[1:]


def _term_names(features: list[str]) -> list[str]:
    return [*features, *[f"{features[a]}*{features[b]}" for a, b in combinations_with_replacement(range(len(features)), 2)]]


def _polynomial_prediction(features: list[str]) -> Column:
    """Of a fit whose mean and scale are those of the features, and whose centre is the mean of all terms."""
    z = [(F.col(f) - F.col("mean")[k]) / F.col("scale")[k] for k, f in enumerate(features)]
    terms = [*z, *[z[a] * z[b] for a, b in combinations_with_replacement(range(len(features)), 2)]]
    return sum((F.col("weight")[k] * (c - F.col("centre")[k]) for k, c in enumerate(terms)), F.col("intercept"))


def _shifted(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Columns of the features less their series' mean and by its deviation, and their products of two: sums of fourth order
    of values far from zero would lose the digits that matter. Any shift gives the same fits."""
    parts = [f(F.col(c).cast("double")).alias(f"{n}{k}") for k, c in enumerate(features) for n, f in (("_m", F.avg), ("_s", F.stddev_pop))]
    df = df.join(df.groupBy(KEY).agg(*parts), KEY)
    unit = [F.when(F.col(f"_s{k}") > 0, F.col(f"_s{k}")).otherwise(1.0) for k in range(len(features))]
    df = df.withColumns({f"_u{k}": (F.col(c).cast("double") - F.col(f"_m{k}")) / unit[k] for k, c in enumerate(features)})
    pairs = {f"_u{a}_{b}": F.col(f"_u{a}") * F.col(f"_u{b}") for a, b in combinations_with_replacement(range(len(features)), 2)}
    return df.withColumns(pairs).drop(*[f"{n}{k}" for k in range(len(features)) for n in ("_m", "_s")]), [*[f"_u{k}" for k in range(len(features))], *pairs]


def walk_forward(df: DataFrame, features: list[str], target: str = TARGET, p: Params = DEFAULTS, kind: str = "linear") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(periods, weights, predictions): a fit for each step on all that came before it, from the start of the series.

    The first step begins ``train_years`` after the first row; steps are ``rebalance_months`` long and half open, each
    added to the one before, so a day that a month lacks is not regained. Every row is summed up once, by its step, and
    the sums of the steps before are added up. kind: linear, or polynomial (degree two), whose fits standardise the
    features anew at each step; other kinds fall back to linear.
    """
    squares = kind == "polynomial"
    df, bounds = _steps(prepare(df, features, target), p)
    given, k = features, len(features)
    if squares:
        df, terms = _shifted(df, features)
        features = terms[:k]
    else:
        terms = features
    gram = _gram(df, terms, target, [KEY, "iteration"])
    key_type = gram.schema[KEY].dataType.simpleString()

    def fit_of(n, s, t, q, y):
        if not squares:
            return *solve_ridge(n, s, t, q, y, p.ridge_alpha), np.zeros(0)
        mean, scale, s, q, t = polynomial_sums(n, s, q, t, y, k)
        centre, _, weight, intercept = solve_ridge(n, s, t, q, y, p.ridge_alpha, standardize=False)
        return mean, scale, weight, intercept, centre

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("iteration")
        n, y = g["n"].cumsum().to_numpy(), g["y"].cumsum().to_numpy()
        s, t, q = (np.cumsum(np.array(g[c].tolist()), axis=0) for c in ("s", "t", "q"))
        rows = []
        for i in range(1, len(g)):
            mean, scale, weight, intercept, centre = fit_of(n[i - 1], s[i - 1], t[i - 1], q[i - 1], y[i - 1])
            rows.append((g[KEY].iloc[0], int(g["iteration"].iloc[i]), int(n[i - 1]), mean.tolist(), scale.tolist(), weight.tolist(), float(intercept), centre.tolist()))
        return pd.DataFrame(rows, columns=[KEY, "iteration", "train_size", "mean", "scale", "weight", "intercept", "centre"])

    # Rows of a group are its steps, one for each month of the series.
    fit = gram.groupBy(KEY).applyInPandas(solve, f"{KEY} {key_type}, iteration int, train_size bigint, {_FIT}, centre array<double>")
    prediction = _polynomial_prediction(features) if squares else _prediction(features)
    predicted = df.join(fit, [KEY, "iteration"]).select(KEY, "seq", "timestamp", "iteration", "train_size", "start", prediction.alias("prediction"), F.col(target).cast("double").alias("actual"))
    r2, rmse = _fit_quality(F.col("actual"), F.col("prediction"))
    periods = predicted.groupBy(KEY, "iteration").agg(F.max("start").alias("train_start"), F.max("train_size").alias("train_size"), F.count(F.lit(1)).alias("pred_size"), r2.alias("r2"), rmse.alias("rmse"))
    begins = bounds.select(KEY, "iteration", F.col("date").alias("train_end"), F.col("date").alias("pred_start"))
    ends = bounds.select(KEY, (F.col("iteration") - 1).alias("iteration"), F.col("date").alias("pred_end"))
    periods = periods.join(begins, [KEY, "iteration"]).join(ends, [KEY, "iteration"], "left")
    periods = periods.select(KEY, "iteration", "train_start", "train_end", "pred_start", "pred_end", "train_size", "pred_size", "r2", "rmse")
    weights = fit.join(bounds, [KEY, "iteration"]).select(KEY, "iteration", "date", *[F.col("weight")[i].alias(f) for i, f in enumerate(_term_names(given) if squares else given)])
    return periods, weights, predicted.drop("start", "train_size")


def overall(predictions: DataFrame) -> DataFrame:
    r2, rmse = _fit_quality(F.col("actual"), F.col("prediction"))
    return predictions.groupBy(KEY).agg(F.count_distinct("iteration").alias("num_iterations"), r2.alias("overall_r2"), rmse.alias("overall_rmse"))


def univariate(df: DataFrame, features: list[str], target: str = TARGET, p: Params = DEFAULTS, kind: str = "linear") -> DataFrame:
    """Each feature alone, within the sample, by the closed form of ridge: of the standardised feature or, for a polynomial,
    of it and its square, whose two weights have no single coefficient. Other kinds fall back to linear."""
    df = prepare(df, features, target)
    y = F.col(target).cast("double")
    if kind == "polynomial":
        return _univariate_squares(df, features, y, p)
    parts = [F.struct(F.lit(f).alias("feature"), F.count(F.lit(1)).cast("double").alias("n"), F.stddev_pop(f).alias("s"), F.covar_pop(f, y).alias("c"), F.var_pop(y).alias("v"), correlation(f, y).alias("correlation")) for f in features]
    sums = df.groupBy(KEY).agg(F.array(*parts).alias("rows")).select(KEY, F.inline("rows"))
    slope = F.coalesce(ratio(F.col("c"), F.col("s")), F.lit(0.0))  # of the standardised feature, not shrunk
    sums = sums.withColumn("coefficient", slope * F.col("n") / (F.col("n") + p.ridge_alpha))
    rest = F.col("v") - 2 * F.col("coefficient") * slope + F.col("coefficient") * F.col("coefficient") * F.when(F.col("s") > 0, 1.0).otherwise(0.0)
    return sums.select(KEY, "feature", F.when(F.col("v") > 0, 1 - ratio(rest, F.col("v"))).otherwise(0.0).alias("r2"), F.sqrt(F.greatest(rest, F.lit(0.0))).alias("rmse"), "correlation", "coefficient", F.abs("correlation").alias("abs_correlation"))


def _univariate_squares(df: DataFrame, features: list[str], y: Column, p: Params) -> DataFrame:
    """Moments of a standardised feature z and its square: z has mean 0 and variance 1, so what its square needs are the
    third and fourth moments, and a ridge of two terms is a system of two equations."""
    parts = []
    for f in features:
        x = F.col(f).cast("double")
        parts.append(F.struct(F.lit(f).alias("feature"), F.count(F.lit(1)).cast("double").alias("n"), F.avg(x).alias("m"), F.stddev_pop(x).alias("s"), F.skewness(x).alias("g"), (F.kurtosis(x) + 3).alias("h"), F.covar_pop(x, y).alias("c1"), F.covar_pop(x * x, y).alias("c2"), F.var_pop(y).alias("v"), correlation(x, y).alias("correlation")))
    sums = df.groupBy(KEY).agg(F.array(*parts).alias("rows")).select(KEY, F.inline("rows"))
    varies = F.col("s") > 0
    g, h, n, v = F.coalesce("g", F.lit(0.0)), F.coalesce("h", F.lit(1.0)), F.col("n"), F.col("v")
    one = F.when(varies, F.col("c1") / F.col("s")).otherwise(0.0)
    two = F.when(varies, (F.col("c2") - 2 * F.col("m") * F.col("c1")) / (F.col("s") * F.col("s"))).otherwise(0.0)
    # variances and covariance of z and its square, the target's with both, all by n; alpha on the diagonal
    a, b, d = F.when(varies, 1.0).otherwise(0.0), F.when(varies, g).otherwise(0.0), F.when(varies, h - 1).otherwise(0.0)
    shrunk = p.ridge_alpha / n
    det = (a + shrunk) * (d + shrunk) - b * b
    sums = sums.withColumns({"_one": one, "_two": two, "_a": a, "_b": b, "_d": d})
    sums = sums.withColumns({"_w1": ((d + shrunk) * one - b * two) / det, "_w2": ((a + shrunk) * two - b * one) / det})
    w1, w2 = F.col("_w1"), F.col("_w2")
    rest = v - 2 * (w1 * F.col("_one") + w2 * F.col("_two")) + w1 * w1 * F.col("_a") + 2 * w1 * w2 * F.col("_b") + w2 * w2 * F.col("_d")
    return sums.select(KEY, "feature", F.when(v > 0, 1 - ratio(rest, v)).otherwise(0.0).alias("r2"), F.sqrt(F.greatest(rest, F.lit(0.0))).alias("rmse"), "correlation", F.lit(None).cast("double").alias("coefficient"), F.abs("correlation").alias("abs_correlation"))


def compare_kinds(df: DataFrame, features: list[str], kinds: tuple[str, ...] = ("linear", "polynomial"), target: str = TARGET, p: Params = DEFAULTS) -> DataFrame:
    """Metrics of each kind, the best of a series on its test part first."""
    out = None
    for kind in kinds:
        one = train_test(df, features, kind, target, p)[0].withColumn("method", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out.orderBy(KEY, F.col("test_r2").desc_nulls_last(), "method")


#: Steps of the logistic fit at most, and the change of a weight that ends it.
LOGISTIC_STEPS, SETTLED = 25, 1e-10


def _newton(g: dict, alpha: float) -> np.ndarray:
    """The change of the weights, the intercept last, that the sums of a step ask for; the intercept is not penalised."""
    k = len(g["weight"])
    full = np.zeros((k, k))
    full[np.triu_indices(k)] = g["q"]
    full = full + np.triu(full, 1).T
    shrink = np.append(np.full(k - 1, alpha), 0.0)
    w = np.array(g["weight"])
    return np.linalg.solve(full + np.diag(shrink) + 1e-12 * np.eye(k), np.array(g["t"]) - shrink * w)


def logistic(df: DataFrame, features: list[str], target: str = TARGET, p: Params = DEFAULTS, steps: int = LOGISTIC_STEPS) -> tuple[DataFrame, DataFrame]:
    """(metrics, weights) of a penalised logistic fit of target > 0 for each series, on its first share, held against the rest.

    Iterated reweighted least squares: a step is one grouped aggregate of weighted products for all series that still
    move, and one small system for each of them. Features are standardised by the training rows; a series ends when no
    weight moves by more than SETTLED. metrics: sizes, accuracies and mean log losses of both parts, steps taken and
    whether the fit came to rest. A series whose labels are all alike has a large intercept and rests late or not at all.
    """
    df = prepare(df, features, target)
    n = F.count(F.lit(1)).over(Window.partitionBy(KEY))
    df = df.withColumn("train", F.row_number().over(series_window()) <= F.floor(n * p.train_share))
    x = [F.col(f).cast("double") for f in features]
    scales = [f(F.when(F.col("train"), c)).alias(f"{n}{i}") for i, c in enumerate(x) for n, f in (("_m", F.avg), ("_s", F.stddev_pop))]
    rows = df.join(df.groupBy(KEY).agg(*scales), KEY)
    z = [(c - F.col(f"_m{i}")) / F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(1.0) for i, c in enumerate(x)]
    rows = settled(rows.select(KEY, "train", F.array(*z, F.lit(1.0)).alias("z"), (F.col(target) > 0).cast("double").alias("y")))

    k = len(features) + 1
    at_rest = F.lit(False)
    fit = settled(rows.where("train").select(KEY).distinct().select(KEY, F.array(*[F.lit(0.0)] * k).alias("weight"), F.lit(0).alias("steps"), at_rest.alias("rested")))
    kinds = f"{KEY} {rows.schema[KEY].dataType.simpleString()}, weight array<double>, steps int, rested boolean"

    def move(batches):
        for g in batches:
            out = []
            for r in g.to_dict("records"):
                change_ = _newton(r, p.ridge_alpha)
                out.append((r[KEY], (np.array(r["weight"]) + change_).tolist(), int(r["steps"]) + 1, bool(np.abs(change_).max() < SETTLED)))
            yield pd.DataFrame(out, columns=[KEY, "weight", "steps", "rested"])

    def guess() -> Column:
        return 1 / (1 + F.exp(-sum((F.col("weight")[i] * F.col("z")[i] for i in range(k)), F.lit(0.0))))

    for _ in range(steps):
        moving = fit.where("not rested")
        if moving.isEmpty():
            break
        both = rows.where("train").join(moving, KEY).withColumn("_p", guess())
        w = F.col("_p") * (1 - F.col("_p"))
        zi = [F.col("z")[i] for i in range(k)]
        sums = both.groupBy(KEY, "steps").agg(F.first("weight").alias("weight"), F.array(*[F.sum(c * (F.col("y") - F.col("_p"))) for c in zi]).alias("t"), F.array(*[F.sum(w * zi[a] * zi[b]) for a, b in combinations_with_replacement(range(k), 2)]).alias("q"))
        fit = settled(fit.where("rested").unionByName(sums.mapInPandas(move, kinds)))

    scored = rows.join(fit, KEY).withColumn("_p", guess())
    right = (F.col("_p") > 0.5) == (F.col("y") > 0)
    loss = -F.log(F.greatest(F.when(F.col("y") > 0, F.col("_p")).otherwise(1 - F.col("_p")), F.lit(1e-300)))
    both = {}
    for part, own in (("train", F.col("train")), ("test", ~F.col("train"))):
        both |= {f"{part}_size": F.count_if(own), f"{part}_accuracy": F.avg(F.when(own, right.cast("double"))), f"{part}_log_loss": F.avg(F.when(own, loss))}
    metrics = scored.groupBy(KEY).agg(*[c.alias(n) for n, c in both.items()], F.max("steps").alias("steps"), F.max("rested").alias("rested"), F.lit("logistic").alias("kind"))
    names = F.array(*[F.lit(f) for f in [*features, "intercept"]])
    return metrics, fit.select(KEY, F.inline(F.arrays_zip(names.alias("feature"), F.col("weight")))).toDF(KEY, "feature", "weight")
