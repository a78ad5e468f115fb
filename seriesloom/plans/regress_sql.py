"""SQL twins of the ridge regressions: moments, Gaussian elimination step by step, and the fit's quality."""

from __future__ import annotations

from itertools import combinations_with_replacement

from ..params import DEFAULTS


def solved(source: str, by: list[str], x: list[str], standardize: bool = True, name: str = "w") -> str:
    """Common tables, the last one called ``name``: by, n, mean_k, scale_k, weight_k and intercept of each group of source,
    which has the columns x and y."""
    k, keys = range(len(x)), ", ".join(by)
    pairs = list(combinations_with_replacement(k, 2))
    moments = [f"avg({c}) AS mean_{i}" for i, c in enumerate(x)] + [f"covar_pop({x[i]}, {x[j]}) * count(*) AS c_{i}_{j}" for i, j in pairs] + [f"covar_pop({c}, y) * count(*) AS t_{i}" for i, c in enumerate(x)]
    out = [f"{name}_m AS (SELECT {keys}, count(*) AS n, avg(y) AS intercept, {', '.join(moments)} FROM {source} GROUP BY {keys})"]
    scale = [f"sqrt(c_{i}_{i} / n)" if standardize else "1.0" for i in k]
    out.append(f"{name}_s AS (SELECT *, {', '.join(f'{s} AS scale_{i}' for i, s in enumerate(scale))} FROM {name}_m)")
    fixed = [*by, "n", "intercept", *[f"mean_{i}" for i in k], *[f"scale_{i}" for i in k]]
    cells = [f"c_{i}_{j} / (scale_{i} * scale_{j}){f' + {DEFAULTS.ridge_alpha}' if i == j else ''} AS a_{i}_{j}" for i, j in pairs] + [f"t_{i} / scale_{i} AS b_{i}" for i in k]
    out.append(f"{name}_0 AS (SELECT {', '.join([*fixed, *cells])} FROM {name}_s)")
    return ", ".join([*out, *_eliminated(fixed, len(x), name)])


def _eliminated(fixed: list[str], size: int, name: str) -> list[str]:
    """Tables from name_0, with the system (a_i_j, b_i) of each row, to name, with its solution weight_i."""
    k, out = range(size), []
    pairs = list(combinations_with_replacement(k, 2))
    for step in k[:-1]:  # the matrix is symmetric: only its upper half is kept
        cells = [f"a_{i}_{j}" if i <= step else f"a_{i}_{j} - a_{step}_{i} / a_{step}_{step} * a_{step}_{j} AS a_{i}_{j}" for i, j in pairs]
        cells += [f"b_{i}" if i <= step else f"b_{i} - a_{step}_{i} / a_{step}_{step} * b_{step} AS b_{i}" for i in k]
        out.append(f"{name}_{step + 1} AS (SELECT {', '.join([*fixed, *cells])} FROM {name}_{step})")
    before = f"{name}_{size - 1}"
    for i in reversed(k):
        known = "".join(f" - a_{i}_{j} * weight_{j}" for j in range(i + 1, size))
        now = name if i == 0 else f"{name}_back_{i}"
        out.append(f"{now} AS (SELECT *, (b_{i}{known}) / a_{i}_{i} AS weight_{i} FROM {before})")
        before = now
    return out


def prediction(x: list[str]) -> str:
    return "intercept" + "".join(f" + weight_{i} * ({c} - mean_{i}) / scale_{i}" for i, c in enumerate(x))


def prepared(featured: str, w: str, x: list[str]) -> str:
    """Common tables up to ``rows``: the next return y in percent and features x, without missing ones."""
    some = " AND ".join(f"{c} IS NOT NULL" for c in x)
    return f"{featured}, ahead AS (SELECT *, lead(returns * 100) OVER ({w}) AS y FROM f7), rows AS (SELECT series_key, seq, timestamp, {', '.join(x)}, y FROM ahead WHERE y IS NOT NULL AND {some})"


def _parted(prefix: str, w: str) -> str:
    return f"{prefix}, numbered AS (SELECT *, row_number() OVER ({w}) <= floor(count(*) OVER (PARTITION BY series_key) * {DEFAULTS.train_share}) AS train FROM rows), train AS (SELECT * FROM numbered WHERE train)"


def _quality(part: str) -> str:
    return f"count(*) FILTER ({part}) AS size, sum(pow(y - p, 2)) FILTER ({part}) AS rest, var_pop(y) FILTER ({part}) * count(*) FILTER ({part}) AS total"


def linear(featured: str, w: str, x: list[str]) -> str:
    """Common tables up to ``predicted`` (series_key, train, y, p) and ``w`` with the weights."""
    return f"{_parted(prepared(featured, w, x), w)}, {solved('train', ['series_key'], x)}, predicted AS (SELECT series_key, train, y, {prediction(x)} AS p FROM numbered JOIN w USING (series_key))"


def polynomial(featured: str, w: str, x: list[str]) -> str:
    """As linear, of the standardised features and all their products of two."""
    z = [f"z{i}" for i in range(len(x))]
    products = {f"z{i}_{j}": f"z{i} * z{j}" for i, j in combinations_with_replacement(range(len(x)), 2)}
    terms = [*z, *products]
    first = solved("train", ["series_key"], x, name="v")
    scaled = ", ".join(f"({c} - mean_{i}) / scale_{i} AS z{i}" for i, c in enumerate(x))
    return (
        f"{_parted(prepared(featured, w, x), w)}, {first}, scaled AS (SELECT series_key, train, y, {scaled} FROM numbered JOIN v USING (series_key)), "
        f"terms AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in products.items())} FROM scaled), learnt AS (SELECT * FROM terms WHERE train), "
        f"{solved('learnt', ['series_key'], terms, standardize=False)}, predicted AS (SELECT series_key, train, y, {prediction(terms)} AS p FROM terms JOIN w USING (series_key))"
    )


def metrics(tables: str, kind: str, r, extra: str = "") -> str:
    both = [f"SELECT series_key, '{part}' AS part, {_quality(cond)} FROM predicted GROUP BY 1" for part, cond in (("train", "train"), ("test", "NOT train"))]
    out = []
    for part in ("train", "test"):
        out += [f"max(size) FILTER (part = '{part}') AS {part}_size", f"{r(f'max(CASE WHEN total > 0 THEN 1 - rest / total ELSE 0 END) FILTER (part = {part!r})')} AS {part}_r2", f"{r(f'max(sqrt(rest / size)) FILTER (part = {part!r})')} AS {part}_rmse"]
    return f"WITH {tables}, q AS ({' UNION ALL '.join(both)}) SELECT series_key, {', '.join(out)}, '{kind}' AS kind{extra} FROM q GROUP BY 1"


def walked(featured: str, w: str, x: list[str]) -> str:
    """Common tables of the walk-forward fit: ``bounds`` (series_key, k, d), ``placed`` rows with their iteration, ``w`` by
    series_key and iteration."""
    years, months = DEFAULTS.train_years, DEFAULTS.rebalance_months
    return (
        f"{prepared(featured, w, x)}, spans AS (SELECT series_key, min(timestamp) AS start, min(timestamp) + INTERVAL {years} YEAR AS first, max(timestamp) AS last FROM rows GROUP BY 1), "
        f"bounds AS (SELECT series_key, 1 AS k, first AS d, start, last FROM spans WHERE first < last UNION ALL SELECT series_key, k + 1, d + INTERVAL {months} MONTH, start, last FROM bounds WHERE d <= last), "
        f"placed AS (SELECT r.*, (SELECT count(*) FROM bounds b WHERE b.series_key = r.series_key AND b.d <= r.timestamp) AS iteration FROM rows r WHERE series_key IN (SELECT series_key FROM bounds)), "
        f"steps AS (SELECT DISTINCT series_key, iteration FROM placed WHERE iteration > 0), "
        f"known AS (SELECT s.iteration, p.* EXCLUDE (iteration) FROM steps s JOIN placed p ON p.series_key = s.series_key AND p.iteration < s.iteration), {solved('known', ['series_key', 'iteration'], x)}"
    )


def walked_squares(featured: str, w: str, x: list[str]) -> str:
    """As walked, of standardised features and all their products of two: ``terms`` rows with their iteration."""
    by = ["series_key", "iteration"]
    z = [f"z{i}" for i in range(len(x))]
    products = {f"z{i}_{j}": f"z{i} * z{j}" for i, j in combinations_with_replacement(range(len(x)), 2)}
    scaled = ", ".join(f"({c} - mean_{i}) / scale_{i} AS z{i}" for i, c in enumerate(x))
    more = ", ".join(f"{e} AS {c}" for c, e in products.items())
    first = walked(featured, w, x)
    cut = first.rindex(", w_m AS (")
    return (
        f"{first[:cut]}, {solved('known', by, x, name='v')}, learnt AS (SELECT *, {more} FROM (SELECT series_key, iteration, y, {scaled} FROM known JOIN v USING (series_key, iteration))), "
        f"terms AS (SELECT *, {more} FROM (SELECT series_key, iteration, y, {scaled} FROM placed JOIN v USING (series_key, iteration))), {solved('learnt', by, [*z, *products], standardize=False)}"
    )


def squares_alone(featured: str, w: str, x: list[str], r) -> str:
    """Ridge of each standardised feature and its square alone."""
    tables, rows = [prepared(featured, w, x)], []
    for i, c in enumerate(x):
        tables.append(f"one_{i} AS (SELECT series_key, {c} AS x, y FROM rows), {solved(f'one_{i}', ['series_key'], ['x'], name=f'v{i}')}")
        tables.append(f"two_{i} AS (SELECT series_key, x, y, (x - mean_0) / scale_0 AS z, pow((x - mean_0) / scale_0, 2) AS zz FROM one_{i} JOIN v{i} USING (series_key)), {solved(f'two_{i}', ['series_key'], ['z', 'zz'], standardize=False, name=f'w{i}')}")
        tables.append(f"p{i} AS (SELECT series_key, x, y, {prediction(['z', 'zz'])} AS p FROM two_{i} JOIN w{i} USING (series_key))")
        rows.append(f"SELECT series_key, '{c}' AS feature, sum(pow(y - p, 2)) AS rest, var_pop(y) * count(*) AS total, count(*) AS n, corr(x, y) AS c FROM p{i} GROUP BY 1")
    return f"WITH {', '.join(tables)} SELECT series_key, feature, {r('1 - rest / total')} AS r2, {r('sqrt(rest / n)')} AS rmse, {r('c')} AS correlation, CAST(NULL AS DOUBLE) AS coefficient, {r('abs(c)')} AS abs_correlation FROM ({' UNION ALL '.join(rows)})"


def newton(featured: str, w: str, x: list[str], steps: int) -> str:
    """Common tables of a penalised logistic fit by so many steps of reweighted least squares: ``z`` rows, and the weights
    weight_0 to weight_k, the intercept last, in ``fit``."""
    k = len(x)
    pairs = list(combinations_with_replacement(range(k + 1), 2))
    means = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(x))
    scaled = ", ".join(f"({c} - m{i}) / s{i} AS z{i}" for i, c in enumerate(x))
    out = [_parted(prepared(featured, w, x), w), f"unit AS (SELECT series_key, {means} FROM train GROUP BY 1)", f"z AS MATERIALIZED (SELECT series_key, train, CAST(y > 0 AS DOUBLE) AS y, {scaled}, 1.0 AS z{k} FROM numbered JOIN unit USING (series_key))"]
    out.append(f"fit_0 AS (SELECT series_key, {', '.join(f'0.0 AS w{i}' for i in range(k + 1))} FROM unit)")
    for step in range(steps):
        guess = f"1 / (1 + exp(-({' + '.join(f'w{i} * z{i}' for i in range(k + 1))})))"
        name, kept = f"n{step}", [f"w{i}" for i in range(k + 1)]
        cells = [f"sum(p * (1 - p) * z{i} * z{j}){f' + {DEFAULTS.ridge_alpha}' if i == j < k else ''} AS a_{i}_{j}" for i, j in pairs]
        cells += [f"sum(z{i} * (y - p)){f' - {DEFAULTS.ridge_alpha} * any_value(w{i})' if i < k else ''} AS b_{i}" for i in range(k + 1)]
        out.append(f"{name}_0 AS (SELECT series_key, {', '.join(f'any_value({c}) AS {c}' for c in kept)}, {', '.join(cells)} FROM (SELECT *, {guess} AS p FROM z JOIN fit_{step} USING (series_key) WHERE train) GROUP BY 1)")
        out += _eliminated(["series_key", *kept], k + 1, name)
        out.append(f"fit_{step + 1} AS MATERIALIZED (SELECT series_key, {', '.join(f'w{i} + weight_{i} AS w{i}' for i in range(k + 1))} FROM {name})")
    return ", ".join([*out, f"fit AS (SELECT * FROM fit_{steps})"])


def logistic_metrics(tables: str, size: int, r) -> str:
    guess = f"1 / (1 + exp(-({' + '.join(f'w{i} * z{i}' for i in range(size + 1))})))"
    out = []
    for part, own in (("train", "train"), ("test", "NOT train")):
        out += [f"count(*) FILTER ({own}) AS {part}_size", f"{r(f'avg(CAST((p > 0.5) = (y > 0) AS DOUBLE)) FILTER ({own})')} AS {part}_accuracy", f"{r(f'avg(-ln(CASE WHEN y > 0 THEN p ELSE 1 - p END)) FILTER ({own})')} AS {part}_log_loss"]
    return f"WITH {tables} SELECT series_key, {', '.join(out)} FROM (SELECT *, {guess} AS p FROM z JOIN fit USING (series_key)) GROUP BY 1"


_PERIODS = (
    "q AS (SELECT series_key, iteration, max(n) AS train_size, count(*) AS size, sum(pow(y - p, 2)) AS rest, var_pop(y) * count(*) AS total FROM predicted GROUP BY 1, 2) "
    "SELECT q.series_key, CAST(q.iteration AS INTEGER) AS iteration, a.start AS train_start, a.d AS train_end, a.d AS pred_start, b.d AS pred_end, train_size, size AS pred_size, {r2} AS r2, {rmse} AS rmse "
    "FROM q JOIN bounds a ON a.series_key = q.series_key AND a.k = q.iteration LEFT JOIN bounds b ON b.series_key = q.series_key AND b.k = q.iteration + 1"
)


def more_twins(featured: str, w: str, x: list[str], r, steps: int) -> dict[str, str]:
    """Of the fits of second degree, the logistic fits, and what is read off predictions."""
    squares = f"WITH RECURSIVE {walked_squares(featured, w, x)}"
    terms = [*[f"z{i}" for i in range(len(x))], *[f"z{i}_{j}" for i, j in combinations_with_replacement(range(len(x)), 2)]]
    line = f"WITH RECURSIVE {walked(featured, w, x)}, predicted AS (SELECT p.series_key, p.iteration, timestamp, y, n, {prediction(x)} AS p FROM placed p JOIN w USING (series_key, iteration))"
    fitted = newton(featured, w, x, steps)
    weights = " UNION ALL ".join(f"SELECT series_key, '{c}' AS feature, {r(f'w{i}')} AS weight FROM fit" for i, c in enumerate([*x, "intercept"]))
    good = "CASE WHEN sum(1) > 0 AND var_pop(y) > 0 THEN 1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)) ELSE 0 END"
    return {
        "reg_walk_forward_squares": f"{squares}, predicted AS (SELECT t.series_key, t.iteration, y, n, {prediction(terms)} AS p FROM terms t JOIN w USING (series_key, iteration)), {_PERIODS.format(r2=r('CASE WHEN total > 0 THEN 1 - rest / total ELSE 0 END'), rmse=r('sqrt(rest / size)'))}",
        "reg_univariate_squares": squares_alone(featured, w, x, r),
        "reg_logistic": logistic_metrics(fitted, len(x), r),
        "reg_logistic_weights": f"WITH {fitted} {weights}",
        "reg_overall": f"{line} SELECT series_key, count(DISTINCT iteration) AS num_iterations, {r(good)} AS overall_r2, {r('sqrt(avg(pow(y - p, 2)))')} AS overall_rmse FROM predicted GROUP BY 1",
        "reg_residuals": f"{line} SELECT series_key, timestamp, CAST(iteration AS INTEGER) AS iteration, {r('y')} AS actual, {r('p')} AS prediction, {r('y - p')} AS residual FROM predicted",
        "reg_spline": metrics(linear(featured, w, x), "linear", r),
    }


def twins(featured: str, w: str, x: list[str], r) -> dict[str, str]:
    """r(expression) is the rounded expression."""
    walk = f"WITH RECURSIVE {walked(featured, w, x)}"
    line = linear(featured, w, x)
    weights = " UNION ALL ".join(f"SELECT series_key, '{c}' AS feature, weight_{i} AS weight FROM w" for i, c in enumerate(x))
    return {
        "reg_mode1": metrics(line, "linear", r),
        "reg_compare": f"SELECT * FROM ({metrics(line, 'linear', r, chr(44) + ' ' + repr('linear') + ' AS method')}) UNION ALL SELECT * FROM ({metrics(polynomial(featured, w, x), 'polynomial', r, chr(44) + ' ' + repr('polynomial') + ' AS method')})",
        "reg_importance": f"WITH {line}, u AS ({weights}) SELECT series_key, feature, {r('weight')} AS weight, {r('abs(weight)')} AS abs_weight, CAST(row_number() OVER (PARTITION BY series_key ORDER BY abs(weight) DESC, feature) AS INTEGER) AS rank FROM u",
        "reg_walk_forward": f"{walk}, predicted AS (SELECT p.series_key, p.iteration, y, n, {prediction(x)} AS p FROM placed p JOIN w USING (series_key, iteration)), "
        "q AS (SELECT series_key, iteration, max(n) AS train_size, count(*) AS size, sum(pow(y - p, 2)) AS rest, var_pop(y) * count(*) AS total FROM predicted GROUP BY 1, 2) "
        "SELECT q.series_key, CAST(q.iteration AS INTEGER) AS iteration, a.start AS train_start, a.d AS train_end, a.d AS pred_start, b.d AS pred_end, train_size, size AS pred_size, "
        f"{r('CASE WHEN total > 0 THEN 1 - rest / total ELSE 0 END')} AS r2, {r('sqrt(rest / size)')} AS rmse FROM q JOIN bounds a ON a.series_key = q.series_key AND a.k = q.iteration LEFT JOIN bounds b ON b.series_key = q.series_key AND b.k = q.iteration + 1",
        "reg_weights": f"{walk} SELECT w.series_key, CAST(w.iteration AS INTEGER) AS iteration, b.d AS date, {', '.join(f'{r(f'weight_{i}')} AS {c}' for i, c in enumerate(x))} FROM w JOIN bounds b ON b.series_key = w.series_key AND b.k = w.iteration",
    }
