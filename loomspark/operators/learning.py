"""Small linear models per group: sums in Spark, the solution of a small system in numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def moments(rows: DataFrame, keys: Sequence[str], features: Sequence[str], target: str) -> DataFrame:
    """n, sums and sums of products of features and target per group; partial sums are made where the rows are."""
    every = [*features, target]
    sums = [F.sum(c).alias(f"s_{i}") for i, c in enumerate(every)]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p_{i}_{j}") for i, a in enumerate(every) for j, b in enumerate(every) if i <= j]
    return rows.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), *sums, *products)


def ridge(n: float, sums: np.ndarray, products: np.ndarray, alpha: float, floor: float | None = 1e-8) -> np.ndarray:
    """Intercept and slopes of a ridge fit on standardised features; the intercept isn't penalised.

    A feature that doesn't vary has the scale ``floor``, or 1 if that is None.
    """
    k = len(sums) - 1
    mean = sums / n
    spread = np.sqrt(np.maximum(np.diag(products)[:k] / n - mean[:k] ** 2, 0))
    scale = np.maximum(spread, floor) if floor is not None else np.where(spread < 1e-8, 1.0, spread)
    centred = products - n * np.outer(mean, mean)
    gram = centred[:k, :k] / np.outer(scale, scale) + alpha * np.eye(k)
    slopes = np.linalg.solve(gram, centred[:k, k] / scale) / scale
    return np.concatenate([[mean[k] - slopes @ mean[:k]], slopes])


def leave_one_group_out(rows: DataFrame, group: str, features: Sequence[str], target: str, alpha: float, most_groups: int = 100_000) -> DataFrame:
    """For each group the coefficients fitted on all other groups, as an array, intercept first.

    The groups' sums, whose number is checked, meet in one task; the rows don't.
    The fits are as few, so rows should meet them by a broadcast: by a shuffle
    all rows of a group would be sorted in one task.
    A group that is all there is has null coefficients.
    """
    sums = moments(rows, [group], features, target)
    k = len(features) + 1
    kind = dict(rows.dtypes)[group]

    def fit(batches):
        pdf = pd.concat(list(batches), ignore_index=True)
        if not len(pdf):
            return
        if len(pdf) > most_groups:
            raise ValueError(f"{len(pdf)} groups")
        pdf = pdf.sort_values(group, ignore_index=True)
        n = pdf["n"].to_numpy()
        s = np.stack([pdf[f"s_{i}"].to_numpy() for i in range(k)], 1)
        p = np.zeros((len(pdf), k, k))
        for i in range(k):
            for j in range(i, k):
                p[:, i, j] = p[:, j, i] = pdf[f"p_{i}_{j}"]
        out = []
        for i in range(len(pdf)):
            rest = n.sum() - n[i]
            out.append(ridge(rest, s.sum(0) - s[i], p.sum(0) - p[i], alpha).tolist() if rest > 0 else None)
        yield pd.DataFrame({group: pdf[group], "coefficients": out})

    return sums.coalesce(1).mapInPandas(fit, f"{group} {kind}, coefficients array<double>")


def ridge_many(rows: DataFrame, keys: Sequence[str], features: Sequence[str], targets: Sequence[str], alpha: float, least_rows: int = 1) -> DataFrame:
    """``keys``, target and coefficients (intercept first) of a ridge fit of every target on the same features.

    Sums and products are made once for all targets, where the rows are; the
    features' Gram matrix is factored once for all of them. The intercept isn't
    penalised and features are standardised, one that doesn't vary has the scale
    1. Rows with a null in any feature or target don't count; a group with fewer
    than ``least_rows`` others has no fit.
    """
    k, m = len(features), len(targets)
    every = [*features, *targets]
    whole = rows.dropna(subset=every)
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p_{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(every) if i <= j]
    sums = whole.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), *(F.sum(c).cast("double").alias(f"s_{i}") for i, c in enumerate(every)), *products).filter(F.col("n") >= least_rows)
    kinds = dict(rows.dtypes)

    def fit(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                at = row._asdict()
                n, mean = at["n"], np.array([at[f"s_{i}"] for i in range(k + m)]) / at["n"]
                p = np.zeros((k, k + m))
                for i in range(k):
                    for j in range(i, k + m):
                        p[i, j] = at[f"p_{i}_{j}"]
                        if j < k:
                            p[j, i] = p[i, j]
                centred = p - n * np.outer(mean[:k], mean)
                spread = np.sqrt(np.maximum(np.diag(centred) / n, 0))
                scale = np.where(spread < 1e-8, 1.0, spread)
                slopes = np.linalg.solve(centred[:, :k] / np.outer(scale, scale) + alpha * np.eye(k), centred[:, k:] / scale[:, None]) / scale[:, None]
                intercepts = mean[k:] - mean[:k] @ slopes
                out += [[*(at[key] for key in keys), t, [float(intercepts[i]), *slopes[:, i].tolist()]] for i, t in enumerate(targets)]
            yield pd.DataFrame(out, columns=[*keys, "target", "coefficients"])

    return sums.mapInPandas(fit, ", ".join([*(f"{c} {kinds[c]}" for c in keys), "target string, coefficients array<double>"]))


def fold_regret(rows: DataFrame, fold: str, case: Sequence[str], item: str, features: Sequence[str], target: str, utility: str, passed: str, alpha: float) -> DataFrame:
    """What choosing by a model costs, for each case of each fold: the model is fitted without the fold.

    A case's items are tried in falling order of their predicted ``target``
    (ties by name) until one has ``passed``. Returns ``fold``, ``case``, first
    (the item tried first), first_passed, selected, predicted, selected_utility,
    evaluated (items tried), oracle (the passing item of the highest utility, the
    first by name of several), oracle_utility, regret and exact. A case in which nothing passes has
    nulls but for the first, and evaluated counts all its items.
    """
    fits = leave_one_group_out(rows, fold, features, target, alpha)
    scored = rows.join(F.broadcast(fits), fold).withColumn("_predicted", predict("coefficients", features)).withColumn("_ok", F.coalesce(F.col(passed), F.lit(False)))
    keys = [fold, *case]
    tried = scored.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_predicted"), item)))
    one = F.struct(F.col(item).alias("item"), F.col("_predicted").alias("predicted"), F.col(utility).alias("utility"), F.col("_place").alias("place"), F.col("_ok").alias("ok"))
    found = tried.groupBy(*keys).agg(
        F.min_by(one, "_place").alias("_f"), F.min_by(one, F.when(F.col("_ok"), F.col("_place"))).alias("_s"), F.min_by(one, F.when(F.col("_ok"), F.struct(-F.col(utility), F.col(item)))).alias("_o"), F.count("*").alias("_n")
    )
    return found.select(
        *keys, F.col("_f.item").alias("first"), F.col("_f.ok").alias("first_passed"), F.col("_s.item").alias("selected"), F.col("_s.predicted").alias("predicted"), F.col("_s.utility").alias("selected_utility"),
        F.coalesce(F.col("_s.place"), F.col("_n")).cast("long").alias("evaluated"), F.col("_o.item").alias("oracle"), F.col("_o.utility").alias("oracle_utility"), (F.col("_o.utility") - F.col("_s.utility")).alias("regret"), (F.col("_s.item") == F.col("_o.item")).alias("exact"),
    )


def predict(coefficients: str, features: Sequence[str]):
    """The prediction of a linear model whose coefficients are in a column."""
    out = F.element_at(coefficients, 1)
    for i, f in enumerate(features):
        out = out + F.element_at(coefficients, i + 2) * F.col(f)
    return out


def weighted_line(rows: DataFrame, keys: Sequence[str], x: str, y: str, weight: str) -> DataFrame:
    """Slope and intercept of a weighted least-squares line per group, null where all x are one."""
    w, a, b = F.col(weight), F.col(x), F.col(y)
    s = rows.groupBy(*keys).agg(
        F.sum(w).alias("_w"), F.sum(w * a).alias("_x"), F.sum(w * b).alias("_y"), F.sum(w * a * a).alias("_xx"), F.sum(w * a * b).alias("_xy")
    )
    det = F.col("_w") * F.col("_xx") - F.col("_x") * F.col("_x")
    slope = F.when(F.abs(det) > 1e-12, (F.col("_w") * F.col("_xy") - F.col("_x") * F.col("_y")) / det)
    return s.withColumn("slope", slope).withColumn("intercept", (F.col("_y") - F.col("slope") * F.col("_x")) / F.col("_w")).select(*keys, "slope", "intercept")
