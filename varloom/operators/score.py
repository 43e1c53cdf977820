"""Mixture-of-experts scoring over feature domains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions.values import known, number


#: Error of approximate ranks, and the number of values among which a median is read off.
ACCURACY, FEW = 10_000, 10_000


def medians(df: DataFrame, columns: list[str], few: int = FEW) -> dict[str, float | None]:
    """column -> exact median of its numbers: the value at half of the ranks, the lower of two; null without numbers.

    Brackets around the median are narrowed for all columns at once: approximate quantiles just
    under and over it are taken as its edges, the values below, on and between them counted
    exactly, until few values are left. A pass leaves about a thousandth of them, so three
    or four pairs of passes do for any table, however its values are spread.
    """
    x = {c: number(F.col(f"`{c}`")) for c in columns}
    first = df.agg(*[F.count(v).alias(f"n{i}") for i, v in enumerate(x.values())]).first()
    n = {c: first[f"n{i}"] for i, c in enumerate(columns)}
    out: dict[str, float | None] = {c: None for c in columns if not n[c]}
    # values strictly between the two edges, how many they are, and how many lie at or under the lower edge
    open_ = {c: (-float("inf"), float("inf"), n[c], 0) for c in columns if n[c]}
    inside = lambda c: F.when((x[c] > open_[c][0]) & (x[c] < open_[c][1]), x[c])
    spread = dict.fromkeys(columns, 3 / ACCURACY)
    while large := [c for c in open_ if open_[c][2] > few]:
        want = {c: ((n[c] + 1) // 2 - open_[c][3] - 0.5) / open_[c][2] for c in large}
        got = df.agg(*[F.percentile_approx(inside(c), [max(0.0, want[c] - spread[c]), min(1.0, want[c] + spread[c])], ACCURACY).alias(f"q{i}") for i, c in enumerate(large)]).first()
        edges = {c: got[f"q{i}"] for i, c in enumerate(large)}
        counts = df.agg(*[f.alias(f"{k}{i}") for i, c in enumerate(large) for k, f in zip("abcd", (F.count(F.when(inside(c) < edges[c][0], 1)), F.count(F.when(inside(c) == edges[c][0], 1)), F.count(F.when((inside(c) > edges[c][0]) & (inside(c) < edges[c][1]), 1)), F.count(F.when(inside(c) == edges[c][1], 1))))]).first()
        for i, c in enumerate(large):
            lo, hi, _, under = open_[c]
            rank, (a, b) = (n[c] + 1) // 2 - under, edges[c]
            below, on, between, upper = (counts[f"{k}{i}"] for k in "abcd")
            if a == b:
                upper = 0
            if below < rank <= below + on:
                out[c] = a
            elif below + on + between < rank <= below + on + between + upper:
                out[c] = b
            elif rank <= below:
                open_[c], spread[c] = (lo, a, below, under), 2 * spread[c]
            elif rank <= below + on + between:
                open_[c] = (a, b, between, under + below + on)
            else:
                past = below + on + between + upper
                open_[c], spread[c] = (b, hi, open_[c][2] - past, under + past), 2 * spread[c]
        for c in large:
            if c in out:
                del open_[c]
    if open_:
        last = df.agg(*[F.element_at(F.sort_array(F.collect_list(inside(c))), (n[c] + 1) // 2 - open_[c][3]).alias(f"m{i}") for i, c in enumerate(open_)]).first()
        out |= {c: last[f"m{i}"] for i, c in enumerate(open_)}
    return {c: out[c] for c in columns}


def fit_standard(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """column -> (median, standard deviation) of its numbers; exact medians."""
    got = df.agg(*[F.stddev_pop(number(F.col(f"`{c}`"))).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    middle = medians(df, columns)
    return {c: (middle[c] or 0.0, got[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def standard(c: Column, median: float, deviation: float) -> Column:
    """Missing values become the median, then the median is 0 and a deviation 1."""
    return (F.coalesce(number(c), F.lit(float(median))) - F.lit(float(median))) / F.lit(float(deviation))


def one_hot(c: Column, categories: list[str]) -> list[Column]:
    """A 0 or 1 per category; an unknown category is all 0."""
    return [F.coalesce((c.cast("string") == x).cast("double"), F.lit(0.0)) for x in categories]


def features(df: DataFrame, numbers: list[str], fitted: dict[str, tuple[float, float]], categories: dict[str, list[str]] | None = None) -> Column:
    """Array of an expert's inputs: numbers imputed and standardised, then categories as 0 or 1. Columns that df lacks give none."""
    parts = [standard(F.col(c), *fitted[c]) for c in numbers if c in df.columns]
    for c, values in (categories or {}).items():
        parts += one_hot(F.col(c), values) if c in df.columns else []
    return F.array(*parts).cast("array<double>")


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


def normal(x: np.ndarray, w: dict | None) -> np.ndarray:
    if w is None:
        return x
    m, v = x.mean(axis=1, keepdims=True), x.var(axis=1, keepdims=True)
    return (x - m) / np.sqrt(v + 1e-5) * w["g"] + w["b"]


def forward(inputs: dict[str, np.ndarray], w: dict) -> tuple[np.ndarray, np.ndarray]:
    """(overall logit, logit per domain) of a batch. Layers are (matrix, bias) pairs applied as x @ matrix + bias."""
    parts, heads = [], []
    for name, x in inputs.items():
        d = w["domains"][name]
        for m, b in d["layers"]:
            x = relu(x @ m + b)
        heads.append(x @ d["head"][0] + d["head"][1])
        parts.append(normal(x, d.get("norm")))
    h = normal(np.concatenate(parts, axis=1), w.get("norm"))
    for m, b in w["fusion"]:
        h = relu(h @ m + b)
    return (h @ w["out"][0] + w["out"][1]).ravel(), np.concatenate([x.reshape(len(h), 1) for x in heads], axis=1)


def moe_scores(df: DataFrame, domains: dict[str, list[str]], weights: dict) -> DataFrame:
    """Adds overall_logit, overall_prob and score_<domain>.

    domains gives each expert's feature columns (doubles, or one array column). Batches go
    through Arrow to numpy; the weights travel in the task, as their size is fixed by the model.
    """
    names = list(domains)
    cols = [F.array(*[F.coalesce(known(F.col(c)), F.lit(0.0)) for c in v]) if dict(df.dtypes)[v[0]][:5] != "array" else F.col(v[0]).cast("array<double>") for v in domains.values()]

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch[0]):
                yield pd.Series([], dtype=object)
                continue
            logit, heads = forward({n: np.stack(s.to_list()) for n, s in zip(names, batch)}, weights)
            yield pd.Series(list(np.concatenate([logit[:, None], heads], axis=1)))

    out = df.withColumn("__y", run(*cols, F.lit(0)))  # two columns at least, so that batches are tuples
    out = out.withColumn("overall_logit", F.get("__y", F.lit(0))).withColumn("overall_prob", 1 / (1 + F.exp(-F.col("overall_logit"))))
    return out.withColumns({f"score_{n}": F.get("__y", F.lit(i + 1)) for i, n in enumerate(names)}).drop("__y")
