"""Quality classifier: rules from tree paths, weighted by a lasso logistic fit, as Spark column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.common import chosen_by_hash, table, words
from varloom.llm.quality_rules import measures

#: Labelled rows that the ensemble is fitted on, at most about.
LABELLED_ROWS = 6000
TREES, DEPTH, CUTS = 40, 3, 24

STATISTICS = ("n_words", "word_length", "symbols", "capitals", "repeated_lines", "repeated_words", "different_words", "digits", "exclaims", "line_words", "bars")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the statistics as __s_<name> doubles. Null, empty and blank texts: all are 0."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = measures(docs, text, "__m_")
    m = lambda c: F.col(f"__m_{c}").cast("double")
    n = F.greatest(m("n_words"), F.lit(1.0))
    chars = F.greatest(m("word_chars"), F.lit(1.0))
    count = lambda c: (F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("double")
    values = {
        "n_words": m("n_words"),
        "word_length": m("word_chars") / n,
        "symbols": m("n_symbols") / n,
        "capitals": m("n_upper") / chars,
        "repeated_lines": m("n_dup_lines") / F.greatest(m("n_lines"), F.lit(1.0)),
        "repeated_words": m("n_repeat_words") / n,
        "different_words": F.size(F.array_distinct(words(t))) / n,
        "digits": F.length(F.regexp_replace(t, "[^0-9]+", "")) / chars,
        "exclaims": count("!") / n,
        "line_words": m("n_words") / F.greatest(m("n_lines"), F.lit(1.0)),
        "bars": count("|") / n,
    }
    df = df.withColumns({f"__s_{k}": v.cast("double") for k, v in values.items()})
    return df.drop(*[c for c in df.columns if c.startswith("__m_")])


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, cut), all to hold


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for k, above, cut in rule:
        out &= (x[:, k] > cut) if above else (x[:, k] <= cut)
    return out


def grow(x: np.ndarray, g: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], depth: int, path: Rule, out: list[tuple[Rule, float]], fit: np.ndarray) -> None:
    """A regression tree on the gradient; every node's path but the root's is a rule."""
    if path:
        out.append((path, float(g[rows].mean())))
    best = None
    if depth and len(rows) >= 20:
        total, n = g[rows].sum(), len(rows)
        for k in range(x.shape[1]):
            v = x[rows, k]
            for c in cuts[k]:
                low = v <= c
                a = int(low.sum())
                if 8 <= a <= n - 8:
                    s = g[rows][low].sum()
                    gain = s * s / a + (total - s) ** 2 / (n - a) - total * total / n
                    if best is None or gain > best[0] + 1e-12:
                        best = (gain, k, float(c), low)
    if best is None or best[0] <= 1e-9:
        fit[rows] = g[rows].mean()
        return
    _, k, c, low = best
    grow(x, g, rows[low], cuts, depth - 1, (*path, (k, False, c)), out, fit)
    grow(x, g, rows[~low], cuts, depth - 1, (*path, (k, True, c)), out, fit)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """Paths of gradient-boosted trees, each grown on half of the rows."""
    rng = np.random.default_rng(11)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, CUTS))) for k in range(x.shape[1])]
    f, found = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    for _ in range(trees):
        g = y - 1 / (1 + np.exp(-f))
        rows, out, fit = rng.permutation(len(y))[: max(len(y) // 2, 1)], [], np.zeros(len(y))
        grow(x, g, rows, cuts, depth, (), out, fit)
        leaves = {}
        for path, value in out:
            found.setdefault(path, None)
            leaves[path] = value
        inner = {p[:-1] for p in leaves}
        for path, value in leaves.items():
            if path not in inner:
                f += 1.5 * value * holds(x, path)
    return list(found)


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic fit by accelerated proximal gradient."""
    n, w, b = len(y), np.zeros(a.shape[1]), 0.0
    size = 0.25 * (np.linalg.norm(a, 2) ** 2 / n + 1)
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(a @ v + c))) - y
        nw = v - a.T @ r / n / size
        nw = np.sign(nw) * np.maximum(np.abs(nw) - penalty / size, 0)
        nb = c - r.mean() / size
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit(x: np.ndarray, y: np.ndarray) -> tuple[list[tuple[Rule, float]], float]:
    """Rules with weights, and the intercept; the penalty is the one of least loss on a fifth held back."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return [], float(np.log(share / (1 - share)))
    rules = tree_rules(x, y)
    a = np.stack([holds(x, r) for r in rules], axis=1).astype(np.float64) if rules else np.zeros((len(y), 0))
    # rules that hold on the same rows are one
    _, first = np.unique(a, axis=1, return_index=True)
    a, rules = a[:, np.sort(first)], [rules[k] for k in np.sort(first)]
    back = np.arange(len(y)) % 5 == 0
    loss = {}
    for penalty in (0.0005, 0.001, 0.002, 0.005):
        w, b = lasso(a[~back], y[~back], penalty)
        p = np.clip(1 / (1 + np.exp(-(a[back] @ w + b))), 1e-6, 1 - 1e-6)
        loss[penalty] = -np.mean(y[back] * np.log(p) + (1 - y[back]) * np.log(1 - p))
    w, b = lasso(a, y, min(loss, key=loss.get))
    return [(r, float(x)) for r, x in zip(rules, w) if abs(x) > 1e-4], float(b)


def compiled(rules: list[tuple[Rule, float]], intercept: float) -> Column:
    """The score as one column expression over the statistics."""
    z = F.lit(intercept)
    for rule, weight in rules:
        cond = F.lit(True)
        for k, above, cut in rule:
            c = F.col(f"__s_{STATISTICS[k]}")
            cond = cond & ((c > cut) if above else (c <= cut))
        z = z + F.when(cond, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", rows: int = LABELLED_ROWS) -> tuple[list[tuple[Rule, float]], float]:
    """Fits on at most about `rows` labelled documents, chosen by a hash of their id.

    An id with several labels has the least of them; null labels and ids don't count, and
    every document of a repeated id is a row of its own. Without labelled rows, or with one
    label only, there are no rules and the score is a constant.
    """
    own = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(F.col(label).cast("double")).alias("__y"))
    # broadcast of a bounded number of ids
    chosen = F.broadcast(chosen_by_hash(own, "__key", rows))
    pairs = docs.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").alias("__t")).join(chosen, F.col("__id") == F.col("__key"))
    got = [tuple(r) for r in statistics(pairs, "__t").select("__id", "__y", *[f"__s_{s}" for s in STATISTICS]).collect()]
    got.sort()
    return fit(np.array([r[2:] for r in got], dtype=np.float64).reshape(len(got), len(STATISTICS)), np.array([r[1] for r in got], dtype=np.float64))


def classified(docs: DataFrame, rules: list[tuple[Rule, float]], intercept: float, text: str = "text", at: float = 0.3) -> DataFrame:
    """docs with score (0 to 1) and predicted (score of at least `at`). Every text has a score, empty ones too."""
    df = statistics(docs, text)
    df = df.withColumn("score", compiled(rules, intercept))
    return df.withColumn("predicted", F.when(F.col("score") >= at, 1).otherwise(0)).drop(*[f"__s_{s}" for s in STATISTICS])


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % 5 == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules, intercept = learn(docs, table(spark, sf_dir, "labels").filter(~held("doc_id")))
    return classified(docs, rules, intercept).select("doc_id", held("doc_id").alias("held_out"), "score", "predicted")
