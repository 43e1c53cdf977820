"""Mixing sources to target weights by soft domain membership and projected-gradient least squares.

A softmax regression on hashed words, fitted on a labelled table, gives every document a
posterior over the domains. Nonnegative rates then minimise the weighted squared gaps
between the expected tokens of each domain and its target.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.common import LOWER, UPPER, chosen_by_hash, forget, table, words, written

#: Labelled rows that the classifier is fitted on, at most about; buckets that words are hashed to, and those it may weigh.
LABELLED_ROWS, BUCKETS, WEIGHED = 4000, 32768, 1000
#: A bucket is weighed if some domain's documents hold it more or less often than all do by so many standard errors.
CLEAR, SHRINK, STEPS = 4.0, 1e-3, 200
#: Gap that counts as met, as a share of all tokens, and full passes at most.
CLOSE, PASSES = 0.002, 60
#: Weights of the query; its budget is the input's tokens.
TARGETS = {"good": 0.86, "poor": 0.09, "toxic": 0.05}
#: Weights of the pipeline; the budget lets good documents rise a little, so that none of them falls under one copy.
PIPELINE_TARGETS, PIPELINE_RISE = {"good": 0.93, "poor": 0.04, "toxic": 0.03}, 1.1


def hashed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds __n, the words and one end, and __h, the distinct buckets of the lower-case words. Null text: as empty."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    df = docs.withColumn("__h", F.transform(words(low), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))
    return df.withColumn("__n", (F.size("__h") + 1).cast("long")).withColumn("__h", F.array_distinct("__h"))


def literal(values) -> Column:
    """A constant array; the optimiser folds it once."""
    return F.split(F.lit(",".join(f"{v:.12g}" for v in values)), ",").cast("array<double>")


def posteriors(weights: np.ndarray, bias: np.ndarray) -> Column:
    """Array of the domains' posteriors, summing to 1, from the buckets of a text. weights: a row of BUCKETS per domain."""
    scores = [F.lit(float(bias[0]))]
    for w, b in zip(weights[1:] - weights[0], bias[1:] - bias[0]):
        law = literal(w)
        scores.append(F.aggregate("__h", F.lit(float(b + bias[0])), lambda s, k: s + F.get(law, k)))  # noqa: B023
    up = F.transform(F.array(F.array(*scores)), lambda v: F.transform(v, lambda x: F.exp(x - F.array_max(v))))
    return F.flatten(F.transform(up, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))))


def softmax_fit(x: np.ndarray, y: np.ndarray, domains: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of a ridge softmax regression by accelerated gradient from the domains' shares."""
    n = np.bincount(y, minlength=domains)
    w, b = np.zeros((x.shape[1], domains)), np.log((n + 0.5) / (len(y) + 0.5 * domains))
    size = 1 / (0.5 * (np.linalg.norm(x, 2) ** 2 / len(y) + 1) + SHRINK)
    v, c, t, want = w, b, 1.0, np.eye(domains)[y]
    for _ in range(STEPS):
        z = x @ v + c
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - want) / len(y)
        nw, nb, nt = v - size * (x.T @ g + SHRINK * v), c - size * g.sum(axis=0), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit_domains(labelled: DataFrame, label: str, text: str = "text") -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """(domains, weights, bias) from a bounded labelled table; None where it is empty.

    What reaches the driver is bounded: a count per domain and bucket, and the weighed buckets of
    the labelled rows.
    """
    rows = hashed(labelled.filter(F.col(label).isNotNull()).select(F.col(text).alias("__t"), F.col(label).cast("string").alias("__d")), "__t")
    rows = written(rows.drop("__t"), "labelled")
    sizes = {r["__d"]: r["n"] for r in rows.groupBy("__d").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        forget(rows)
        return None
    names = sorted(sizes)
    count = np.zeros((len(names), BUCKETS))
    for r in rows.select("__d", F.explode("__h").alias("b")).groupBy("__d", "b").agg(F.count("*").alias("n")).collect():
        count[names.index(r["__d"]), r["b"]] = r["n"]
    n = np.array([sizes[d] for d in names], dtype=np.float64)
    due = n[:, None] * count.sum(axis=0) / n.sum()
    clear = (np.abs(count - due) / np.sqrt(due + 1)).max(axis=0)
    weighed = np.sort(np.lexsort((np.arange(BUCKETS), -clear))[:WEIGHED])
    weighed = weighed[clear[weighed] >= CLEAR]
    place = np.full(BUCKETS, -1)
    place[weighed] = np.arange(len(weighed))
    held = rows.select("__d", F.filter("__h", lambda b: F.get(literal(place), b) >= 0).alias("b")).collect()
    forget(rows)
    x, y = np.zeros((len(held), len(weighed))), np.array([names.index(r["__d"]) for r in held])
    for i, r in enumerate(held):
        x[i, place[r["b"]]] = 1.0
    w, bias = softmax_fit(x, y, len(names))
    weights = np.zeros((len(names), BUCKETS))
    weights[:, weighed] = w.T
    return names, weights, bias


def fit_rates(rows: DataFrame, domains: list[str], weights: dict[str, float], min_rate: float = 0.0, tokens: float | None = None, passes: int = PASSES, close: float = CLOSE, keep_every: int = 10) -> tuple[DataFrame, dict[str, float], dict[str, float], bool]:
    """(rows with rate, tokens reached, targets, met) for rows with __n tokens and __p posteriors.

    Rates r >= min_rate minimise the sum over domains of (T - t)^2 / T1, where T is the
    domain's expected tokens (sum of r * __n * p), t its target and T1 its tokens at rate 1.
    In the inner product that weighs a document by its tokens the gradient of a document is
    the sum of p * (T - t) / T1, and its Lipschitz bound is 1, as the matrix behind it is
    stochastic; so a step of 1 descends, and momentum speeds it up. A pass is one aggregate over
    the table. The rates are written after every few passes, so a plan holds few gradients.

    tokens: the budget, by default the input's tokens. Domains without weight have target 0.
    met says whether every gap is at most `close` of the budget; least squares may leave
    gaps where the lowest rate or mixed documents keep targets out of reach.
    """
    p = [F.get("__p", F.lit(j)) for j in range(len(domains))]
    low = F.lit(float(min_rate))

    def totals(df: DataFrame) -> np.ndarray:
        got = df.agg(*[F.sum(F.col("rate") * F.col("__n") * x).alias(f"t{j}") for j, x in enumerate(p)]).first()
        return np.array([float(x or 0.0) for x in got])

    share = np.array([max(weights.get(d, 0.0), 0.0) for d in domains])
    base = totals(rows.withColumn("rate", F.lit(1.0)))
    df = rows.withColumns({"rate": F.greatest(F.lit(1.0), low), "__last": F.greatest(F.lit(1.0), low)})
    last = reached = totals(df)
    budget = float(base.sum()) if tokens is None else tokens
    goal = budget * share / (share.sum() or 1.0)
    some = base > 0
    gap = lambda t: np.where(some, (t - goal) / np.where(some, base, 1.0), 0.0)
    height = lambda t: float((gap(t) * (t - goal)).sum())
    met = lambda: bool((np.abs(reached - goal) <= close * budget).all())
    held, pace = None, 1.0
    for k in range(passes):
        if met():
            break
        # momentum: a step is taken from ahead of the last rates, and pace starts anew when the gaps grow
        following = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        push = (pace - 1) / following
        ahead = F.col("rate") + F.lit(push) * (F.col("rate") - F.col("__last"))
        step = sum((x * F.lit(float(g)) for x, g in zip(p, gap(reached + push * (reached - last)))), F.lit(0.0))
        df = df.withColumn("__new", F.greatest(low, ahead - step)).withColumn("__last", F.col("rate")).withColumn("rate", F.col("__new")).drop("__new")
        if k % keep_every == keep_every - 1:
            old, held = held, written(df, f"rates-{k}")
            df = held
            if old is not None:
                forget(old)
        last, reached = reached, totals(df)
        pace = 1.0 if height(reached) > height(last) else following
    tell = lambda t: dict(zip(domains, map(float, t)))
    return df.drop("__last"), tell(reached), tell(goal), met()


def mixed(docs: DataFrame, labelled: DataFrame, label: str, weights: dict[str, float], text: str = "text", key: str = "doc_id", min_rate: float = 0.0, tokens: float | None = None, rise: tuple[str, float] | None = None) -> DataFrame:
    """(key, text_hash, n_tokens, posteriors, rate, copies, reached, targets, met) of every row of docs.

    labelled is a bounded table of texts with their domain. posteriors, reached and targets are
    arrays of (domain, value) in the order of the names. copies is floor(rate) plus one with
    the rate's fraction as probability, decided by a hash of the id, so a rerun decides alike.
    rise: (domain, factor) sets the budget so that this domain's target is so many times its
    expected tokens in docs.

    Null and empty texts have one token (the end) and the posteriors that the priors give;
    repeated rows are decided alike; a null id is decided by its own hash. Without labelled
    rows there are no domains: posteriors, reached and targets are empty, every rate is 1 and
    met is true. An empty table gives no rows. Only key and text of docs are read, so other
    columns can't clash.
    """
    rows = hashed(docs.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").alias("__t"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("__th")), "__t").drop("__t")
    model = fit_domains(labelled, label, text)
    named = lambda names, values: F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("domain"), values.alias("value"))
    if model is None:
        none = F.array().cast("array<struct<domain:string,value:double>>")
        rows = rows.select("__id", "__th", "__n", none.alias("posteriors"), F.lit(1.0).alias("rate"))
        reached = targets = none
        met = True
    else:
        names, w, bias = model
        rows = rows.select("__id", "__th", "__n", posteriors(w, bias).alias("__p"))
        rows = written(rows, "posteriors")
        if rise is not None:
            whole = sum(weights.values())
            own = rows.agg(F.sum(F.col("__n") * F.get("__p", F.lit(names.index(rise[0])))).alias("t")).first()["t"] if rise[0] in names else None
            tokens = rise[1] * own * whole / weights[rise[0]] if own else tokens
        rows, got, goal, met = fit_rates(rows, names, weights, min_rate, tokens)
        rows = rows.select("__id", "__th", "__n", named(names, F.col("__p")).alias("posteriors"), "rate")
        reached, targets = (named(names, literal([x[n] for n in names])) for x in (got, goal))
    chance = F.shiftrightunsigned(F.xxhash64("__id", F.lit(5)), 11) / F.lit(float(1 << 53))
    copies = (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return rows.select(F.col("__id").alias(key), F.col("__th").alias("text_hash"), F.col("__n").alias("n_tokens"), "posteriors", "rate", copies.alias("copies"), reached.alias("reached"), targets.alias("targets"), F.lit(met).alias("met"))


def remix(docs: DataFrame, labelled: DataFrame, label: str, weights: dict[str, float], text: str = "text", key: str = "doc_id", min_rate: float = 0.0, rise: tuple[str, float] | None = None) -> DataFrame:
    """docs, every row as often as its copies say, with their own columns only."""
    rows = mixed(docs, labelled, label, weights, text, key, min_rate, rise=rise)
    # rows with equal id and text are decided alike
    chosen = rows.select(F.col(key).alias("__mix_id"), F.col("text_hash").alias("__mix_hash"), "copies").groupBy("__mix_id", "__mix_hash").agg(F.max("copies").alias("__mix_copies")).filter("__mix_copies > 0")
    df = docs.withColumn("__mix_text", F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    df = df.join(chosen, F.col(f"`{key}`").eqNullSafe(F.col("__mix_id")) & (F.col("__mix_text") == F.col("__mix_hash")))
    return df.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*[f"`{c}`" for c in docs.columns])


def labelled_texts(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """(text, domain) of at most about `rows` labelled documents, chosen by a hash of their id.

    toxic where any label of the id says so, else poor where any says quality 0, else good; rows
    without an id or a label don't count.
    """
    kind = F.when(F.max("toxic") == 1, "toxic").when(F.min("quality") == 0, "poor").when(F.min("quality") == 1, "good")
    own = labels.filter("doc_id is not null").groupBy("doc_id").agg(kind.alias("domain")).filter("domain is not null")
    chosen = chosen_by_hash(own, "doc_id", rows).withColumnRenamed("doc_id", "__id")
    # broadcast of a bounded number of ids
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("text", "domain")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return mixed(docs, labelled_texts(docs, labels), "domain", TARGETS).drop("text_hash")
