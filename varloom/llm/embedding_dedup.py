"""Embedding near-dedup by an epsilon grid order join on leading principal dimensions."""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.common import components, slots, table, written

#: Leading principal dimensions whose grid cells order the vectors, and all that bound a block.
ORDER_DIMS, BOX_DIMS = 4, 12
#: Dimensions up to which principal directions are computed.
WIDEST = 1024
#: Vectors of a block, of an interval that is compared at once, and blocks under one node of the interval tree.
BLOCK, PART, FAN = 2048, 256, 16
#: Neighbouring blocks that one task meets with a block, at most.
CHUNK = 16


def usable(vectors: DataFrame, vector: str, key: str) -> DataFrame:
    """(id, v, dim) of the vectors that can link: not null, not zero, without null or non-finite components."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def unit(flat: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def padded(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, x in enumerate(column):
        x = x.values.to_numpy(zero_copy_only=False)
        out[i, : len(x)] = x
    return out


def principal(rows: DataFrame, width: int) -> np.ndarray:
    """Leading principal directions of the unit vectors; each task sends one matrix of sums, whatever the rows.

    Beyond WIDEST dimensions random directions take their place: they prune less, and are as right.
    """
    if width > WIDEST:
        return np.linalg.qr(np.random.default_rng(5).normal(size=(width, BOX_DIMS)))[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros((width + 1, width))
        n = 0
        for batch in batches:
            u = unit(padded(batch.column(0), width))
            s[:width] += u.T @ u
            s[width] += u.sum(axis=0)
            n += len(u)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.ravel().tolist()], pa.list_(pa.float64()))], ["n", "s"])

    sums = rows.select("v").mapInArrow(work, "n long, s array<double>").select("n", F.posexplode("s").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    n = sums[0]["n"] if sums else 0
    s = np.zeros((width + 1) * width)
    for r in sums:
        s[r["k"]] = r["x"]
    s = s.reshape(width + 1, width)
    mean = s[width] / max(n, 1)
    _, axes = np.linalg.eigh(s[:width] / max(n, 1) - np.outer(mean, mean))
    return np.ascontiguousarray(axes[:, ::-1][:, : min(BOX_DIMS, width)])


def placed(rows: DataFrame, axes: np.ndarray, width: int, eps: float) -> DataFrame:
    """Adds the projections y and the grid cell of each vector."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = unit(padded(batch.column(2), width)) @ axes
            cell = np.floor(y[:, :ORDER_DIMS] / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(y.tolist(), pa.list_(pa.float64())), pa.array(cell.tolist(), pa.list_(pa.int32()))], ["id", "weight", "v", "dim", "y", "cell"])

    return rows.select("id", "weight", "v", "dim").mapInArrow(work, "id long, weight long, v array<double>, dim int, y array<double>, cell array<int>")


def in_blocks(rows: DataFrame, vectors: int) -> DataFrame:
    """Adds the block of each vector: its rank in epsilon grid order by BLOCK. Ranks come from the counts of sorted ranges."""
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(max(1, min(slots(spark), -(-vectors // BLOCK))), "dim", "cell", "id").sortWithinPartitions("dim", "cell", "y", "id")
    ordered = written(ordered.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ordered")
    counts, first, shift = sorted((r["part"], r["n"]) for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()), 0, {}
    for part, n in counts:
        shift[part], first = first, first + n
    # one number per range partition
    starts = spark.createDataFrame(list(shift.items()) or [(0, 0)], "part int, start long")
    return ordered.join(F.broadcast(starts), "part").withColumn("block", F.floor((F.col("start") + F.col("at")) / BLOCK).cast("long"))


def box_gap(a: str, b: str):
    """Squared distance of two boxes (lo, hi); that of their vectors is no less."""
    gap = F.zip_with(f"{a}.lo", f"{b}.hi", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    pag = F.zip_with(f"{b}.lo", f"{a}.hi", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    return F.aggregate(F.zip_with(gap, pag, lambda x, y: F.greatest(x, y)), F.lit(0.0), lambda s, x: s + x * x)


def near_blocks(rows: DataFrame, dims: int, eps: float) -> DataFrame:
    """Pairs (a, b), a <= b, of blocks that may hold linked vectors, by descending a tree of intervals of the order."""
    lo = [F.min(F.get("y", F.lit(k))) for k in range(dims)]
    hi = [F.max(F.get("y", F.lit(k))) for k in range(dims)]
    levels = [written(rows.groupBy("block").agg(F.array(*lo).alias("lo"), F.array(*hi).alias("hi")).withColumnRenamed("block", "node"), "boxes")]
    top = levels[0].agg(F.max("node").alias("n")).first()["n"] or 0
    while top >= FAN:
        top //= FAN
        up = levels[-1].withColumn("node", F.floor(F.col("node") / FAN).cast("long")).groupBy("node")
        levels.append(up.agg(F.array(*[F.min(F.get("lo", F.lit(k))) for k in range(dims)]).alias("lo"), F.array(*[F.max(F.get("hi", F.lit(k))) for k in range(dims)]).alias("hi")))
    pairs = None
    for level in reversed(levels):
        x, y = (level.select(F.floor(F.col("node") / FAN).cast("long").alias(p), F.struct("node", "lo", "hi").alias(n)) for p, n in (("a", "x"), ("b", "y")))
        if pairs is None:
            pairs = x.join(y, x["a"] == y["b"])
        else:
            pairs = pairs.join(x, "a").join(y, "b")
        pairs = pairs.filter((F.col("x.node") <= F.col("y.node")) & (box_gap("x", "y") <= eps * eps)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    return pairs


def compare(x: dict, y: dict | None, cosine: float, eps: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(links of x's vectors, of y's, links that join what all links join) between two blocks, or inside x.

    The sequences are halved while longer than PART; two intervals whose boxes lie farther apart
    than eps are skipped.
    """
    inside = y is None
    y = x if inside else y
    nx, ny = np.zeros(len(x["id"]), np.int64), np.zeros(len(y["id"]), np.int64)
    root: dict[int, int] = {}
    out: list[tuple[int, int]] = []

    def top(i: int) -> int:
        while root.setdefault(i, i) != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def meet(a: int, b: int, c: int, d: int) -> None:
        if inside and d <= a:
            return
        p, q = x["y"][a:b], y["y"][c:d]
        gap = np.maximum(np.maximum(p.min(axis=0) - q.max(axis=0), q.min(axis=0) - p.max(axis=0)), 0)
        if (gap * gap).sum() > eps * eps or (x["dim"][a:b].max() < y["dim"][c:d].min()) or (y["dim"][c:d].max() < x["dim"][a:b].min()):
            return
        if b - a > PART or d - c > PART:
            if b - a >= d - c:
                m = (a + b) // 2
                meet(a, m, c, d)
                meet(m, b, c, d)
            else:
                m = (c + d) // 2
                meet(a, b, c, m)
                meet(a, b, m, d)
            return
        i, j = np.nonzero(x["f"][a:b] @ y["f"][c:d].T >= cosine - 1e-4)
        i, j = i + a, j + c
        if inside:
            i, j = i[i < j], j[i < j]
        if not len(i):
            return
        # single precision proposes, double precision decides
        fine = ((x["u"][i] * y["u"][j]).sum(axis=1) >= cosine) & (x["dim"][i] == y["dim"][j])
        i, j = i[fine], j[fine]
        np.add.at(nx, i, y["weight"][j])
        np.add.at(nx if inside else ny, j, x["weight"][i])
        for s, t in zip(x["id"][i].tolist(), y["id"][j].tolist()):
            s0, t0 = top(s), top(t)
            if s0 != t0:
                root[s0] = t0
                out.append((s, t))

    meet(0, len(x["id"]), 0, len(y["id"]))
    return nx, ny, out


def packed(rows: DataFrame, width: int) -> DataFrame:
    """A row per block with its vectors as arrays in grid order; a block has at most BLOCK of them."""

    def work(key, frame):
        frame = frame.take(pa.array(np.lexsort((frame.column("at").to_numpy(), frame.column("part").to_numpy()))))
        data = padded(frame.column("v").combine_chunks(), width)
        ids, weights, dims = (frame.column(c).to_numpy().astype(np.int64) for c in ("id", "weight", "dim"))
        return pa.table({"block": [key[0].as_py()], "ids": [ids.tobytes()], "weights": [weights.tobytes()], "dims": [dims.tobytes()], "vs": [data.tobytes()]})

    return rows.select("block", "part", "at", "id", "weight", "dim", "v").groupBy("block").applyInArrow(work, "block long, ids binary, weights binary, dims binary, vs binary")


def links(rows: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """((id, n) of vectors with links, (a, b) links that join) among distinct vectors (id, weight, v, dim) of one dimension.

    A block travels once per chunk of the blocks that it meets, and once per pair on the other side.
    """
    eps = sqrt(2 - 2 * cosine) + 1e-6
    width, n = rows.agg(F.max("dim").alias("d"), F.count("*").alias("n")).first()
    width = width or 1
    axes = principal(rows, width)
    dealt = in_blocks(placed(rows, axes, width, eps), n)
    blocks = written(packed(dealt, width), "blocks")
    pairs = near_blocks(dealt, axes.shape[1], eps).withColumn("chunk", F.floor(F.col("b") / CHUNK))

    def load(row) -> dict:
        ids, weights, d, vs = (x.as_py() for x in row)
        out = {"id": np.frombuffer(ids, np.int64), "weight": np.frombuffer(weights, np.int64), "dim": np.frombuffer(d, np.int64)}
        out["u"] = unit(np.frombuffer(vs).reshape(-1, width))
        out["f"], out["y"] = out["u"].astype(np.float32), out["u"] @ axes
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: dict = {}
        for batch in batches:
            for a, b, *row in zip(*batch.columns):
                a, b = a.as_py(), b.as_py()
                if b < 0:  # the chunk's own block comes first
                    x = load(row)
                    continue
                y = None if a == b else load(row)
                nx, ny, joined = compare(x, y, cosine, eps)
                got = [(i, c, None, None) for i, c in zip(x["id"].tolist(), nx.tolist()) if c]
                if y is not None:
                    got += [(i, c, None, None) for i, c in zip(y["id"].tolist(), ny.tolist()) if c]
                got += [(None, None, s, t) for s, t in joined]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in got], pa.int64()) for k in range(4)], ["id", "n", "a", "b"])

    fields = ("ids", "weights", "dims", "vs")
    own = pairs.select("a", "chunk").distinct().join(blocks, F.col("a") == F.col("block")).select("a", F.lit(-1).cast("long").alias("b"), *fields, "chunk")
    met = pairs.join(blocks, F.col("b") == F.col("block")).select("a", "b", *fields, "chunk")
    rows = own.unionAll(met).repartition("a", "chunk").sortWithinPartitions("a", "chunk", "b").drop("chunk")
    out = written(rows.mapInArrow(work, "id long, n long, a long, b long"), "vector-links")
    return out.filter("id is not null").groupBy("id").agg(F.sum("n").alias("n")), out.filter("a is not null").select("a", "b")


def near_vectors(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", cosine: float = 0.95) -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    Equal vectors are compared once, with their number as weight, so copies make no pairs.
    Vectors that are null, zero or hold null or non-finite components have no links, and
    vectors of unequal length none with each other. Repeated ids are rows of their own that
    count as links of each other if their vectors link; a null id has a null component.
    """
    fine = usable(vectors, vector, key)
    classes = written(fine.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("dim").alias("dim")), "vectors")
    classes_ = classes.withColumn("node", F.xxhash64("v"))
    # ids may repeat or be null, so nodes are hashes of the vectors themselves
    rows = classes_.select(F.col("node").alias("id"), "weight", "v", "dim")
    # only vectors of one dimension link, and a dimension with one vector has no links
    dims = [r["dim"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).filter("n > 1").collect()]
    parts = [links(rows.filter(F.col("dim") == d), cosine) for d in sorted(dims)]
    none = rows.filter("false")
    counts, joined = none.select("id", F.col("weight").alias("n")), none.select(F.col("id").alias("a"), F.col("id").alias("b"))
    for n, j in parts:
        counts, joined = counts.unionAll(n), joined.unionAll(j)
    named = components(joined, name="vector-components")
    tops = classes_.join(named, "node", "left").withColumn("root", F.coalesce("component", "node"))
    least = tops.groupBy("root").agg(F.min("id").alias("component_id"))
    per = tops.join(least, "root").join(counts.withColumnRenamed("id", "node"), "node", "left").select(F.col("v").alias("cv"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    linked = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).join(per, F.col("v") == F.col("cv"), "left")
    root = F.coalesce("component_id", F.col("id").cast("long"))
    return linked.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(root == F.col("id"), F.lit(True)).alias("kept"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
