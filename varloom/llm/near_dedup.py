"""MinHash near-dedup with SetSketch registers: banded, estimated jointly by likelihood, verified on full sets."""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.common import components, forget, table, written
from varloom.llm.tokens import U, mix, slices

SHINGLE, REGISTERS = 5, 256
#: Registers are truncated logarithms of exponential minima, to base BASE from RATE.
BASE, RATE = 1.001, 20.0
#: Pairs whose most likely similarity lies under the threshold by this much are not verified (six standard errors).
SLACK = 0.13
#: Band-mates of one side of a comparison block; documents and shingles of one side of a block that is verified.
BLOCK_MATES, BLOCK_DOCS, BLOCK_SHINGLES = 1024, 256, 400_000
#: Standard errors by which the equal registers of band-mates may lie under what the threshold makes expect.
DOUBT = 6.0
_RNG = np.random.Generator(np.random.PCG64(7))
_ODD = _RNG.integers(0, 1 << 63, REGISTERS, dtype=U) * U(2) + U(1)
_PLACE = _RNG.integers(0, 1 << 63, SHINGLE, dtype=U) * U(2) + U(1)


def shingles(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles of all texts one after another, their number per text) from word hashes.

    A text with fewer words than a shingle has its whole sequence as one; one without words has none.
    """
    stop = np.cumsum(counts)
    if len(hashes) >= SHINGLE:
        n = len(hashes) - SHINGLE + 1
        full = _PLACE[0] * hashes[:n]
        for k in range(1, SHINGLE):
            full += _PLACE[k] * hashes[k : k + n]
        full = mix(full)
    else:
        full = np.zeros(0, dtype=U)
    sets, sizes = [], np.zeros(len(counts), dtype=np.int64)
    for i, (c, e) in enumerate(zip(counts.tolist(), stop.tolist())):
        if c >= SHINGLE:
            x = np.sort(full[e - c : e - SHINGLE + 1])
            x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif c:
            x = mix(np.add.reduce(_PLACE[:c] * hashes[e - c : e], keepdims=True, dtype=U) ^ U(c))
        else:
            continue
        sets.append(x)
        sizes[i] = len(x)
    return (np.concatenate(sets) if sets else np.zeros(0, dtype=U)), sizes


def sketches(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of registers per set (which must not be empty). The larger of two sets' registers is their union's."""
    starts = np.cumsum(sizes) - sizes
    least = np.empty((len(sizes), REGISTERS), dtype=U)
    for k in range(REGISTERS):
        least[:, k] = np.minimum.reduceat(sets * _ODD[k], starts)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64)
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300) / RATE) / log(BASE)), 0, 65535).astype(np.uint16)


def sketched(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(id, n, f1, f2, sketch): set size, a 128-bit fingerprint of the set and its registers."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, h, c in slices(batch.column(1)):
                sets, n = shingles(h, c)
                f1, f2 = np.zeros(b - a, dtype=U), np.zeros(b - a, dtype=U)
                some = np.flatnonzero(n)
                regs: list[bytes | None] = [None] * (b - a)
                if len(some):
                    at = np.cumsum(n[some]) - n[some]
                    f1[some] = np.add.reduceat(sets, at)
                    f2[some] = np.add.reduceat(mix(sets ^ _PLACE[0]), at)
                    for i, r in zip(some.tolist(), sketches(sets, n[some])):
                        regs[i] = r.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n, pa.int64()), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(regs, pa.binary())], ["id", "n", "f1", "f2", "sketch"])

    return rows.mapInArrow(work, "id long, n long, f1 long, f2 long, sketch binary")


def with_sets(docs: DataFrame, text: str) -> DataFrame:
    """docs with the text replaced by its packed set."""
    keep = [f for f in docs.schema if f.name != text]
    rows = docs.select(*[f.name for f in keep], text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, h, c in slices(batch.column(len(keep))):
                sets, n = shingles(h, c)
                stop = np.cumsum(n)
                own = [sets[e - k : e].tobytes() for k, e in zip(n.tolist(), stop.tolist())]
                yield pa.RecordBatch.from_arrays([*[batch.column(i)[a:b] for i in range(len(keep))], pa.array(own, pa.binary())], [*[f.name for f in keep], "set"])

    return rows.mapInArrow(work, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep) + ", set binary")


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of sketches (rows of a and of b) are most likely at least so similar, given the set sizes.

    The likelihood of similarity J for the numbers of greater, smaller and equal registers has
    one peak; it lies above `least` when the slope there is positive.
    """
    greater = np.array([(x > b).sum(axis=1) for x in a]).reshape(len(a), len(b))
    smaller = np.array([(x < b).sum(axis=1) for x in a]).reshape(len(a), len(b))
    equal = REGISTERS - greater - smaller
    u = na[:, None] / (na[:, None] + nb[None, :])
    v = 1 - u
    step = (BASE - 1) / BASE
    p = lambda x: -np.log1p(-x * step) / log(BASE)
    slope = lambda x: step / ((1 - x * step) * log(BASE))
    x, y = u - v * least, v - u * least
    fits = (x > 0) & (y > 0)
    x, y = np.where(fits, x, 0.1), np.where(fits, y, 0.1)
    rest = np.maximum(1 - p(x) - p(y), 1e-12)
    gain = -greater * v * slope(x) / p(x) - smaller * u * slope(y) / p(y) + equal * (v * slope(x) + u * slope(y)) / rest
    return fits & (gain > 0)


class Forest:
    """Union-find over the rows of a block, of which some are joined already."""

    def __init__(self, joined: list[int]):
        seen: dict[int, int] = {}
        self.root = [seen.setdefault(c, i) for i, c in enumerate(joined)]

    def top(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x


def mates(ids: np.ndarray, left: np.ndarray, right: np.ndarray, comp: np.ndarray, n: np.ndarray, low: list[bytes], _: None, percent: int) -> list[tuple[int, int]]:
    """Pairs of band-mates with as many equal registers as linked ones have, as few as join what all such pairs join."""
    regs = np.stack([np.frombuffer(x, np.uint8) for x in low])
    j = percent / 100
    least = REGISTERS * j - DOUBT * np.sqrt(REGISTERS * j * (1 - j))
    forest, out = Forest(comp.tolist()), []
    for i in left.tolist():
        others = right[(comp[right] != comp[i]) & (np.minimum(n[right], n[i]) * 100 >= percent * np.maximum(n[right], n[i]))]
        for k in others[(regs[others] == regs[i]).sum(axis=1) >= least].tolist():
            a, b = forest.top(i), forest.top(k)
            if a != b:
                forest.root[a] = b
                out.append((int(ids[i]), int(ids[k])))
    return out


def linked(ids: np.ndarray, left: np.ndarray, right: np.ndarray, comp: np.ndarray, n: np.ndarray, sketch: list[bytes], packed: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Links that join the documents of a block as all its links would; each is verified on the full sets."""
    regs = np.stack([np.frombuffer(x, np.uint16) for x in sketch])
    sets = [np.frombuffer(x, U) for x in packed]
    n = n.astype(np.float64)
    may = likely(regs[left], regs[right], n[left], n[right], percent / 100 - SLACK)
    may &= np.minimum(n[left][:, None], n[right][None, :]) * 100 >= percent * np.maximum(n[left][:, None], n[right][None, :])
    may &= comp[left][:, None] != comp[right][None, :]
    i, j = np.nonzero(may)
    i, j = left[i], right[j]
    if len(left) == len(right) and (left == right).all():
        i, j = i[i < j], j[i < j]
    same = np.concatenate([(regs[i[k : k + 100_000]] == regs[j[k : k + 100_000]]).sum(axis=1) for k in range(0, len(i), 100_000)] or [np.zeros(0)])
    forest, out = Forest(comp.tolist()), []
    for k in np.argsort(-same, kind="stable").tolist():
        a, b = int(i[k]), int(j[k])
        x, y = forest.top(a), forest.top(b)
        if x == y:
            continue
        s, t = (sets[a], sets[b]) if len(sets[a]) <= len(sets[b]) else (sets[b], sets[a])
        at = np.searchsorted(t, s)
        at[at == len(t)] = 0
        common = int((t[at] == s).sum())
        if 100 * common >= percent * (len(s) + len(t) - common):
            forest.root[x] = y
            out.append((int(ids[a]), int(ids[b])))
    return out


def block_links(rows: DataFrame, compare, percent: int) -> DataFrame:
    """(a, b) links of each block (g, p, q) of rows (id, chunk, comp, n, x, y); a task reads one block at a time, by its order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(block: list[tuple]) -> pa.RecordBatch:
            ids, chunk, comp, n = (np.array([x[k] for x in block], dtype=np.int64) for k in range(4))
            left, right = np.flatnonzero(chunk == now[1]), np.flatnonzero(chunk == now[2])
            got = compare(ids, left, right, comp, n, [x[4] for x in block], [x[5] for x in block], percent) if len(left) and len(right) else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)], ["a", "b"])

        now, block = None, []
        for batch in batches:
            heads = zip(*[batch.column(k).to_pylist() for k in range(7)])
            for (*at, i, chunk, comp, n), x, y in zip(heads, batch.column(7), batch.column(8)):
                if at != now:
                    if len(block) > 1:
                        yield close(block)
                    now, block = at, []
                block.append((i, chunk, comp, n, x.as_py(), y.as_py()))
        if len(block) > 1:
            yield close(block)

    return rows.select("g", "p", "q", "id", "chunk", "comp", "n", "x", "y").repartition("g", "p", "q").sortWithinPartitions("g", "p", "q").mapInArrow(work, "a long, b long")


def group_links(rows: DataFrame, compare, percent: int, most: int, weight: int | None, payload, name: str) -> DataFrame:
    """(a, b) links that join the members of each group as all links between them would.

    rows: (g, id, n). A group is cut into chunks of `most` members (and of `weight` shingles,
    if given). In a first round a chunk meets itself and the first chunk, so a group of copies,
    however large, is joined in time that grows with its size. Only groups that are still in
    parts then have their other chunks meet, and only members of different parts are compared.
    payload adds x and y, what members are compared by, to rows that have an id.
    """
    chunks = F.ceil(F.count("*") / most)
    size = rows.groupBy("g").agg((F.greatest(chunks, F.ceil(F.sum("n") / weight)) if weight else chunks).cast("int").alias("chunks"), F.count("*").alias("m")).filter("m > 1").drop("m")
    rows = rows.join(size, "g").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    rows = written(rows, f"{name}-groups")
    meet = lambda k: F.struct(F.least("chunk", k).alias("p"), F.greatest("chunk", k).alias("q"))
    to = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    first = F.when(F.col("chunk") == 0, F.transform(to(F.lit(0), F.col("chunks") - 1), meet)).otherwise(F.array(meet(F.lit(0)), meet(F.col("chunk"))))
    block = lambda df, pairs: payload(df.withColumn("b", F.explode(pairs)).select("g", "b.p", "b.q", "id", "chunk", "comp", "n"))
    links = written(block_links(block(rows.withColumn("comp", F.col("id")), first), compare, percent), f"{name}-1")
    large = rows.filter("chunks > 2")
    if large.isEmpty():
        forget(rows)
        return links
    parts = components(links, name=f"{name}-parts")
    large = large.join(parts, F.col("id") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "id")).drop("node", "component")
    open_ = large.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("g")
    others = F.transform(F.filter(to(F.lit(1), F.col("chunks") - 1), lambda k: k != F.col("chunk")), meet)
    rest = large.join(open_, "g", "left_semi").filter("chunk > 0")
    more = written(block_links(block(rest, others), compare, percent), f"{name}-2")
    forget(rows)
    return links.unionAll(more)


def band_width(similarity: float, missed: float = 1e-4) -> int:
    """Registers of a band: as many as leave a pair of that similarity without a common band with probability `missed` at most."""
    return next((w for w in range(8, 0, -1) if (1 - similarity**w) ** (REGISTERS // w) <= missed), 1)


def near_components(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 85) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row.

    Documents with one and the same set are a class and go on as its smallest id. Classes that
    share a band of registers are mates if their registers agree as those of linked ones do;
    classes that mates join, directly or through others, are a family. Families are compared
    inside in blocks of bounded size, and links are decided on the full sets. Null, empty and
    wordless texts have no set and link with nothing; repeated ids are one document; a null id
    stays alone with a null component.
    """
    all_rows = written(sketched(docs, text, key), "sketches")
    some = all_rows.filter("n > 0 and id is not null")
    classes = some.groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"))
    reps = some.join(classes, (some["id"] == F.col("rep")) & (some["f1"] == classes["f1"]) & (some["f2"] == classes["f2"]) & (some["n"] == classes["n"]), "left_semi").dropDuplicates(["id", "f1"])
    reps = written(reps, "reps")
    wide = band_width(percent / 100)
    bands = reps.select("id", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // wide - 1)), lambda i: F.xxhash64(F.substring(F.col("sketch"), i * (2 * wide) + 1, F.lit(2 * wide)), i))).alias("g"))
    shared = bands.groupBy("g").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("g")
    # the lower byte of each register tells equal ones nearly as well
    low = reps.select(F.col("id").alias("rid"), F.unhex(F.regexp_replace(F.hex("sketch"), "(..)..", "$1")).alias("x"))
    with_low = lambda df: df.join(low, F.col("id") == F.col("rid")).withColumn("y", F.lit(None).cast("binary"))
    joined = group_links(bands.join(shared, "g", "left_semi"), mates, percent, BLOCK_MATES, None, with_low, "mates")
    families = written(components(joined, name="families"), "families")
    members = reps.join(families, reps["id"] == families["node"]).select(F.col("component").alias("g"), "id", "n")
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("__t"))
    wanted = members.select(F.col("id").alias("mid"), F.col("n").alias("n1")).join(reps.select(F.col("id").alias("rid"), "sketch"), F.col("mid") == F.col("rid")).drop("rid")
    held = texts.join(wanted, F.col("doc") == F.col("mid")).drop("doc")
    # the set of an id's other text, where ids repeat, is not the one that was sketched
    held = written(with_sets(held, "__t").filter(F.octet_length("set") == 8 * F.col("n1")).select("mid", F.col("sketch").alias("x"), F.col("set").alias("y")), "sets")
    with_set = lambda df: df.join(held, F.col("id") == F.col("mid")).drop("mid")
    found = group_links(members, linked, percent, BLOCK_DOCS, BLOCK_SHINGLES, with_set, "links")
    links = components(found, name="linked").withColumnRenamed("node", "rep")
    forget(held)
    rooted = classes.join(links, "rep", "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("root"))
    out = all_rows.drop("sketch").join(rooted, ["n", "f1", "f2"], "left")
    root = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("root", "id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce(root == F.col("id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 85) -> DataFrame:
    """The documents with the smallest id of their component; of rows with one id, all or none."""
    gone = near_components(docs, text, key, percent).filter("not kept").select(F.col(key).alias("__gone")).distinct()
    return docs.join(gone, F.col(f"`{key}`") == F.col("__gone"), "left_anti")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))
