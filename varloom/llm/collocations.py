"""Phrase collocations: level-wise counts by double-array tries of frequent phrases that numpy walks at all positions at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.llm.common import table, written
from varloom.llm.tokens import BYTE, STEP, U, mix
from varloom.sources.sinks import scratch

#: Words of the longest phrase.
LONGEST = 4
#: Phrases of one trie at most: more of a level are dealt to several tries, each with a pass of its own.
TRIE = 1 << 20
#: Bits of a symbol: a word's code is three symbols. Nodes with at least so many children are placed one by one.
DIGIT, WIDE = 8, 16
#: Bytes that are hashed, positions that are walked, and steps that are summed at a time.
SLICE, WINDOW, FLUSH = 1 << 21, 1 << 20, 1_500_000
#: Rows of a batch that a task hands on.
ROWS = 100_000

# What ends a piece, and what else ends a word.
BREAKS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(BREAKS)] = True
_GAP = _BREAK.copy()
_GAP[list(GAPS)] = True


def _powers(x: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[U(1)], np.full(SLICE, x, dtype=U)]), dtype=U)


POWER, INVERSE = _powers(int(STEP)), _powers(pow(int(STEP), -1, 1 << 64))


def block(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, unfinished hash, piece) of the words of up to SLICE bytes; edges are the places where a text starts."""
    word = ~_GAP[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inside = edges[edges < len(raw)]
    first[inside] = word[inside]
    last[inside[inside > 0] - 1] = word[inside[inside > 0] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.concatenate([[U(0)], np.cumsum(BYTE[raw] * POWER[: len(raw)], dtype=U)])
    piece = np.cumsum(_BREAK[raw])[start] + np.searchsorted(edges, start, side="right")
    return start, end, (sums[end] - sums[start]) * INVERSE[start], piece


def long_text(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As block(), of one text of any length: a word that a block cuts is hashed on in the next."""
    out, held, pieces = [], None, 0
    for lo in range(0, len(raw), SLICE):
        part = raw[lo : lo + SLICE]
        start, end, h, piece = block(part, np.zeros(0, np.int64))
        start, end, piece = start + lo, end + lo, piece + pieces
        pieces += int(_BREAK[part].sum())
        if held is not None:
            s, e, x, p = held
            if len(start) and start[0] == lo:
                h[0] = U(x) + h[0] * U(pow(int(STEP), e - s, 1 << 64))
                start[0], piece[0] = s, p
            else:
                out.append((np.array([s]), np.array([e]), np.array([x], dtype=U), np.array([p])))
            held = None
        if len(end) and end[-1] == lo + len(part) < len(raw):
            held = int(start[-1]), int(end[-1]), int(h[-1]), int(piece[-1])
            start, end, h, piece = start[:-1], end[:-1], h[:-1], piece[:-1]
        out.append((start, end, h, piece))
    return tuple(np.concatenate(x) for x in zip(*out))


def lang_key(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "big")


def tokens(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray]]:
    """(hash of language and word, piece, start, end, bytes, row) of the words of (lang, text) rows, some texts at a time."""
    text = batch.column(1).cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    langs = batch.column(0).dictionary_encode()
    salt = np.array([lang_key(x) for x in langs.dictionary.to_pylist()], dtype=U)[langs.indices.to_numpy()] if len(text) else np.zeros(0, U)
    row = 0
    while row < len(text):
        end = max(row + 1, int(np.searchsorted(at, at[row] + SLICE, side="right")) - 1)
        part = raw[at[row] : at[end]]
        starts = at[row:end] - at[row]
        a, b, h, piece = block(part, starts) if len(part) <= SLICE else long_text(part)
        if len(a):
            own = row + np.searchsorted(starts, a, side="right") - 1
            with np.errstate(over="ignore"):
                yield mix(mix(h ^ (b - a).astype(U)) + salt[own]), piece, a, b, part, own
        row = end


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, h, c) of each word of a shard."""

    def flush() -> pa.RecordBatch:
        h, c = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        langs, texts = [y for x in held for y in x[2]], [y for x in held for y in x[3]]
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(back, weights=c).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([langs[i] for i in first], pa.string()), pa.array([texts[i] for i in first], pa.binary()).cast(pa.string()), pa.array(keys.view(np.int64)), pa.array(total)], ["lang", "word", "h", "c"])

    held, n = [], 0
    for batch in batches:
        names = batch.column(0).to_pylist()
        for h, _, a, b, part, own in tokens(batch):
            keys, first, c = np.unique(h, return_index=True, return_counts=True)
            low = part.tobytes().lower()  # on bytes: A-Z only
            held.append((keys, c, [names[i] for i in own[first]], [low[i:j] for i, j in zip(a[first], b[first])]))
            n += len(keys)
            if n >= FLUSH // 4:
                yield flush()
                held, n = [], 0
    if n:
        yield flush()


class Trie:
    """A double-array trie of phrases of one length, given as rows of word hashes.

    A word is three symbols of its code, its place among the trie's words. The child of slot s by
    symbol c is slot base[s] + c if check of that slot is s; slot 0 leads nowhere, slot 1 is the root.
    """

    def __init__(self, phrases: np.ndarray):
        self.phrases, self.length = phrases, phrases.shape[1]
        self.words, codes = np.unique(phrases, return_inverse=True)
        codes = codes.reshape(phrases.shape)
        # logical nodes: the distinct prefixes, symbol by symbol; edges by parent
        node, nodes, edges = np.zeros(len(phrases), np.int64), 1, []
        for k in range(self.length):
            for symbol in symbols(codes[:, k]):
                keys, first, back = np.unique((node << DIGIT) + symbol, return_index=True, return_inverse=True)
                edges.append((node[first], symbol[first], nodes + np.arange(len(keys))))
                node, nodes = nodes + back, nodes + len(keys)
        parent, symbol, child = (np.concatenate(x) for x in zip(*edges))
        order = np.lexsort((symbol, parent))
        parent, symbol, child = parent[order], symbol[order], child[order]
        first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        slot, of = np.ones(nodes, np.int64), np.zeros(nodes, np.int64)
        of[parent[first]] = placed(symbol, first, np.diff(np.append(first, len(parent))))
        slot[child] = of[parent] + symbol
        size = int(slot.max()) + (2 << DIGIT)
        self.base, self.check, self.phrase = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.base[slot] = of
        self.check[slot[child]] = slot[parent]
        self.phrase[slot[node]] = np.arange(len(phrases))
        # the state after the first word, by its code
        self.first = self.step(np.ones(len(self.words), np.int32), np.arange(len(self.words)))

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states that a word leads to."""
        for symbol in symbols(code):
            to = self.base[state] + symbol
            state = np.where(self.check[to] == state, to, 0)
        return state

    def at(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the phrase that starts at each position, or -1: all states that are alive advance together, word by word."""
        codes = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        known = self.words[codes] == hashes
        live = np.flatnonzero(known[: max(len(hashes) - self.length + 1, 0)])
        state = self.first[codes[live]]
        for k in range(1, self.length):
            on = (state > 0) & known[live + k]
            live, state = live[on], state[on]
            state = self.step(state, codes[live + k])
        out = np.full(len(hashes), -1, np.int32)
        out[live] = self.phrase[state]
        return out


def symbols(code: np.ndarray) -> list[np.ndarray]:
    """The three symbols of word codes, the highest first."""
    return [code >> (DIGIT * i) & ((1 << DIGIT) - 1) for i in (2, 1, 0)]


def placed(symbol: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A base for each node's symbols (count[i] of them from first[i], ascending) such that no two children share a slot.

    Wide nodes come one after another; then the others, by size, are all tried on free slots at
    once: those that find theirs free and claim them alone stay, the rest try again, and lone
    children fill what is left.
    """
    rng, width = np.random.default_rng(7), 1 << DIGIT
    base, end = np.zeros(len(first), np.int64), 2 * width
    wide = np.flatnonzero(count >= WIDE)
    low, high = symbol[first[wide]], symbol[first[wide] + count[wide] - 1]
    ends = end + np.cumsum(high - low + 1)
    base[wide] = ends - 1 - high
    used = np.zeros((int(ends[-1]) if len(wide) else end) + width, dtype=bool)
    used[:end] = True
    for i in wide:
        used[base[i] + symbol[first[i] : first[i] + count[i]]] = True
    for size in range(WIDE - 1, 1, -1):
        todo = np.flatnonzero(count == size)
        while len(todo):
            free = np.flatnonzero(~used[:-width])
            if len(free) < 3 * size * len(todo):
                used = np.concatenate([used, np.zeros(3 * size * len(todo) + width, dtype=bool)])
                free = np.flatnonzero(~used[:-width])
            own = symbol[first[todo][:, None] + np.arange(size)]
            tried = rng.choice(free, len(todo), replace=False) - own[:, 0]
            slots = tried[:, None] + own
            claim = np.full(len(used), -1, np.int64)
            claim[slots.ravel()] = np.repeat(np.arange(len(todo)), size)
            good = ~used[slots].any(axis=1) & (claim[slots] == np.arange(len(todo))[:, None]).all(axis=1)
            base[todo[good]] = tried[good]
            used[slots[good]] = True
            todo = todo[~good]
    lone = np.flatnonzero(count == 1)
    used = np.concatenate([used, np.zeros(len(lone), dtype=bool)])
    base[lone] = np.flatnonzero(~used)[: len(lone)] - symbol[first[lone]]
    return base


def steps(rows: DataFrame, trie, whole: bool, length: int, ahead: int) -> DataFrame:
    """(w1 ... w{length + ahead}, c): how often the phrases of a trie go on by one word (the last columns null) up to `ahead` inside a piece, summed per shard.

    These steps are the candidates of the next levels. Where the trie is the whole level, the
    words of a step that end in each of its words must be phrases of the level too.
    """
    names = [f"w{i + 1}" for i in range(length + ahead)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie.value

        def flush() -> Iterator[pa.RecordBatch]:
            words = np.unique(np.concatenate([w for _, *after in held for w in after]))
            # a candidate's state is its phrase and its further words; equal states are one bin
            key = np.concatenate([p for p, *_ in held]).astype(np.int64)
            for i in range(1, ahead + 1):
                key = key * len(words) + np.concatenate([np.searchsorted(words, x[i]) for x in held])
            held.clear()
            key.sort()
            new = np.concatenate([[True], key[1:] != key[:-1]])
            c = np.bincount(np.cumsum(new) - 1)
            key = key[new]
            for lo in range(0, len(key), ROWS):
                rest, tail = key[lo : lo + ROWS], []
                for _ in range(ahead):
                    rest, last = np.divmod(rest, len(words))
                    tail.insert(0, words[last])
                path = t.phrases[rest]
                cols = [pa.array(np.ascontiguousarray(path[:, i]).view(np.int64)) for i in range(length)]
                cols += [pa.array(x.view(np.int64), mask=x == U(0)) for x in tail]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(c[lo : lo + ROWS].astype(np.int64))], [*names, "c"])

        held, n = [], 0
        for batch in batches:
            for hashes, pieces, *_ in tokens(batch):
                for lo in range(0, len(hashes), WINDOW):
                    h, piece = hashes[lo : lo + WINDOW + length + ahead], pieces[lo : lo + WINDOW + length + ahead]
                    found = t.at(h)
                    ends = np.flatnonzero(found[:WINDOW] >= 0)
                    for k in range(1, ahead + 1):
                        ends = ends[ends + length + k - 1 < len(h)]
                        ok = piece[ends] == piece[ends + length + k - 1]
                        if whole:
                            ok &= found[ends + k] >= 0
                        ends = ends[ok]
                        if len(ends):
                            held.append((found[ends], *[h[ends + length + i] if i < k else np.zeros(len(ends), U) for i in range(ahead)]))
                            n += len(ends)
                    if n >= FLUSH:
                        yield from flush()
                        n = 0
        if n:
            yield from flush()

    return rows.mapInArrow(count, ", ".join(f"{x} long" for x in [*names, "c"]))


def next_levels(rows: DataFrame, level: DataFrame, length: int, longest: int, least: int, most: int) -> list[DataFrame]:
    """Phrases of one word more that occur `least` times, and of two words more where one trie holds a whole level of pairs.

    One pass over the texts for each trie of the level.
    """
    spark, names = rows.sparkSession, [f"w{i + 1}" for i in range(length)]
    tries = max(1, -(-level.count() // most))
    ahead = 2 if tries == 1 and 1 < length < longest - 1 else 1
    longer = [f"w{i + 1}" for i in range(length + ahead)]
    own = F.pmod(F.xxhash64(*names), F.lit(tries))
    out = None
    for i in range(tries):
        got = level.filter(own == i).select(*names).toArrow()
        if not len(got):
            continue
        sent = spark.sparkContext.broadcast(Trie(np.stack([got.column(c).to_numpy().view(U) for c in names], axis=1)))
        sums = steps(rows, sent, tries == 1, length, ahead).groupBy(*longer).agg(F.sum("c").alias("f")).filter(F.col("f") >= least)
        part = written(sums, f"phrases-{length + 1}")
        sent.destroy()
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = spark.createDataFrame([], ", ".join(f"{x} long" for x in [*longer, "f"]))
    if ahead == 1:
        return [out]
    return [out.filter(F.col(longer[-1]).isNull()).drop(longer[-1]), out.filter(F.col(longer[-1]).isNotNull())]


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, top: int | None = 2000, longest: int = LONGEST, share: int = 80, most: int = TRIE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of each language that hold together best.

    Null languages are und, null and empty texts have no word, repeated rows count each time, an
    empty table gives no row. Ties of score go to the more frequent, then to the smaller phrase.
    A text of any length is walked in windows; `most` bounds the phrases that a trie, and so the
    driver, holds. Raises if a frequent word shares its 64-bit hash with another word.
    """
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    with scratch() as made:
        words = written(rows.mapInArrow(word_counts, "lang string, word string, h long, c long").groupBy("lang", "word", "h").agg(F.sum("c").alias("f")), "words")
        totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
        level = written(words.filter(F.col("f") >= least), "phrases-1")
        if not words.groupBy("h").agg(F.count("*").alias("k"), F.max("f").alias("f")).filter((F.col("k") > 1) & (F.col("f") >= least)).isEmpty():
            raise ValueError("two words share a hash")
        levels = [level.select(F.col("h").alias("w1"), "f")]
        while len(levels) < longest:
            levels += next_levels(rows, levels[-1], len(levels), longest, least, most)
        flat = [x.select(F.array(*[f"w{i + 1}" for i in range(k + 1)]).alias("w"), F.col("f").alias("a")) for k, x in enumerate(levels)]
        known = flat[0]
        for x in flat[1:]:
            known = known.unionAll(x)
        phrases, wide = known.filter(F.size("w") > 1), lambda c: F.col(c).cast("decimal(38,0)")
        # the lowest-scoring cut of each phrase; both parts are as frequent as the phrase, so they are known
        cuts = phrases.select("w", "a", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
        cuts = cuts.select("w", "a", "k", F.slice("w", F.lit(1), F.col("k")).alias("first"), F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
        cuts = cuts.join(known.select(F.col("w").alias("first"), F.col("a").alias("l")), "first").join(known.select(F.col("w").alias("rest"), F.col("a").alias("r")), "rest")
        cuts = cuts.withColumn("score", F.expr("(2000000BD * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
        scored = cuts.groupBy("w", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("w", "a", "cut.score", "cut.l", "cut.r")
        # phrases that a longer one nearly always holds
        inner = phrases.filter(F.size("w") > 2).select("a", "w", F.explode(F.expr("flatten(transform(sequence(2, size(w) - 1), n -> transform(sequence(1, size(w) - n + 1), i -> slice(w, i, n))))")).alias("part"))
        inner = inner.groupBy(F.col("part").alias("w")).agg(F.max("a").alias("longer"))
        kept = scored.join(inner, "w", "left").filter(F.coalesce(100 * wide("longer") < share * wide("a"), F.lit(True)))
        # their texts
        spelt = kept.select("*", F.posexplode("w").alias("i", "h")).join(level.select("h", "lang", "word"), "h")
        spelt = spelt.groupBy("w", "lang", "a", "l", "r", "score").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("words"))
        spelt = spelt.withColumn("phrase", F.concat_ws(" ", "words.word")).join(totals, "lang")
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        out = spelt.withColumn("rank", F.row_number().over(order))
        out = out if top is None else out.filter(F.col("rank") <= top)
        out = written(out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
        made.pop()
    return out


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: The same in SQL: every phrase of one to four words is counted.
ORACLE = r"""
WITH rows AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 pieces AS (SELECT d, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM rows),
 lists AS (SELECT lang, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') AS ws FROM pieces),
 grams AS (SELECT lang, ws[i : i + k - 1] AS w, k FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM lists, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k)),
 f AS (SELECT lang, w, k, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
 n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM lists GROUP BY lang),
 cand AS (SELECT lang, w, k AS m, f AS a FROM f WHERE k > 1),
 cut AS (SELECT c.lang, c.w, c.m, c.a, c.k, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.a) // (l.f + r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) c JOIN f l ON l.lang = c.lang AND l.w = c.w[1 : c.k] JOIN f r ON r.lang = c.lang AND r.w = c.w[c.k + 1 : c.m]),
 low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
 parts AS (SELECT lang, w[i : i + s - 1] AS w, max(a) AS longer FROM (SELECT lang, w, a, s, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM cand WHERE m > 2)) GROUP BY ALL),
 kept AS (SELECT low.*, array_to_string(low.w, ' ') AS phrase FROM low LEFT JOIN parts USING (lang, w) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
 ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM kept)
SELECT lang, rank, phrase, a, l, r, n.n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
