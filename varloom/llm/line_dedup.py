"""Line dedup with a log-template tree: recurring line templates stay in their first document only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.common import NOT_WHITE, WHITE, table, words, written

#: A token with a digit is a variable field.
FIELD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
BLANKS = " \t\n\v\f\r"
#: White space that is not one space between words.
UNEVEN = r"[\x09-\x0D]|\x20\x20"
MIN_WORDS, LEADING, SIMILAR = 3, 3, 0.9
#: What follows changes the work, never the result: pairs a row that are compared at once, the
#: share of pairs that an election must take away, and the most differing tokens at which runs are paired.
SPARE, GAIN, PAIRED = 4, 0.05, 4


def masked_line(line):
    """The line with its variable fields generalised and one space between words; a pattern runs only where it has work."""
    line = F.btrim(line, F.lit(BLANKS))
    line = F.when(line.rlike("[0-9]"), F.regexp_replace(line, FIELD, "<*>")).otherwise(line)
    return F.when(line.rlike(UNEVEN), F.regexp_replace(line, f"{WHITE}+", " ")).otherwise(line)


def lines_of(docs: DataFrame, text: str, key: str, leading: int) -> DataFrame:
    """A row of numbers per line: document, text hash, position, token count, leaf and hash of the masked line.

    The leaf is the line's place in the tree: token count, then leading tokens.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.col(key).alias("id"), F.xxhash64(t).alias("th"), F.posexplode(F.split(t, "\n")).alias("pos", "line"))
    df = df.select("id", "th", "pos", masked_line(F.col("line")).alias("m")).withColumn("n", F.regexp_count("m", F.lit(f"{NOT_WHITE}+")))
    return df.select("id", "th", "pos", "n", F.xxhash64("n", F.substring_index("m", " ", leading)).alias("leaf"), F.xxhash64("m").alias("masked"))


def agree(a: str, b: str):
    """The number of positions at which two token columns agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def misses(n, similar: float):
    """How many of n tokens may differ between a line and its template."""
    return (n - F.ceil(F.lit(float(similar)) * n)).cast("int")


def shared_runs(similar: float):
    """Hashes of which two token columns `tok` of one length share some if they agree on a share of `similar`.

    Kinds that differ at d tokens at most are equal on two of d + 2 runs of tokens, and on one of d + 1.
    Pairs of runs tell more, single ones are fewer; both find every kind that agrees.
    """
    n = F.size("tok")
    d = F.greatest(misses(n, similar), F.lit(0))
    parts = F.when(d <= PAIRED, d + 2).otherwise(d + 1)
    cut = lambda i: F.floor(i * n / parts).cast("int")
    runs = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.xxhash64(i, F.slice("tok", cut(i) + 1, cut(i + 1) - cut(i))))
    after = lambda x, i: F.transform(F.slice(runs, i + 2, parts), lambda y: F.xxhash64(x, y))
    return F.when(d <= PAIRED, F.flatten(F.transform(runs, after))).otherwise(runs)


def meet(pairs: DataFrame, rest: DataFrame, similar: float) -> DataFrame:
    """The (leaf, a, b) of pairs whose tokens agree."""
    tokens = lambda x: rest.select("leaf", F.struct("times", "masked").alias(x), F.col("tok").alias(f"{x}_tok"))
    pairs = pairs.distinct().join(tokens("a"), ["leaf", "a"]).join(tokens("b"), ["leaf", "b"])
    return pairs.filter(agree("b_tok", "a_tok") >= similar * F.size("b_tok")).select("leaf", "a", "b")


def elected(runs: DataFrame, rest: DataFrame, similar: float, spare: float, gain: float) -> tuple[DataFrame, DataFrame | None]:
    """(runs that are left, links of leads to kinds that agree with them): every run elects its foremost kind that no lead takes in.

    A kind that all of its runs elect leads, as no kind before it is left to take it in. It is
    compared with the kinds of its runs and leaves, so a round compares each row of `runs` once. Kinds taken
    in elect no more and stay while a run may still elect a kind before their lead. Rounds end
    when what is left has no more than `spare` pairs a row of the start, or when one takes away
    less than a share `gain` of the pairs, as where kinds share runs and don't agree.
    """
    links, k, least, before = None, 0, None, None
    while True:
        per = runs.groupBy("leaf", "run").agg(F.count("*").alias("c"))
        size = per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("c") * (F.col("c") - 1.0) / 2), F.lit(0.0)).alias("pairs")).first()
        least = spare * size.rows if least is None else least
        if size.pairs <= least or (before is not None and size.pairs > (1 - gain) * before):
            return runs, links
        before = size.pairs
        tops = runs.groupBy("leaf", "run").agg(F.max(F.when(F.col("lead").isNull(), F.col("kind"))).alias("top"), F.count("*").alias("c")).filter("top is not null and c > 1")
        met = runs.join(tops.drop("c"), ["leaf", "run"]).filter("lead is null or lead < top")
        heads = met.filter("lead is null").groupBy("leaf", "kind").agg(F.min(F.col("kind") == F.col("top")).alias("leads")).filter("leads").select("leaf", "kind")
        heads = written(heads, f"heads-{k}")
        near = met.filter("kind < top").join(heads.select("leaf", F.col("kind").alias("top")), ["leaf", "top"], "left_semi")
        now = written(meet(near.select("leaf", F.col("top").alias("a"), F.col("kind").alias("b")), rest, similar), f"links-{k}")
        links = now if links is None else links.unionAll(now)
        best = now.groupBy("leaf", F.col("b").alias("kind")).agg(F.max("a").alias("found"))
        left = met.join(heads, ["leaf", "kind"], "left_anti").join(best, ["leaf", "kind"], "left")
        runs = written(left.select("leaf", "run", "kind", F.greatest("lead", "found").alias("lead")), f"runs-{k}")
        k += 1


def settled(rest: DataFrame, similar: float, spare: float = SPARE, gain: float = GAIN) -> DataFrame:
    """(leaf, masked, template) of the kinds that others take in, as if every leaf had a round for each of its kinds.

    A kind leads if no kind met by more lines that leads takes it in. Elections find the leads of
    common templates; the kinds they leave are compared in pairs where they share a run.
    """
    kinds = rest.select("leaf", F.struct("times", "masked").alias("kind"), F.explode(shared_runs(similar)).alias("run"))
    shared = kinds.groupBy("leaf", "run").agg(F.count("*").alias("k")).filter("k > 1").select("leaf", "run")
    runs = kinds.join(shared, ["leaf", "run"], "left_semi").withColumn("lead", F.lit(None).cast(kinds.schema["kind"].dataType))
    runs, links = elected(written(runs, "runs"), rest, similar, spare, gain)
    a = runs.filter("lead is null").select("leaf", "run", F.col("kind").alias("a"))
    b = runs.select("leaf", "run", F.col("kind").alias("b"), "lead")
    pairs = a.join(b, ["leaf", "run"]).filter("a > b and (lead is null or lead < a)").select("leaf", "a", "b")
    pairs = written(meet(pairs, rest, similar), "pairs")
    live, taken, k = pairs, None, 0
    while not live.isEmpty():
        heads = live.select("leaf", "a").distinct().join(live.select("leaf", F.col("b").alias("a")), ["leaf", "a"], "left_anti")
        now = written(live.join(heads, ["leaf", "a"], "left_semi").select("leaf", "b").distinct(), f"taken-{k}")
        taken = now if taken is None else taken.unionAll(now)
        live = live.join(now, ["leaf", "b"], "left_anti").join(now.select("leaf", F.col("b").alias("a")), ["leaf", "a"], "left_anti")
        live, k = written(live, f"live-{k}"), k + 1
    if taken is not None:
        pairs = pairs.join(taken.select("leaf", F.col("b").alias("a")), ["leaf", "a"], "left_anti")
    links = pairs if links is None else links.unionAll(pairs)
    return links.groupBy("leaf", F.col("b.masked").alias("masked")).agg(F.max("a").alias("lead")).select("leaf", "masked", F.col("lead.masked").alias("template"))


def templates(docs: DataFrame, rows: DataFrame, text: str, key: str, similar: float) -> DataFrame:
    """(leaf, masked, template) of the lines that other lines of their leaf take in."""
    # where no token may differ, only equal lines agree, and these are one kind
    rows = rows.filter(misses(F.col("n"), similar) > 0)
    kinds = rows.groupBy("leaf", "masked").agg(F.count("*").alias("times"), F.min(F.struct("id", "th", "pos")).alias("at"))
    mixed = kinds.groupBy("leaf").agg(F.count("*").alias("k")).filter("k > 1").select("leaf")
    # the tokens of one line of each kind are fetched from its document
    wanted = kinds.join(mixed, "leaf", "left_semi").select("leaf", "masked", "times", "at.*").groupBy("id", "th").agg(F.collect_list(F.struct("leaf", "masked", "times", "pos")).alias("of"))
    wanted = wanted.select(F.col("id").alias("__gid"), F.col("th").alias("__gth"), F.col("of").alias("__of"))
    t = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(key).alias("__id"), t.alias("__t"))
    held = texts.join(wanted, F.col("__id").eqNullSafe(F.col("__gid")) & (F.xxhash64("__t") == F.col("__gth")))
    held = held.select(F.split("__t", "\n").alias("lines"), "__of").select("lines", F.explode("__of").alias("k")).select("k.*", F.get("lines", F.col("k.pos")).alias("line"))
    # rows that repeat an id and its text fetch the same line again
    rest = written(held.select("leaf", "masked", "times", F.transform(words(masked_line(F.col("line"))), lambda x: F.xxhash64(x)).alias("tok")).dropDuplicates(["leaf", "masked"]), "kinds")
    return settled(rest, similar)


def dropped(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS, leading: int = LEADING, similar: float = SIMILAR) -> DataFrame:
    """(id, th, drop): positions of the lines to drop from the text with hash th of document id.

    A line descends by its token count and leading tokens (fields with digits as <*>) to a
    leaf. In a leaf that two different texts reach, the template met by the most lines takes
    in every line that agrees with it on a share of tokens of at least `similar`; what is
    left over does the same until no line is left that another takes in.
    A template that different texts hold recurs: it stays in the text with the smallest id
    and is dropped from all others. Exact copies of a document are one text here, so they
    are left to near-dedup. Lines of fewer than min_words tokens, null and empty texts are
    left alone, and so are repeats inside one text.
    """
    rows = written(lines_of(docs, text, key, leading), "lines").filter(F.col("n") >= min_words)
    leaves = rows.groupBy("leaf").agg(F.min("th").alias("a"), F.max("th").alias("b")).filter("a <> b").select("leaf")
    rows = rows.join(leaves, "leaf", "left_semi")
    named = templates(docs, rows, text, key, similar)
    rows = rows.join(named, ["leaf", "masked"], "left").withColumn("template", F.coalesce("template", "masked"))
    homes = rows.groupBy("leaf", "template").agg(F.min(F.struct("id", "th")).alias("home"), F.min("th").alias("a"), F.max("th").alias("b")).filter("a <> b").select("leaf", "template", F.col("home.th").alias("home"))
    out = rows.join(homes, ["leaf", "template"]).filter("th <> home")
    return out.groupBy("id", "th").agg(F.array_sort(F.collect_set("pos")).alias("drop"))


def without_recurring(docs: DataFrame, text: str = "text", key: str = "doc_id", **tree) -> DataFrame:
    """docs with __lines (lines before), __drop (positions dropped) and the text without them."""
    t = F.coalesce(F.col(text), F.lit(""))
    gone = dropped(docs, text, key, **tree).select(F.col("id").alias("__gid"), F.col("th").alias("__gth"), F.col("drop").alias("__drop"))
    df = docs.withColumn("__th", F.xxhash64(t))
    df = df.join(gone, F.col(f"`{key}`").eqNullSafe(F.col("__gid")) & (F.col("__th") == F.col("__gth")), "left").drop("__gid", "__gth", "__th")
    df = df.withColumn("__drop", F.coalesce("__drop", F.array().cast("array<int>")))
    parts = F.split(t, "\n")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__drop")), lambda i: F.get(parts, i))
    return df.withColumn("__lines", F.size(parts)).withColumn(text, F.when(F.size("__drop") == 0, F.col(text)).otherwise(F.array_join(left, "\n")))


def drop_recurring(docs: DataFrame, text: str = "text", key: str = "doc_id", **tree) -> DataFrame:
    """docs without recurring lines; a document of which nothing but blanks is left goes.

    n_chars, where there is such a column, follows the text.
    """
    df = without_recurring(docs, text, key, **tree)
    stays = (F.size("__drop") == 0) | F.col(text).rlike(NOT_WHITE)
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(F.size("__drop") == 0, F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    # as in quality_rules.keep, no filter that would repeat the new text inside itself
    row = F.explode(F.when(stays, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    return df.select(*[f"`{c}`" for c in docs.columns], row.alias("__row")).drop("__row")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_recurring(docs).select("doc_id", F.col("__lines").alias("n_lines"), F.size("__drop").alias("n_dropped"), F.col("__drop").alias("dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
