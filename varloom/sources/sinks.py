"""Writers: by sample, and only what is not done yet."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "sample string, digest string, n_rows long, at timestamp"
#: Folder of each local session that has no shared one, and the tables of the scratch() scopes that are open.
_OWN: dict[str, str] = {}
_SCOPES: list[list[DataFrame]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session has a folder of its own; on a cluster that would be a
    different folder on every machine, so it is an error there.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir() or _OWN.get(context.applicationId)
    if not path:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = _OWN[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='varloom-')}"
    return path.rstrip("/")


def materialised(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder: written once, however often the plan above uses them.

    All tables of a session are in one folder, named by its application.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/varloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def dealt_table(df: DataFrame, name: str, by: str, tasks: int) -> tuple[DataFrame, DataFrame]:
    """materialised() rows that are dealt by a column to so many tasks, twice: as a table that is read so, and as any other.

    What groups by the column doesn't move out of the first. A union takes the second, as Spark
    tells that its sides are dealt alike only if both are moved, and moves no table that is dealt so.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/varloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    # buckets need a name in the catalog until the table is found; the files are our own and stay
    table = f"varloom_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(tasks, by).option("path", path).saveAsTable(table)
    kept, plain = spark.table(table), spark.read.schema(df.schema).parquet(path)
    spark.sql(f"DROP TABLE {table}")
    if _SCOPES:
        _SCOPES[-1].append(plain)
    return kept, plain


def forget(df: DataFrame) -> None:
    """Deletes the files of a materialised() table that nothing will read again: an empty one takes its place."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(folder)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables that are materialised inside are forgotten at its end, but for those taken out of the list that it gives."""
    _SCOPES.append([])
    try:
        yield _SCOPES[-1]
    finally:
        for df in _SCOPES.pop():
            forget(df)


def todo(df: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not done."""
    return df.join(done.select(*key).distinct(), key, "left_anti")


def write_by_sample(df: DataFrame, path: str, sample: str = "sample_id", salts: int = 8) -> None:
    """A folder per sample; a large sample is several files, so no task writes it alone."""
    df.repartition(F.col(sample), F.pmod(F.xxhash64(*df.columns), F.lit(salts))).write.mode("append").partitionBy(sample).parquet(path)


def write_missing(df: DataFrame, path: str, key: list[str]) -> None:
    """Appends rows whose key the table at path doesn't hold yet; running it again adds none."""
    try:
        done = df.sparkSession.read.parquet(path)
    except AnalysisException:  # nothing is written yet
        done = None
    (df if done is None else todo(df, done, key)).write.mode("append").parquet(path)


def digests(inputs: DataFrame, sample: str) -> DataFrame:
    """(sample, digest) of each sample's input rows, whatever their order and place."""
    row = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in inputs.columns])
    return inputs.groupBy(F.col(sample).cast("string").alias("sample")).agg(F.sha2(F.concat_ws("|", F.count("*"), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)), 256).alias("digest"))


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """(sample, digest, n_rows, at): the last record of each sample, or nothing before the first."""
    try:
        records = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException:
        return None
    return records.groupBy("sample").agg(F.max(F.struct("at", "digest", "n_rows")).alias("r")).select("sample", "r.digest", "r.n_rows", "r.at")


def due(inputs: DataFrame, path: str, sample: str = "sample_id") -> DataFrame:
    """(sample, digest) of samples without a record of just these inputs."""
    own, done = digests(inputs, sample), manifest(inputs.sparkSession, path)
    return own if done is None else own.join(done.select("sample", "digest"), ["sample", "digest"], "left_anti")


def resume(inputs: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, sample: str = "sample_id") -> int:
    """Makes and writes the samples that are due; their number.

    A sample's folder is replaced as a whole, and its record follows once all rows are
    committed. So a run that was killed leaves folders without a record, which the next run
    makes again and finished() doesn't show; changed inputs are made again; two writers of one
    sample replace each other and never add up.
    """
    spark = inputs.sparkSession
    todo_ = materialised(due(inputs, path, sample), "due")
    rows = make(inputs.join(todo_.select(F.col("sample").alias("__s")), F.col(f"`{sample}`").cast("string") == F.col("__s"), "left_semi"))
    made = materialised(rows, "made")
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(sample).parquet(f"{path}/rows")
    counts = made.groupBy(F.col(sample).cast("string").alias("sample")).agg(F.count("*").alias("n_rows"))
    records = todo_.join(counts, "sample", "left").select("sample", "digest", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), F.current_timestamp().alias("at"))
    n = todo_.count()
    if n:
        records.write.mode("append").parquet(f"{path}/manifest")
    forget(made)
    forget(todo_)
    return n


def finished(spark: SparkSession, path: str, sample: str = "sample_id") -> DataFrame | None:
    """Rows of samples with a record; a sample that was made again without rows has none."""
    done = manifest(spark, path)
    if done is None:
        return None
    rows = spark.read.option("partitionColumnTypeInference.enabled", False).parquet(f"{path}/rows").withColumn(sample, F.col(sample).cast("string"))
    return rows.join(done.filter("n_rows > 0").select(F.col("sample").alias(sample)), sample, "left_semi")


def write_report(df: DataFrame, path: str, order: list, sample: str = "sample_id", dealt: bool = False) -> None:
    """One ordered CSV per sample; dealt says that a sample's rows are in one task already, as a window over samples leaves them."""
    (df if dealt else df.repartition(sample)).sortWithinPartitions(sample, *order).write.mode("overwrite").partitionBy(sample).option("header", True).csv(path)


def write_map(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
