"""Session-level helpers shared by all operators: durable cuts of lineage, layouts and skew."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, which has no
    other machines, may fall back to a folder of its own; elsewhere an unset folder is an
    error, because executors could not read each other's files.
    """
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not given:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        given = tempfile.mkdtemp(prefix="paperloom-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(given)
    return given


def ship(spark: SparkSession) -> None:
    """Send this package's source to the Python workers, once a session, so that functions
    given to Arrow operators can be unpickled wherever the package isn't installed. The
    driver only stages the archive; Spark's file server hands it to the executors."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    if getattr(sc, "_paperloom_shipped", False) or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="paperloom-ship-")) / "paperloom-src.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._paperloom_shipped = True


def _work_folder(spark: SparkSession) -> str:
    """This session's folder for written tables, removed when the driver ends."""
    sc = spark.sparkContext
    folder = getattr(sc, "_paperloom_folder", None)
    if folder is None:
        folder = sc._paperloom_folder = f"{checkpoint_dir(spark)}/paperloom-{uuid.uuid4().hex}"
        atexit.register(discard, spark, folder)
    return folder


def work_path(spark: SparkSession) -> str:
    """A new path in this session's folder."""
    return f"{_work_folder(spark)}/{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a written table; silently nothing if the session has already gone."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session is being torn down
        pass


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Every row is computed once, and later plans read single columns; an eager
    ``checkpoint()`` would run the last stage twice. For results that are dear to compute.
    """
    spark = df.sparkSession
    path = work_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._paperloom_path = path
    return out


def release(*stored: DataFrame) -> None:
    """Delete tables that ``store`` or ``laid_out`` wrote, once nothing reads them any more."""
    for df in stored:
        path, table = getattr(df, "_paperloom_path", None), getattr(df, "_paperloom_table", None)
        if table:
            df.sparkSession.sql(f"drop table if exists {table}")
        if path:
            discard(df.sparkSession, path)


def spread_join(big: DataFrame, small: DataFrame, on: list[str], hot_rows: int, counts: DataFrame | None = None) -> DataFrame:
    """Inner join in which a key of more than ``hot_rows`` rows of ``big`` is no single task.

    Such keys, fewer than rows / ``hot_rows``, are found by a partial aggregate, or taken
    from ``counts`` (on…, __n) where that is known; their rows of ``big`` are sliced by a hash
    of the row and those of ``small`` are copied to each slice. The list of them is
    broadcast; with so many rows that it could be too long for that, the limit is raised to
    keep it under 10,000 keys.
    """
    counts = store((big.groupBy(*on).agg(F.count("*").alias("__n")) if counts is None else counts).filter(F.col("__n") > hot_rows))
    limit = max(hot_rows, (counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]) // 10_000)
    hot = F.broadcast(counts.filter(F.col("__n") > limit).select(*on, F.ceil(F.col("__n") / limit).cast("int").alias("__slices")))
    slices = F.coalesce("__slices", F.lit(1))
    left = big.join(hot, on, "left").withColumn("__slice", F.pmod(F.xxhash64(*big.columns), slices).cast("int")).drop("__slices")
    right = small.join(hot, on, "left").withColumn("__slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("__slices")
    return left.join(right, [*on, "__slice"]).drop("__slice")


def attach(big: DataFrame, side: DataFrame, key: str, count: str, most: int = 1_000_000, hot_rows: int = 100_000) -> DataFrame:
    """``big`` joined with a stored table of one row per ``key`` whose column ``count`` bounds
    the rows of ``big`` with that key: a broadcast while a count of its rows proves it
    small, else a join that spreads hot keys."""
    if side.count() <= most:
        return big.join(F.broadcast(side), key)
    return spread_join(big, side, [key], hot_rows, side.select(key, F.col(count).alias("__n")))


def laid_out(df: DataFrame, buckets: int, by: list[str], sort: list[str]) -> DataFrame:
    """``store`` as a table bucketed and sorted by columns, which later joins and groupings on
    them read without a shuffle. The catalog only holds its name, until ``release`` or the
    end of the session."""
    spark = df.sparkSession
    name = f"paperloom_{uuid.uuid4().hex}"
    path = f"{_work_folder(spark)}/{name}"
    (df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*sort).format("parquet").option("path", path).saveAsTable(name))
    out = spark.table(name)
    out._paperloom_path, out._paperloom_table = path, name
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense_ids(df: DataFrame, order: list, name: str = "dense_id") -> DataFrame:
    """Number the rows 0..n-1 in the total order ``order`` without a one-task window.

    Rows are range-partitioned and sorted; each gets its place inside its partition, and
    the partition's offset (a prefix sum over one count per partition, the only thing that
    reaches the driver) is added. The ranged rows are written first, so the two
    passes see the same ranges even if an executor is lost in between.
    ``order`` must be a total order for the numbering to be deterministic.
    Empty input gives an empty result; null keys sort first.
    """
    spark = df.sparkSession
    ranged = store(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__mono", F.monotonically_increasing_id())
    )
    part = F.shiftright("__mono", 33).cast("int")
    place = F.col("__mono").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranged.groupBy(part.alias("p")).count().orderBy("p").collect()
    offsets, total = [], 0
    for row in counts:
        offsets.append((row["p"], total))
        total += row["count"]
    if not offsets:
        return ranged.drop("__mono").withColumn(name, F.lit(None).cast("long"))
    bases = spark.createDataFrame(offsets, "__part int, __base long")
    return (
        ranged.withColumn("__part", part)
        .join(F.broadcast(bases), "__part")
        .withColumn(name, F.col("__base") + place)
        .drop("__mono", "__part", "__base")
    )
