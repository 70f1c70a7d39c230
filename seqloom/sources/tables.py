"""Input tables and the shared folder for intermediate tables.

Inputs are only ever opened by Spark's readers, so any path that Spark can read
will do. Intermediate tables go to the folder named in ``spark.checkpoint.dir``,
which driver and executors share: a lost executor then costs a re-read and not a
recomputation, and lineage is cut without a copy that lives on one machine.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batch_session(spark: SparkSession, rows: int | None = None, size: int = 16 << 20) -> SparkSession:
    """A session with the settings of ``spark``, but for Arrow batches of at most ``rows`` rows and about ``size`` bytes.

    What is read through it has small batches also where it is computed later, and the caller's settings stay.
    """
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if own.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    if rows is not None:
        own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return own


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one for local sessions that set none."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="seqloom-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/seqloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there (lineage is cut)."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_repeats(df: DataFrame, id: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose ``id`` no other row has, and the others, if there are any; only ids are shuffled to tell."""
    again = df.groupBy(id).count().where("count > 1").select(F.col(id).alias("_again"))
    if again.isEmpty():
        return df, None
    same, held = F.col(id).eqNullSafe(F.col("_again")), materialize(again, "repeated")
    return df.join(held, same, "left_anti"), df.join(held, same, "left_semi")


def discard(df: DataFrame | None) -> None:
    """Delete a table that ``materialize`` wrote and that nothing reads any more."""
    if df is None:
        return
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/seqloom/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def quantile_bounds(df: DataFrame, key: Column, n: int, accuracy: int = 10_000) -> list[int]:
    """At most n - 1 ascending cut points that split the whole-number ``key`` into n even ranges.

    What comes to the driver is bounded by ``n``, a parameter, whatever the size of ``df``.
    """
    if n <= 1:
        return []
    shares = [i / n for i in range(1, n)]
    got = df.select(F.percentile_approx(key.cast("bigint"), shares, accuracy).alias("q")).first()["q"]
    return sorted(set(got or []))


def range_bucket(key: Column, bounds: list[int]) -> Column:
    """The number of ``bounds`` that are <= ``key``, by binary search; null keys go to bucket 0."""
    if not bounds:
        return F.lit(0)
    held = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    steps = len(bounds).bit_length()

    def halve(state: Column, _step: Column) -> Column:
        mid = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        done = state["lo"] >= state["hi"]
        below = F.get(held, mid) <= key
        return F.struct(
            F.when(~done & below, mid + 1).otherwise(state["lo"]).alias("lo"),
            F.when(~done & ~below, mid).otherwise(state["hi"]).alias("hi"),
        )

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps + 1)), start, halve, lambda s: s["lo"])
    return F.when(key.isNull(), F.lit(0)).otherwise(found)
