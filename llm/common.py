"""Session helpers: shared tables that cut lineage, and shipping of this package to workers."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows times bytes a row up to which a side, once counted, is broadcast; beyond it the join is shuffled.
BROADCAST_BYTES = 32 << 20

#: What goes to a Python worker at once: few rows, as one text can be large.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}

_made: list[str] = []

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir.  Where that is unset, a new local one if the executors run in this process, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later stages survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _made:
        _made.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by cut() once nothing that is still to run reads them."""
    for t in tables:
        _delete(t.sparkSession, t.cut_path)


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with a number, that no column of df has in any case."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in (name, *(f"{name}_{i}" for i in range(len(taken) + 1))) if x.lower() not in taken)


def mark() -> int:
    """A point in time for sweep_since()."""
    return len(_made)


def sweep_since(point: int, keep: DataFrame) -> None:
    """Delete the tables that cut() made since that point, but that of keep, which was computed from them."""
    for path in [x for x in _made[point:] if x != keep.cut_path]:
        _delete(keep.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that cut() made in this session; for when the results of queries have been written."""
    for path in list(_made):
        _delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, unless they find it on their own path, and set BATCHES where the session says nothing of its own.

    Spark reads the settings when a query runs, so they stay.
    """
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if _ROOT in path or os.path.abspath(os.getcwd()) == _ROOT or getattr(sc, "_llm_shipped", False):
        return
    at = os.path.join(tempfile.mkdtemp(prefix="llm-code-"), "llm_code.zip")
    with zipfile.ZipFile(at, "w") as z:
        here = os.path.join(_ROOT, "llm")
        for f in sorted(os.listdir(here)):
            if f.endswith(".py"):
                z.write(os.path.join(here, f), f"llm/{f}")
    sc.addPyFile(at)
    sc._llm_shipped = True


def free() -> None:
    """Give memory that is no longer used back to the system."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # no such function here


def lean(fn):
    """fn over batches, for a worker that lives on after its task."""
    def run(it):
        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from fn(it)
        finally:
            free()

    return run


def lean_group(fn):
    """fn of a group's table, or of its key and table, likewise."""
    import inspect

    if len(inspect.signature(fn).parameters) == 2:
        def run(key, t):
            out = fn(key, t)
            del t
            free()
            return out
    else:
        def run(t):
            out = fn(t)
            del t
            free()
            return out

    return run


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """mapInArrow for a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(lean(fn), schema)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A broadcast hint if the counted size allows it."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def sample_of_each(rows: DataFrame, kind: str, per_kind: int) -> DataFrame:
    """At most per_kind rows (id, kind, text) of each kind, one an id: those whose ids have the smallest hashes.

    Ids are cut at a hash that leaves about twice per_kind of each kind, so what is ranked and moved is bounded by per_kind, whatever
    part of the rows a kind or an id has.  Rows with a null id, kind or text are left out.
    """
    rows = rows.select("id", kind, "text").where(F.col("id").isNotNull() & F.col(kind).isNotNull())
    # repeated rows of an id are one
    total = cut(rows.groupBy(F.col(kind).alias("of")).agg(F.approx_count_distinct("id").alias("ids")), "kinds")
    total = maybe_broadcast(total, total.count(), 64)
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    near = rows.join(total, F.col(kind) == F.col("of")).where(F.col("text").isNotNull() & (place * F.col("ids") < 2 * per_kind + 40))
    near = near.groupBy("id", kind).agg(F.min("text").alias("text"))
    rank = F.row_number().over(W.partitionBy(kind).orderBy(F.xxhash64("id"), "id"))
    return near.withColumn("r", rank).where(F.col("r") <= per_kind).select("id", kind, "text")


def default_parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)


assert sys.version_info >= (3, 10)
