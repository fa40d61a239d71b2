"""Session settings, table loading and intermediate tables that outlive executors."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructField, StructType

#: Largest table, in bytes as estimated from its values, that size-checked joins broadcast.
BROADCAST_BYTES = 32 << 20


def session(app: str = "loomery", cpus: str = "*") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or what setCheckpointDir named.

    Where neither is set, a local session gets a temporary folder of its own. On a cluster that folder would be another
    one on each machine, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='loomery-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Batches of long texts of a few MB: what readers, Python workers and Arrow hold at once follows them.

    A vectorised Parquet batch has 4,096 rows by default, which for texts means arrays of tens of MB in the heap.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")


class Scratch:
    """Intermediate Parquet tables under the shared folder.

    A written table cuts lineage and survives lost executors. ``drop`` removes tables that nothing reads any more,
    ``keep_only`` all but those that the result reads. What results still read goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, tag: str):
        bound_batches(spark)
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", 0
        self.paths: list[str] = []
        _at_exit(spark, self.root)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str, **options) -> DataFrame:
        """df as a written table; ``options`` are the writer's."""
        at = self.path(name)
        df.write.options(**options).parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._loomery_path = at
        self.paths.append(at)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if at := getattr(t, "_loomery_path", None):
                _delete(self.spark, at)
                self.paths = [p for p in self.paths if p != at]

    def keep_only(self, *tables: DataFrame | None) -> None:
        """Remove the tables written so far but these; only once nothing lazy reads the others."""
        stay = {getattr(t, "_loomery_path", None) for t in tables}
        for at in self.paths:
            if at not in stay:
                _delete(self.spark, at)
        self.paths = [p for p in self.paths if p in stay]


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _exists(spark: SparkSession, at: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _at_exit(spark: SparkSession, root: str) -> None:
    """Mark a folder so that the driver's JVM deletes it when it ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)


def _width(x: Column, kind: DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(x), F.lit(0)).cast("bigint") + 16
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, StringType | BinaryType | ArrayType | MapType | StructType):
            return F.coalesce(F.aggregate(x, F.lit(24).cast("bigint"), lambda acc, v: acc + _width(v, kind.elementType)), F.lit(24))
        return F.greatest(F.size(x), F.lit(0)).cast("bigint") * 8 + 24
    if isinstance(kind, MapType):
        return _width(F.map_entries(x), ArrayType(StructType([StructField("key", kind.keyType), StructField("value", kind.valueType)])))
    if isinstance(kind, StructType):
        return reduce(lambda a, b: a + b, [_width(x[f.name], f.dataType) for f in kind.fields], F.lit(16).cast("bigint"))
    return F.lit(8).cast("bigint")


def broadcast_bytes(df: DataFrame) -> int:
    """About how many bytes a written table takes when broadcast."""
    total = reduce(lambda a, b: a + b, [_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields], F.lit(24).cast("bigint"))
    return df.agg(F.sum(total)).first()[0] or 0


def small_enough(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    return broadcast_bytes(df) <= most


def checked_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a written table after its bytes were counted; larger ones stay shuffled joins."""
    return F.broadcast(df) if small_enough(df, most) else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for columns that an operator adds for itself: none is a name of df's, whatever the case."""
    taken, mark = {c.lower() for c in df.columns}, "_"
    while any(f"{mark}{n}".lower() in taken for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]


def released(run):
    """A mapInArrow function that hands free memory back to the system when its task ends: workers live on, idle.

    What a worker had loaded before its first task stays, so later tasks need not look for garbage among it.
    """

    @wraps(run)
    def inner(batches):
        import pyarrow as pa

        if not gc.get_freeze_count():
            gc.freeze()
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return inner
