"""What several operators share: the shared folder, staging, and connected components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import importable  # noqa: F401

#: Characters that separate words, as a Java regular expression class body.
SPACES = r"\x20\x09-\x0D"


def named(column: str):
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


class _InSlices:
    """function over slices of the batches: what it holds at once does not follow Spark's batch size."""

    def __init__(self, function, rows: int):
        self.function, self.rows = function, rows

    def __call__(self, batches):
        return self.function(b.slice(k, self.rows) for b in batches for k in range(0, b.num_rows, self.rows))


def mapped(df: DataFrame, function, schema, rows=1024) -> DataFrame:
    """mapInArrow by place, up to rows at a time: names of df's columns, which may hold dots, are not looked at."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(_InSlices(function, rows), schema)


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder of its own; on a
    cluster a missing setting is an error, as no machine-local folder would do.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = scratch(spark, "file://" + tempfile.mkdtemp(prefix="tessella-"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


#: Folders written by this process, and tables over them (or None), with their session.
_WRITTEN: list[tuple[SparkSession, str, str | None]] = []


@atexit.register
def _remove_written() -> None:
    """Results are lazy and may read a staged table at any time; when the driver's process ends nothing does."""
    for spark, folder, table in _WRITTEN:
        with contextlib.suppress(Exception):  # the JVM may be gone; the folder is scratch space
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            _removed(spark, folder)


def scratch(spark: SparkSession, folder: str, table: str | None = None) -> str:
    """folder, to be removed (and the table over it dropped) when the driver's process ends."""
    _WRITTEN.append((spark, folder, table))
    return folder


def stage_path(spark: SparkSession, name: str, table: str | None = None) -> str:
    return scratch(spark, f"{shared_dir(spark)}/tessella/{uuid.uuid4().hex}-{name}", table)


#: Spark's own switch that removes the shuffle files of a query when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of what is written in here go as soon as it is written."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: the lineage ends there."""
    return _staged(df, name)[0]


def _staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = stage_path(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph, by alternating star contraction.

    edges: two long columns a, b. Returns (id, component): for every id on an edge
    between two different ids, the smallest id that it reaches. Self-loops, repeated
    edges and nulls are ignored. Every round only aggregates minima per node and
    joins them back, so a node with very many neighbours is a skewed join that
    adaptive execution splits, never a group in one task. A round is a table in the
    shared folder, and goes when the next one is written.
    """
    now = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    now, folder = _staged(now, "edges")
    before = None
    while True:
        size = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if size == before or size[0] == 0:
            break
        before = size
        # Large star: every larger neighbour of a node is tied to the node's smallest one.
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        now = (
            both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct()
        )
        # Small star: all smaller neighbours of a node, and the node, are tied to the smallest.
        low = now.groupBy("a").agg(F.min("b").alias("m"))
        now = (
            now.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(low.select("a", F.col("m").alias("b")))
            .where("a <> b").distinct()
        )
        last = folder
        now, folder = _staged(now, "edges")
        _removed(now.sparkSession, last)
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(
        roots.select(F.col("b").alias("id"), F.col("b").alias("component"))
    )
