"""Tables of a store: Parquet below one folder, or DataFrames given by name."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Lets the Python workers of a local session import this package from where it is.

    On a cluster the package is installed or shipped with --py-files as usual.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH")) if x)


class Tables:
    """Reads a table as a lazy DataFrame: <root>/<name>.parquet, unless one is given."""

    def __init__(self, spark: SparkSession, root: str = "", given: dict[str, DataFrame] | None = None):
        self.spark, self.root, self.given = spark, root.rstrip("/"), dict(given or {})

    def __call__(self, name: str) -> DataFrame:
        if name not in self.given:
            # Read once for its schema; the scan itself prunes columns and pushes filters each time.
            self.given[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self.given[name]

    def with_tables(self, changed: dict[str, DataFrame]) -> Tables:
        return Tables(self.spark, self.root, self.given | changed)


def views(spark: SparkSession, tables: Tables, names) -> None:
    """Registers tables as temporary views of their names."""
    for name in names:
        tables(name).createOrReplaceTempView(name)
