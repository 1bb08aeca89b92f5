"""Binary contents of instances: chunks, whole contents, and where to upload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Entity, Model
from ..sources.tables import Tables


def _content(model: Model, entity: Entity, attribute: str):
    a = model.attribute(entity, attribute)
    column = F.col(f"`{a.column}`")
    return column["content"] if a.datatype == "DT_BLOB" else F.encode(column, "utf-8") if a.datatype == "DT_STRING" else column


def chunk(model: Model, tables: Tables, entity: str, attribute: str, skip: int, count: int, ids=None) -> DataFrame:
    """(id, length, data): bytes skip to skip + count of each content, and how long it is as a whole."""
    e = model.entity(entity)
    content = _content(model, e, attribute)
    rows = tables(e.table)
    if ids is not None:
        rows = rows.where(F.col(f"`{e.id.column}`").isin(list(ids)))
    return rows.select(F.col(f"`{e.id.column}`").alias("id"), F.octet_length(content).alias("length"), F.substring(content, skip + 1, count).alias("data"))


def download(model: Model, tables: Tables, entity: str, attribute: str, id: int) -> bytes:
    """One instance's whole content."""
    row = chunk(model, tables, entity, attribute, 0, 2**31 - 1, [id]).first()
    return bytes(row["data"]) if row is not None and row["data"] is not None else b""


def upload_path(root: str, entity: str, id: int, attribute: str) -> str:
    """Where the content of an instance is to be put."""
    return f"{root.rstrip('/')}/contents/{entity}/{attribute}/{id}"


def files(spark: SparkSession, root: str, entity: str, attribute: str) -> DataFrame:
    """(id, length, content) of the files that were put there."""
    found = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/contents/{entity}/{attribute}/*")
    return found.select(F.regexp_extract("path", r"([^/]+)\z", 1).cast("long").alias("id"), "length", "content")


def equal_contents(model: Model, tables: Tables, entity: str, attribute: str) -> DataFrame:
    """(digest, ids) of contents that are equal, told by SHA-256."""
    e = model.entity(entity)
    rows = tables(e.table).select(F.col(f"`{e.id.column}`").alias("id"), F.sha2(_content(model, e, attribute), 256).alias("digest"))
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
