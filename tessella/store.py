"""A store: a model over tables, asked with queries."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Model
from .operators import matrices
from .plans import listed, nested
from .sources.tables import Tables, importable


class Store:
    def __init__(self, spark: SparkSession, model: Model, tables: Tables):
        self.spark, self.model, self.tables = spark, model, tables

    def query(self, query: dict | str) -> DataFrame:
        """A query's rows, lazily. An object with the key "entity" is a listed query, any other a nested one."""
        if isinstance(query, str):
            query = json.loads(query)
        return (listed if "entity" in query else nested).frame(self.model, self.tables, query)

    def matrices(self, query: dict | str, accept: str = "application/json") -> dict | str:
        """A query's result by entity, in the form that an Accept header asks for."""
        if isinstance(query, str):
            query = json.loads(query)
        skips = {}
        if "entity" in query:
            skips = {"rows": query.get("rowSkipCount", 0), "seqs": query.get("seqSkipCount", 0)}
        else:
            options = query.get("$options", {})
            skips = {"rows": options.get("$rowskip", 0), "seqs": options.get("$seqskip", 0)}
        return matrices.encoded(self.model, self.query(query), accept, **skips)

    def matrix_pages(self, query: dict, keys: list[str], size: int = 10_000, accept: str = "application/json") -> Iterator[dict | str]:
        """The same for a large result, in pages of at most size rows in the order of the keys, which the query puts out.

        What reaches the driver at a time is a few pages (see encoded_pages).
        """
        yield from self.encoded_pages(query, keys, size, accept).toLocalIterator()

    def encoded_pages(self, query: dict, keys: list[str], size: int = 10_000, accept: str = "application/json") -> RDD:
        """These pages where the tasks encoded them: the result is read and sorted once, however many there are."""
        importable(self.spark)
        ordered = {k: v for k, v in query.items() if k != "$orderby"} | {"$orderby": dict.fromkeys(keys, 1)}
        return matrices.pages(self.model, self.query(ordered), size, accept)

    def sql(self, text: str, **parameters) -> DataFrame:
        """An SQL query over the entities, each a view of its application name with its attributes as columns.

        Only entities that the text names become views, and only until the query is analysed; a
        view of the caller's that has such a name holds.
        """
        words = {w.lower() for w in re.findall(r"\w+", text)}
        own = {t.name.lower() for t in self.spark.catalog.listTables() if t.isTemporary}
        views = [e.name for e in self.model.entities.values() if e.name.lower() in words - own]
        for name in views:
            self.entity(name).createTempView(name)
        try:
            return self.spark.sql(text, args=parameters or None)
        finally:
            for name in views:
                self.spark.catalog.dropTempView(name)

    def entity(self, name: str) -> DataFrame:
        """All rows of an entity, columns named as its attributes and to-one relations."""
        e = self.model.entity(name)
        source = self.tables(e.table)
        there = set(source.columns)
        fields = [(a.name, a.column) for a in e.attributes.values()] + [(r.name, r.column) for r in e.relations.values() if r.column]
        return source.select(*[(F.col(f"`{c}`") if c in there else F.lit(None)).alias(n) for n, c in fields])

    def related(self, entity: str, relation: str, ids=None) -> DataFrame:
        """(id, related): the ids of instances that a relation ties to those of an entity."""
        e = self.model.entity(entity)
        r = self.model.relation(e, relation)
        other, key = self.model.entity(r.target), F.col(f"`{e.id.column}`" if e.id else "id")
        if r.column:
            out = self.tables(e.table).select(key.alias("id"), F.col(f"`{r.column}`").alias("related")).where(F.col("related").isNotNull())
        elif r.bridge:
            out = self.tables(r.bridge[0]).select(F.col(f"`{r.bridge[1]}`").alias("id"), F.col(f"`{r.bridge[2]}`").alias("related"))
        else:
            back = self.model.inverse(e, r)
            out = self.tables(other.table).select(F.col(f"`{back.column}`").alias("id"), F.col(f"`{other.id.column}`").alias("related"))
        return out if ids is None else out.where(F.col("id").isin(list(ids)))

    def instances(self, entity: str, pattern: str = "*") -> DataFrame:
        """The rows of an entity whose name matches a pattern with wildcards."""
        return self.query({entity: {"name": {"$like": pattern}}})

    def page(self, query: dict, keys: list[str], last: list | None, size: int) -> DataFrame:
        """The next rows after those whose keys were last, in the order of the keys (all ascending, unique together).

        A page filters by key where an offset would read all before it again.
        """
        query = {k: v for k, v in query.items() if k != "$orderby"} | {"$orderby": dict.fromkeys(keys, 1)}
        if last is not None:
            entity = next(k for k in query if not k.startswith("$"))
            after = [{k: v for k, v in zip(keys[:n], last)} | {keys[n]: {"$gt": last[n]}} for n in range(len(keys))]
            condition = query[entity] if isinstance(query[entity], dict) else {"id": query[entity]}
            both = [c for c in (condition, {"$or": after}) if c]
            query = query | {entity: {"$and": both}}
        return self.query(query | {"$options": query.get("$options", {}) | {"$rowlimit": size}})
