"""Changes of instances, and transactions.

A change is a DataFrame: the table as it will be. A transaction collects such tables;
a commit writes each as a new snapshot beside the old ones and then moves the pointer
file that says which snapshot is current, so readers see all of it or nothing
of it and no path that is read is written over.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import types
from ..errors import ConstraintError, QueryError, TransactionActive, TransactionNotActive
from ..functions import bulk
from ..model import Entity, Model, Relation
from ..sources.tables import Tables


def rows_of(spark: SparkSession, model: Model, entity: Entity, columns: dict[str, list]) -> DataFrame:
    """Instances from a matrix {attribute or to-one relation: values}, typed as the model says."""
    sizes = {len(v) for v in columns.values()}
    if len(sizes) > 1:
        raise QueryError("the columns of a matrix have one length")
    names, fields = [], []
    for name in columns:
        attribute, relation = entity.attribute(name), entity.relation(name)
        if attribute is None and (relation is None or not relation.column):
            raise QueryError(f"{entity.name} has no attribute {name}")
        names.append((attribute or relation).column)
        fields.append((types.spark_type(attribute.datatype) if attribute else types.spark_type("DT_ID"), attribute))

    def typed(value, attribute):
        if value is None or attribute is None:
            return value
        if types.scalar_of(attribute.datatype) == "DT_ENUM":
            return [model.enum_index(attribute, v) for v in value] if types.is_sequence(attribute.datatype) else model.enum_index(attribute, value)
        if attribute.datatype in ("DT_UNKNOWN", "DT_BLOB"):
            return value
        return types.coerce_list(attribute.datatype, value) if types.is_sequence(attribute.datatype) else types.coerce(attribute.datatype, value)

    values = [[typed(v, a) for v in column] for column, (_, a) in zip(columns.values(), fields)]
    schema = types.T.StructType([types.T.StructField(n, t) for n, (t, _) in zip(names, fields)])
    return spark.createDataFrame([tuple(r) for r in zip(*values)], schema)


def _like(table: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with the columns and types of table where it has them."""
    kinds = dict(table.dtypes)
    return rows.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in rows.columns])


def check(model: Model, entity: Entity, table: DataFrame) -> None:
    """Raises where an obligatory attribute is null or a unique one repeats.

    One aggregate looks for nulls in all obligatory attributes, one grouped pass for each unique
    one at its repeats; of these a row reaches the driver at most.
    """
    there = set(table.columns)
    for a in entity.attributes.values():
        if a.obligatory and a.column not in there:
            raise ConstraintError(f"{entity.name}.{a.name} is obligatory")
    obligatory = [a for a in entity.attributes.values() if a.obligatory]
    if obligatory:
        nulls = table.agg(*[F.count_if(F.col(f"`{a.column}`").isNull()) for a in obligatory]).first()
        for a, n in zip(obligatory, nulls):
            if n:
                raise ConstraintError(f"{entity.name}.{a.name} is obligatory")
    for a in entity.attributes.values():
        if a.unique and a.column in there and not table.where(F.col(f"`{a.column}`").isNotNull()).groupBy(f"`{a.column}`").count().where("count > 1").isEmpty():
            raise ConstraintError(f"{entity.name}.{a.name} is unique")


def inserted(model: Model, entity: Entity, table: DataFrame, rows: DataFrame) -> DataFrame:
    """table with rows added; columns that either lacks are null."""
    return table.unionByName(_like(table, rows), allowMissingColumns=True)


def updated(model: Model, entity: Entity, table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """table with the given columns of the rows of equal key replaced; other rows and columns stay.

    A key that rows name twice is an error: which of the two holds?
    """
    column = model.attribute(entity, key).column
    rows = _like(table, rows)
    if not rows.groupBy(f"`{column}`").count().where("count > 1").isEmpty():
        raise QueryError(f"a change names {entity.name}.{key} twice")
    changed = [c for c in rows.columns if c != column]
    new = rows.select(F.col(f"`{column}`").alias("__key"), F.lit(True).alias("__hit"), *[F.col(f"`{c}`").alias(f"__new_{k}") for k, c in enumerate(changed)])
    joined = table.join(new, F.col(f"`{column}`") == F.col("__key"), "left")
    at = {c: k for k, c in enumerate(changed)}
    columns = list(table.columns) + [c for c in changed if c not in table.columns]
    old = lambda c: F.col(f"`{c}`") if c in table.columns else F.lit(None)
    return joined.select(*[(F.when(F.col("__hit"), F.col(f"__new_{at[c]}")).otherwise(old(c)) if c in at else F.col(f"`{c}`")).alias(c) for c in columns])


def deleted(model: Model, entity: Entity, table: DataFrame, ids: DataFrame) -> DataFrame:
    """table without the rows whose id is in the one column of ids."""
    return table.join(ids.toDF("__key"), F.col(f"`{entity.id.column}`") == F.col("__key"), "left_anti")


def cut(df: DataFrame) -> DataFrame:
    """A small df's checkpoint in the folder that the cluster names; a local session without one gets a folder of its own."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise QueryError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="tessella-"))
    return df.checkpoint()


def below_itself(model: Model, tables: Tables, entity: Entity, relation: Relation, ids: DataFrame) -> DataFrame:
    """ids and those of all instances below them by a relation of an entity to itself, level by level."""
    key = model.inverse(entity, relation).column
    pairs = tables(entity.table).select(F.col(f"`{entity.id.column}`").alias("id"), F.col(f"`{key}`").alias("__up"))
    found = last = cut(ids.toDF("id").distinct())
    while not last.isEmpty():
        last = cut(pairs.join(last.withColumnRenamed("id", "__of"), F.col("__up") == F.col("__of"), "left_semi").select("id").distinct().join(found, "id", "left_anti"))
        found = cut(found.union(last))
    return found


def children(model: Model, tables: Tables, entity: Entity, ids: DataFrame) -> dict[str, DataFrame]:
    """For each entity below: the ids of the instances that a removal of ids takes along, by name.

    Children that are instances of the entity itself are followed level by level.
    """
    out: dict[str, DataFrame] = {}
    for r in entity.relations.values():
        if r.kind == "FATHER_CHILD" and not r.column and not r.bridge and r.target == entity.name and entity.id is not None:
            all_ids = below_itself(model, tables, entity, r, ids)
            out[entity.name] = all_ids.join(ids.toDF("id"), "id", "left_anti")
            ids = all_ids
    for r in entity.relations.values():
        other = model.entities[r.target]
        if r.kind == "FATHER_CHILD" and not r.column and not r.bridge and other.id is not None and other.name != entity.name:
            key = model.inverse(entity, r).column
            below = tables(other.table).join(ids.toDF("__up"), F.col(f"`{key}`") == F.col("__up"), "left_semi").select(F.col(f"`{other.id.column}`").alias("id"))
            for name, more in [(other.name, below), *children(model, tables, other, below).items()]:
                out[name] = out[name].union(more) if name in out else more
    return out


def related(model: Model, tables: Tables, entity: Entity, relation: str, id: int, others: list[int], mode: str) -> tuple[str, DataFrame]:
    """(table, rows) after others were tied to an instance by a relation: INSERT adds, REMOVE unties, UPDATE replaces all."""
    r = model.relation(entity, relation)
    if mode not in ("INSERT", "UPDATE", "REMOVE"):
        raise QueryError(f"unknown mode {mode}")
    if r.bridge:
        name, own, other = r.bridge
        table = tables(name)
        mine, listed = F.col(f"`{own}`") == id, F.col(f"`{other}`").isin(others)
        kinds = dict(table.dtypes)
        new = tables.spark.createDataFrame([(id, x) for x in others], f"`{own}` long, `{other}` long")
        new = new.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in (own, other)])
        rest = table.where(~mine) if mode == "UPDATE" else table.where(~(mine & listed))
        return name, rest if mode == "REMOVE" else rest.unionByName(new, allowMissingColumns=True)
    if r.column:
        # To one: the key of this instance.
        table, kind = tables(entity.table), dict(tables(entity.table).dtypes)[r.column]
        value = F.lit(None) if mode == "REMOVE" or not others else F.lit(others[-1])
        mine = F.col(f"`{entity.id.column}`") == id
        if mode == "REMOVE" and others:
            mine = mine & F.col(f"`{r.column}`").isin(others)
        return entity.table, table.withColumn(r.column, F.when(mine, value.cast(kind)).otherwise(F.col(f"`{r.column}`")))
    other = model.entities[r.target]
    key, table = model.inverse(entity, r).column, tables(other.table)
    kind, mine = dict(table.dtypes)[key], F.col(f"`{key}`") == id
    listed = F.col(f"`{other.id.column}`").isin(others) if others else F.lit(False)
    gone = mine & listed if mode == "REMOVE" else mine & ~listed if mode == "UPDATE" else F.lit(False)
    column = F.when(gone, F.lit(None).cast(kind))
    if mode != "REMOVE":
        column = column.when(listed, F.lit(id).cast(kind))
    return other.table, table.withColumn(key, column.otherwise(F.col(f"`{key}`")))


def vector_written(model: Model, entity: Entity, table: DataFrame, id: int, attribute: str, values: list, start: int, mode: str) -> DataFrame:
    """table with values written into one instance's array, at a position from 0."""
    a = model.attribute(entity, attribute)
    kind = types.spark_type(a.datatype)
    own = dict(table.dtypes)[a.column]
    new = F.array(*[F.lit(v) for v in values]).cast(kind).cast(own) if values else F.array().cast(own)
    mine, old = F.col(f"`{entity.id.column}`") == id, F.coalesce(F.col(f"`{a.column}`"), F.array().cast(own))
    return table.withColumn(a.column, F.when(mine, bulk.written(old, new, F.lit(start), mode)).otherwise(F.col(f"`{a.column}`")))


def point_removed(model: Model, entity: Entity, table: DataFrame, parent: str, id: int, attribute: str, at: int, count: int = 1) -> DataFrame:
    """table with positions at to at + count cut out of the arrays of all instances of one parent."""
    a, key = model.attribute(entity, attribute), model.relation(entity, parent).column
    old = F.col(f"`{a.column}`")
    rest = F.concat(F.slice(old, 1, at), F.slice(old, at + count + 1, F.greatest(F.size(old) - at - count, F.lit(0)))) if at else F.slice(old, count + 1, F.greatest(F.size(old) - count, F.lit(0)))
    return table.withColumn(a.column, F.when(F.col(f"`{key}`") == id, rest).otherwise(old))


class Snapshots:
    """Tables as snapshots below one folder; the file _current says which snapshot of each table holds."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        fs, folder = self._fs(), self._path("_pointers")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return [int(n) for n in names if n.isdigit()]

    def version(self) -> tuple[int, dict[str, str]]:
        """The newest pointer that was written whole: its number (-1: none) and what it says."""
        for n in sorted(self._numbers(), reverse=True):
            rows = self.spark.read.text(f"{self.root}/_pointers/{n:012d}", wholetext=True).collect()
            try:
                return n, json.loads(rows[0][0])
            except (IndexError, ValueError):
                continue  # a commit that is being written, or broke off
        return -1, {}

    def current(self) -> dict[str, str]:
        return self.version()[1]

    def tables(self, base: Tables) -> Tables:
        """base with the snapshots in place of its tables."""
        return base.with_tables({name: self.spark.read.parquet(f"{self.root}/{path}") for name, path in self.current().items()})

    def write(self, changed: dict[str, DataFrame]) -> dict[str, str]:
        """New snapshots of tables, which nothing points to yet: their paths by table."""
        mark = uuid.uuid4().hex
        for name, df in changed.items():
            df.write.parquet(f"{self.root}/{name}/{mark}")
        return {name: f"{name}/{mark}" for name in changed}

    def read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{path}")

    def drop(self, written: dict[str, str]) -> None:
        for path in written.values():
            self._fs().delete(self._path(path), True)

    def point(self, written: dict[str, str], before: dict[str, str], version: int) -> None:
        """Makes written current, if no other commit came since before was read as a version.

        The pointer of the next number is created, and never overwritten: where two commits try, one fails.
        That holds on HDFS, on local disks, and on object stores whose connector creates files
        exclusively; on others one writer at a time is safe.
        """
        fs = self._fs()
        fs.mkdirs(self._path("_pointers"))
        try:
            out = fs.create(self._path(f"_pointers/{version + 1:012d}"), False)
        except Py4JJavaError as e:
            raise QueryError("another commit came first") from e
        out.write(bytearray(json.dumps(before | written).encode()))
        out.close()

    def commit(self, changed: dict[str, DataFrame], checked=None) -> None:
        """Writes tables and makes them current. checked: is called with each as it was written, and may raise."""
        version, before = self.version()
        if version != max([-1, *self._numbers()]):
            raise QueryError("another commit is on its way; if it broke off, remove its empty pointer")
        written = self.write(changed)
        try:
            for name, path in written.items():
                if checked is not None:
                    checked(name, self.read(path))
            self.point(written, before, version)
        except Exception:
            self.drop(written)
            raise


class Changes:
    """Changes of a store with one transaction at a time; without one, each change is committed by itself."""

    def __init__(self, model: Model, base: Tables, snapshots: Snapshots):
        self.model, self.base, self.snapshots = model, base, snapshots
        self.open: dict[str, DataFrame] | None = None

    def tables(self) -> Tables:
        """What queries read: the committed tables, and in a transaction its own changes."""
        tables = self.snapshots.tables(self.base)
        return tables.with_tables(self.open) if self.open else tables

    def start(self) -> None:
        if self.open is not None:
            raise TransactionActive("a transaction is active")
        self.open = {}

    def commit(self) -> None:
        if self.open is None:
            raise TransactionNotActive("no transaction is active")
        if self.open:
            self.snapshots.commit(self.open)
        self.open = None

    def abort(self) -> None:
        if self.open is None:
            raise TransactionNotActive("no transaction is active")
        self.open = None

    def _put(self, changed: dict[str, DataFrame], checked=None) -> None:
        if self.open is None:
            self.snapshots.commit(changed, checked)
        else:
            for name, table in changed.items() if checked is not None else ():
                checked(name, table)
            self.open |= changed

    def _checked(self, entity: Entity, table: DataFrame) -> None:
        """Outside a transaction it is the written snapshot that is checked, so that the table is made once."""
        self._put({entity.table: table}, lambda _, t: check(self.model, entity, t))

    def insert(self, name: str, columns: dict[str, list]) -> None:
        e = self.model.entity(name)
        self._checked(e, inserted(self.model, e, self.tables()(e.table), rows_of(self.base.spark, self.model, e, columns)))

    def update(self, name: str, columns: dict[str, list]) -> None:
        e = self.model.entity(name)
        self._checked(e, updated(self.model, e, self.tables()(e.table), rows_of(self.base.spark, self.model, e, columns)))

    def delete(self, name: str, ids: list[int], recursive: bool = False) -> None:
        e, tables = self.model.entity(name), self.tables()
        gone = self.base.spark.createDataFrame([(x,) for x in ids], "id long")
        changed = {e.table: deleted(self.model, e, tables(e.table), gone)}
        for child, more in (children(self.model, tables, e, gone) if recursive else {}).items():
            other = self.model.entities[child]
            changed[other.table] = deleted(self.model, other, changed.get(other.table, tables(other.table)), more)
        self._put(changed)

    def relate(self, name: str, relation: str, id: int, others: list[int], mode: str = "INSERT") -> None:
        table, rows = related(self.model, self.tables(), self.model.entity(name), relation, id, others, mode)
        self._put({table: rows})

    def write_vector(self, name: str, id: int, attribute: str, values: list, start: int = 0, mode: str = "UPDATE") -> None:
        e = self.model.entity(name)
        self._put({e.table: vector_written(self.model, e, self.tables()(e.table), id, attribute, values, start, mode)})

    def remove_point(self, name: str, parent: str, id: int, attribute: str, at: int, count: int = 1) -> None:
        e = self.model.entity(name)
        self._put({e.table: point_removed(self.model, e, self.tables()(e.table), parent, id, attribute, at, count)})

