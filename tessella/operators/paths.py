"""Paths of instances: /[Entity]name;version/[Entity]name;version, from a top instance to the one meant."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BadSyntax, NotThere, QueryError
from ..model import Entity, Model, Relation
from ..plans.joined import Joined
from ..sources.tables import Tables

#: Fixed value: characters that a backslash takes as themselves in a segment.
SPECIAL = re.compile(r"([\\/\[\];])")
SEGMENT = re.compile(r"\[((?:[^\\\]]|\\.)*)\]((?:[^\\;/]|\\.)*)(?:;((?:[^\\/]|\\.)*))?")
#: Levels of a path. Only where entities lie in entities of their kind is it ever met, and then it is an error, not an end.
MOST_STEPS = 32


def father(entity: Entity) -> Relation | None:
    """The to-one relation to an entity's parent."""
    return next((r for r in entity.relations.values() if r.kind == "FATHER_CHILD" and r.column), None)


def _escaped(column: Column) -> Column:
    return F.regexp_replace(column.cast("string"), r"([\\/\[\];])", r"\\$1")


def created(model: Model, tables: Tables, entity: str, ids=None, most_steps: int = MOST_STEPS) -> DataFrame:
    """(id, path) of an entity's instances; a chain of joins upward, one for each level of the model.

    Where the chain comes back to an entity, levels are added as long as an instance has a parent
    there; one that has more than most_steps levels, or is above itself, is an error.
    """
    joined = Joined(model, tables, model.entity(entity))
    node, parts, seen = joined.root, [], set()
    while True:
        e = node.entity
        name, version = e.attribute("name") or e.id, e.attribute("version")
        text = F.concat(F.lit(f"/[{SPECIAL.sub(r'\\\1', e.name)}]"), _escaped(node.col(name.name)))
        if version is not None:
            text = F.concat(text, F.when(node.col(version.name).isNotNull(), F.concat(F.lit(";"), _escaped(node.col(version.name)))).otherwise(""))
        parts.append(F.when(node.col(e.id.name).isNotNull(), text).otherwise(""))
        up = father(e)
        if up is None or (e.name in seen and joined.df.where(node.col(up.name).isNotNull()).isEmpty()):
            break
        if len(parts) >= most_steps:
            raise QueryError(f"paths of {entity} have more than {most_steps} levels")
        seen.add(e.name)
        node = joined.step(node, up, True)
    key = joined.root.col(joined.root.entity.id.name)
    df = joined.df if ids is None else joined.df.where(key.isin(list(ids)))
    return df.select(key.alias("id"), F.concat(*reversed(parts)).alias("path"))


def parsed(path: str) -> list[tuple[str, str, str | None]]:
    """(entity, name, version) of each segment."""
    at, out = 0, []
    plain = lambda s: re.sub(r"\\(.)", r"\1", s)
    while at < len(path):
        found = SEGMENT.match(path, at + 1) if path[at] == "/" else None
        if not found:
            raise BadSyntax(f"{path!r} is no path of an instance")
        out.append((plain(found[1]), plain(found[2]), None if found[3] is None else plain(found[3])))
        at = found.end()
    if not out:
        raise BadSyntax("an empty path")
    return out


def resolved(model: Model, tables: Tables, path: str) -> DataFrame:
    """(entity, id) of the instances that a path names: filters on the names of the chain from the last segment up."""
    segments = parsed(path)
    joined = Joined(model, tables, model.entity(segments[-1][0]))
    node, condition = joined.root, F.lit(True)
    for k, (name, text, version) in enumerate(reversed(segments)):
        e = node.entity
        if model.entity(name) is not e:
            raise NotThere(f"{e.name} is not below {name}")
        label = e.attribute("name") or e.id
        condition = condition & (node.col(label.name).cast("string") == text)
        if e.attribute("version") is not None:
            own = node.col(e.attribute("version").name)
            condition = condition & (own.isNull() if version is None else own.cast("string") == version)
        if k < len(segments) - 1:
            up = father(e)
            if up is None:
                raise NotThere(f"{e.name} has no parent")
            node = joined.step(node, up, False)
    return joined.df.where(condition).select(F.lit(joined.root.entity.name).alias("entity"), joined.root.col(joined.root.entity.id.name).alias("id"))
