"""A start entity and the entities that its paths reach, joined into one DataFrame.

A path's relations become joins: inner by default (only rows where the relation is
set), left with :OUTER. Each prefix of a path is joined once, whoever asks for it first
says how, and stands under an alias of its own, so that an entity may be
reached on several ways. Columns get names made of the alias and a number: names of
the model, which tell upper from lower case, never meet Spark's resolver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BadSyntax, QueryError, UnknownAttribute
from ..model import Attribute, Entity, Model, Relation


@dataclass
class Node:
    entity: Entity
    alias: str
    prefix: tuple[str, ...]
    columns: dict[str, str]
    #: The node that this one is a parent of, if a to-one relation leads here.
    to_one_of: Node | None = None

    def col(self, name: str) -> Column:
        return F.col(self.columns[name])


@dataclass
class Target:
    """What a path ends at."""

    column: Column
    datatype: str
    node: Node
    attribute: Attribute | None = None
    relation: Relation | None = None

    @property
    def name(self) -> str:
        return (self.attribute or self.relation).name

    @property
    def where(self) -> tuple:
        """What tells one column from another."""
        return (self.node.prefix, (self.relation or self.attribute).name)


def split_path(path: str) -> list[tuple[str, bool]]:
    """(name, whether it is an outer join) of each part."""
    parts = []
    for part in path.split("."):
        name, _, flag = part.partition(":")
        if not name or (flag and flag != "OUTER"):
            raise BadSyntax(f"{path!r} is no path")
        parts.append((name, flag == "OUTER"))
    return parts


class Joined:
    def __init__(self, model: Model, table, entity: Entity):
        """table: a function from an entity's table name to its DataFrame."""
        self.model, self.table = model, table
        self.nodes: dict[tuple[str, ...], Node] = {}
        self.root, self.df = self._node(entity, ())

    def _node(self, entity: Entity, prefix: tuple[str, ...]) -> tuple[Node, DataFrame]:
        source, alias = self.table(entity.table), f"n{len(self.nodes)}"
        there = set(source.columns)
        columns, selected = {}, []
        fields = [(a.name, a.column) for a in entity.attributes.values()] + [(r.name, r.column) for r in entity.relations.values() if r.column]
        for k, (name, column) in enumerate(fields):
            columns[name] = f"{alias}_{k}"
            selected.append((F.col(f"`{column}`") if column in there else F.lit(None)).alias(columns[name]))
        node = Node(entity, alias, prefix, columns)
        self.nodes[prefix] = node
        return node, source.select(*selected)

    def step(self, node: Node, relation: Relation, outer: bool) -> Node:
        """The node that a relation leads to; joined if it is not yet."""
        prefix = (*node.prefix, relation.name)
        if prefix in self.nodes:
            return self.nodes[prefix]
        target = self.model.entity(relation.target)
        new, df = self._node(target, prefix)
        how = "left" if outer else "inner"
        if relation.column:
            new.to_one_of = node
            self.df = self.df.join(df, node.col(relation.name) == new.col(self._id(target)), how)
        elif relation.bridge:
            name, own, other = relation.bridge
            bridge = self.table(name).select(F.col(f"`{own}`").alias(f"{new.alias}_from"), F.col(f"`{other}`").alias(f"{new.alias}_to"))
            # The far side first, so that an outer join keeps the near side's rows alone.
            both = bridge.join(df, F.col(f"{new.alias}_to") == new.col(self._id(target)))
            self.df = self.df.join(both, node.col(self._id(node.entity)) == F.col(f"{new.alias}_from"), how)
        else:
            back = self.model.inverse(node.entity, relation)
            self.df = self.df.join(df, node.col(self._id(node.entity)) == new.col(back.name), how)
            if relation.max == 1:
                new.to_one_of = node
        return new

    def _id(self, entity: Entity) -> str:
        if entity.id is None:
            raise QueryError(f"{entity.name} has no id")
        return entity.id.name

    def resolve(self, path: str) -> Target:
        """A path's last part, an attribute or else a relation; relations before it are joined.

        A relation at the end stands for the id it holds. The id behind a to-one relation is
        taken from the foreign key, without a join, where the model trusts the key.
        """
        parts = split_path(path)
        node = self.root
        for k, (name, outer) in enumerate(parts[:-1]):
            relation = self.model.relation(node.entity, name)
            if k == len(parts) - 2 and relation.column and relation.trusted and (*node.prefix, relation.name) not in self.nodes:
                last = self.model.entity(relation.target).attribute(parts[-1][0])
                if last is not None and last.base == "id":
                    key = node.col(relation.name)
                    if not outer:
                        self.df = self.df.where(key.isNotNull())
                    return Target(key, last.datatype, node, attribute=last, relation=relation)
            node = self.step(node, relation, outer)
        name = parts[-1][0]
        if attribute := node.entity.attribute(name):
            return Target(node.col(attribute.name), attribute.datatype, node, attribute=attribute)
        relation = node.entity.relation(name)
        if relation is None:
            raise UnknownAttribute(f"{node.entity.name} has neither an attribute nor a relation {name}")
        if relation.column:
            return Target(node.col(relation.name), "DT_ID", node, relation=relation)
        return Target(F.lit(None), "DS_ID", node, relation=relation)

    def related_ids(self, target: Target) -> Column:
        """The ids that a to-many relation holds, as a sorted array; [] if there are none.

        The children are grouped by parent before the join, so that rows do not multiply.
        """
        node, relation = target.node, target.relation
        child, name = self.model.entity(relation.target), f"{node.alias}_ids_{list(node.entity.relations).index(relation.name)}"
        if name not in self.df.columns:
            if relation.bridge:
                table, own, other = relation.bridge
                pairs = self.table(table).select(F.col(f"`{own}`").alias(f"{name}_of"), F.col(f"`{other}`").alias("x"))
            else:
                key = self.model.inverse(node.entity, relation).column
                pairs = self.table(child.table).select(F.col(f"`{key}`").alias(f"{name}_of"), F.col(f"`{child.id.column}`").alias("x"))
            grouped = pairs.groupBy(f"{name}_of").agg(F.sort_array(F.collect_list("x")).alias(name))
            self.df = self.df.join(grouped, node.col(self._id(node.entity)) == F.col(f"{name}_of"), "left")
        return F.coalesce(F.col(name), F.array().cast("array<bigint>"))
