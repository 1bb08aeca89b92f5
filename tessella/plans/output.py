"""What a query puts out: columns, aggregates, groups, order and limits.

Both query forms fill a Selection; rows() turns it and the joined entities into one
lazy DataFrame whose columns carry, as metadata, what they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types
from ..errors import BadSyntax, QueryError
from ..functions import bulk
from .conditions import Comparer
from .joined import Joined, Node, Target

#: Aggregates by their names.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "COUNT": lambda c: F.count(F.lit(1)),
    "DCOUNT": lambda c: F.count_distinct(c),
    "MIN": F.min,
    "MAX": F.max,
    "AVG": F.avg,
    "STDDEV": F.stddev_samp,
    "SUM": F.sum,
}
#: Those that give one value for each row, as no aggregate does.
OTHERS = ("NONE", "DISTINCT", "POINT", "CALCULATED")


@dataclass
class Wanted:
    """One attribute of the output."""

    path: str
    aggregate: str = "NONE"
    unit: int = 0
    options: str = ""

    @property
    def name(self) -> str:
        return self.path if self.aggregate in ("NONE", "DISTINCT", "CALCULATED") else f"{self.aggregate}({self.path})"


@dataclass
class Selection:
    attributes: list[Wanted] = field(default_factory=list)
    order: list[tuple[str, bool]] = field(default_factory=list)
    group: list[str] = field(default_factory=list)
    row_limit: int | None = None
    row_skip: int = 0
    seq_limit: int | None = None
    seq_skip: int = 0


def all_attributes(node: Node) -> list[Wanted]:
    """Every attribute of an entity and the keys of its to-one relations."""
    entity = node.entity
    return [Wanted(n) for n in entity.attributes] + [Wanted(r.name) for r in entity.relations.values() if r.column]


def rows(joined: Joined, comparer: Comparer, selection: Selection) -> DataFrame:
    wanted = selection.attributes or all_attributes(joined.root)
    out = [(w, *_column(joined, comparer, w, selection)) for w in wanted]
    order = [(path, up, joined.resolve(path)) for path, up in selection.order]
    keys = [joined.resolve(path) for path in selection.group]
    names = _unique([w.name for w, _, _ in out])
    if selection.group or any(w.aggregate in AGGREGATES for w in wanted):
        df, order_by = _grouped(joined, out, names, order, keys)
    elif any(w.aggregate == "DISTINCT" for w in wanted):
        df = joined.df.select(*[c.alias(n) for n, (_, _, c) in zip(names, out)]).distinct()
        order_by = [_chosen(path, up, out, names) for path, up, _ in order]
    else:
        # Keys of the order need not be put out: sort first, then select.
        df = joined.df
        if order:
            df = df.orderBy(*[_directed(t.column, up) for _, up, t in order])
        df, order_by = df.select(*[c.alias(n) for n, (_, _, c) in zip(names, out)]), []
    if order_by:
        df = df.orderBy(*order_by)
    if selection.row_skip:
        df = df.offset(selection.row_skip)
    if selection.row_limit is not None:
        df = df.limit(selection.row_limit)
    return df.select(*[F.col(f"`{n}`").alias(n, metadata=_metadata(w, t)) for n, (w, t, _) in zip(names, out)])


def _unique(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}#{seen[n]}")
    return out


def _metadata(w: Wanted, t: Target) -> dict:
    what = t.attribute or t.relation
    datatype = "DT_LONG" if w.aggregate in ("COUNT", "DCOUNT") else "DS_LONG" if w.aggregate == "POINT" else t.datatype
    if "e" in w.options:
        datatype = types.sequence_of("DT_STRING") if types.is_sequence(datatype) else "DT_STRING"
    if "u" in w.options:
        datatype = "DT_UNKNOWN"
    if w.aggregate == "CALCULATED":
        datatype = "DS_DOUBLE"
    relation = t.relation is not None and t.attribute is None
    return {"entity": t.node.entity.name, "name": what.name, "base": what.base, "aggregate": w.aggregate if w.aggregate != "CALCULATED" else "NONE", "datatype": datatype, "relation": relation, "prefix": ".".join(t.node.prefix)}


def _directed(column: Column, up: bool) -> Column:
    return column.asc_nulls_first() if up else column.desc_nulls_last()


def _column(joined: Joined, comparer: Comparer, w: Wanted, selection: Selection) -> tuple[Target, Column]:
    target = joined.resolve(w.path)
    column = target.column
    attribute = target.attribute
    if attribute is None and target.relation is not None and not target.relation.column:
        column = joined.related_ids(target)
    if w.aggregate == "POINT":
        if not types.is_sequence(target.datatype):
            raise QueryError("$point is about bulk data")
        tests = comparer.bulk.get((target.node.prefix, target.name), [])

        def test(v: Column) -> Column:
            out = F.lit(True)
            for t in tests:
                out = out & t(v)
            return out

        return target, bulk.cut(bulk.positions(column, test), selection.seq_skip, selection.seq_limit)
    if w.aggregate == "CALCULATED":
        column = _calculated(joined, target, w.path)
    elif "u" in w.options:
        column = _by_sibling(joined, target, w.path)
    elif "e" in w.options and attribute is not None and attribute.enumeration:
        items = joined.model.enumerations[attribute.enumeration]
        pairs = [x for name, index in items.items() for x in (F.lit(index), F.lit(name))]
        texts = F.create_map(*pairs) if pairs else F.create_map().cast("map<int,string>")
        column = F.transform(column, lambda x: texts[x]) if types.is_sequence(target.datatype) else texts[column]
    if w.unit:
        if attribute is None or types.scalar_of(target.datatype) == "DT_STRING":
            raise QueryError(f"{w.path} has no unit")
        factor, offset = joined.model.conversion(attribute.unit, w.unit)
        if (factor, offset) != (1.0, 0.0):
            column = F.transform(column, lambda v: v * factor + offset) if types.is_sequence(target.datatype) else column * factor + offset
    # Slices are only of what comes out as a sequence.
    if w.aggregate not in AGGREGATES:
        if "u" in w.options or target.datatype == "DT_UNKNOWN":
            column = bulk.cut_unknown(column, selection.seq_skip, selection.seq_limit)
        elif types.is_sequence(target.datatype) or w.aggregate == "CALCULATED":
            column = bulk.cut(column, selection.seq_skip, selection.seq_limit)
    return target, column


def _sibling(joined: Joined, path: str, base: str) -> Target | None:
    front, _, _ = path.rpartition(".")
    entity = joined.resolve(path).node.entity
    if entity.attribute(base) is None:
        return None
    return joined.resolve(f"{front}.{base}" if front else base)


def _calculated(joined: Joined, target: Target, path: str) -> Column:
    parameters, kind, n = (_sibling(joined, path, b) for b in ("generation_parameters", "sequence_representation", "number_of_rows"))
    if parameters is None or kind is None:
        raise QueryError(f"{path} has no generation parameters")
    items = joined.model.enumerations.get(kind.attribute.enumeration, {})
    values = target.column["dbl"] if target.datatype == "DT_UNKNOWN" else target.column
    count = n.column if n is not None else F.size(values)
    return bulk.calculated(values, parameters.column, kind.column, count, items)


def _by_sibling(joined: Joined, target: Target, path: str) -> Column:
    kind = _sibling(joined, path, "parameter_datatype")
    if kind is None or target.datatype != "DT_STRING":
        raise QueryError(f"{path} has no sibling that says its type")
    items = joined.model.enumerations.get(kind.attribute.enumeration, {})
    return bulk.parsed(target.column, kind.column, {index: name for name, index in items.items()} or dict(enumerate(types.CODES)))


def _grouped(joined: Joined, out, names, order, keys) -> tuple[DataFrame, list[Column]]:
    """The groups with their aggregates. An attribute beside them is a key, or follows from a key that is an id."""
    by_name = {k.where: f"k{i}" for i, k in enumerate(keys)}
    of_key = lambda t: by_name.get(t.where)
    known = [k.node for k in keys if k.attribute is not None and k.attribute.base == "id" and k.relation is None]
    known += [joined.nodes[p] for k in keys if k.relation is not None and (p := (*k.node.prefix, k.relation.name)) in joined.nodes]

    def follows(node: Node | None) -> bool:
        while node is not None:
            if node in known:
                return True
            node = node.to_one_of
        return False

    # What follows from a key is one more key: the groups are the same, and aggregation stays hashed.
    grouped, made, final, order_by = [k.column.alias(f"k{i}") for i, k in enumerate(keys)], [], [], []
    for n, (w, target, column) in zip(names, out):
        key = of_key(target)
        if w.aggregate in AGGREGATES:
            made.append(AGGREGATES[w.aggregate](column).alias(n))
        elif key and not w.unit and not w.options:
            final.append(F.col(key).alias(n))
            continue
        elif key or follows(target.node):
            grouped.append(column.alias(n))
        else:
            raise QueryError(f"{w.path} is neither grouped nor aggregated")
        final.append(F.col(f"`{n}`"))
    for i, (path, up, target) in enumerate(order):
        if key := of_key(target):
            order_by.append(_directed(F.col(key), up))
        elif same := [n for n, (w, _, _) in zip(names, out) if w.path == path and w.aggregate in AGGREGATES]:
            order_by.append(_directed(F.col(f"`{same[0]}`"), up))
        elif follows(target.node):
            grouped.append(target.column.alias(f"o{i}"))
            order_by.append(_directed(F.col(f"o{i}"), up))
        else:
            raise QueryError(f"cannot order groups by {path}")
    df = joined.df.groupBy(*grouped)
    df = df.agg(*made) if made else df.agg(F.lit(1).alias("one"))
    if order_by:
        df = df.orderBy(*order_by)
    return df.select(*final), []


def _chosen(path: str, up: bool, out, names) -> Column:
    for n, (w, _, _) in zip(names, out):
        if w.path == path:
            return _directed(F.col(f"`{n}`"), up)
    raise BadSyntax(f"cannot order distinct rows by {path}, which is not put out")
