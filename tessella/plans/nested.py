"""Queries as nested objects: {entity: conditions, "$attributes": ..., "$orderby": ..., ...}."""

from __future__ import annotations

import json
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BadSyntax
from .conditions import OPERATORS, Comparer
from .joined import Joined
from .output import AGGREGATES, OTHERS, Selection, Wanted, rows

#: Keys of an attribute's object that name an aggregate.
AGGREGATE_KEYS = {f"${n.lower()}": n for n in (*AGGREGATES, *OTHERS)}
LIMITS = {"$rowlimit": "row_limit", "$rowskip": "row_skip", "$seqlimit": "seq_limit", "$seqskip": "seq_skip"}


def _below(prefix: str, key: str) -> str:
    return f"{prefix}.{key}" if prefix else key


class Conditions:
    """The condition objects of a query, as one boolean column and semi-joins."""

    def __init__(self, joined: Joined, subquery):
        self.comparer, self.subquery = Comparer(joined), subquery
        self.members: list[tuple[Column, DataFrame, bool]] = []

    def read(self, condition: dict, prefix: str = "", options: str = "", unit: int = 0, top: bool = True) -> Column | None:
        """$options and $unit hold for the whole object and objects of paths in it, not for $and, $or and $not."""
        if not isinstance(condition, dict):
            raise BadSyntax(f"{condition!r} is no condition")
        options, unit = condition.get("$options", options), condition.get("$unit", unit)
        parts: list[Column | None] = []
        for key, value in condition.items():
            if key in ("$options", "$unit"):
                continue
            if key in ("$and", "$or"):
                if not isinstance(value, list) or not value:
                    raise BadSyntax(f"{key} takes a list of conditions")
                each = [self.read(v, prefix, top=top and key == "$and") for v in value]
                each = [F.lit(True) if e is None else e for e in each]
                parts.append(reduce(and_ if key == "$and" else or_, each))
            elif key == "$not":
                inner = self.read(value, prefix, top=False)
                parts.append(~(F.lit(True) if inner is None else inner))
            elif key in OPERATORS:
                if not prefix:
                    raise BadSyntax(f"{key} stands at no attribute")
                if isinstance(value, dict) and key in ("$in", "$notin", "$notinset"):
                    parts.append(self._member(prefix, value, key == "$in", top))
                else:
                    parts.append(self.comparer.compare(prefix, key, value, options, unit))
            elif key.startswith("$"):
                raise BadSyntax(f"unknown operator {key}")
            elif isinstance(value, dict):
                parts.append(self.read(value, _below(prefix, key), options, unit, top))
            else:
                parts.append(self.comparer.compare(_below(prefix, key), "$eq", value, options, unit))
        parts = [p for p in parts if p is not None]
        return reduce(and_, parts) if parts else None

    def _member(self, path: str, query: dict, wanted: bool, top: bool) -> None:
        """Whether a value is one of another query's: a semi- or anti-join after all other conditions."""
        if not top:
            raise BadSyntax("a query stands as a value only in conditions that must all hold")
        target, values = self.comparer.target(path), self.subquery(query)
        if len(values.columns) != 1:
            raise BadSyntax("a query that stands as a value puts out one attribute")
        self.members.append((target.column, values, wanted))

    def apply(self, df: DataFrame, condition: Column | None) -> DataFrame:
        if condition is not None:
            df = df.where(condition)
        for k, (column, values, wanted) in enumerate(self.members):
            values = values.toDF(f"member_{k}").where(F.col(f"member_{k}").isNotNull())
            df = df.join(values, column == F.col(f"member_{k}"), "left_semi" if wanted else "left_anti")
            if not wanted:
                df = df.where(column.isNotNull())
        return df


def _attributes(value: dict, prefix: str = "") -> list[Wanted]:
    if not isinstance(value, dict):
        raise BadSyntax("attributes are an object")
    out: list[Wanted] = []
    unit, options = value.get("$unit", 0), value.get("$options", "")
    named = [k for k in value if k.startswith("$")]
    for key, inner in value.items():
        if isinstance(inner, list):
            raise BadSyntax("attributes hold no lists")
        if key in ("$unit", "$options"):
            continue
        if key.startswith("$"):
            if key not in AGGREGATE_KEYS:
                raise BadSyntax(f"unknown key {key} in attributes")
            if not prefix:
                raise BadSyntax(f"{key} stands at no attribute")
            out.append(Wanted(prefix, AGGREGATE_KEYS[key], unit, options))
        elif isinstance(inner, dict):
            out += _attributes(inner, _below(prefix, key))
        else:
            out.append(Wanted(_below(prefix, key)))
    if prefix and named and not out:
        out.append(Wanted(prefix, "NONE", unit, options))
    return out


def _paths(value: dict, what: str, allowed: tuple, prefix: str = "") -> list[tuple[str, int]]:
    """The paths of an order or group, with their values."""
    if not isinstance(value, dict):
        raise BadSyntax(f"{what} is an object")
    out = []
    for key, inner in value.items():
        if key.startswith("$"):
            raise BadSyntax(f"{what} holds no {key}")
        if isinstance(inner, dict):
            out += _paths(inner, what, allowed, _below(prefix, key))
        elif isinstance(inner, bool) or inner not in allowed:
            raise BadSyntax(f"{what} takes {' or '.join(map(str, allowed))}, not {inner!r}")
        else:
            out.append((_below(prefix, key), inner))
    return out


def read(query: dict | str) -> tuple[str, dict, Selection]:
    """(entity, conditions, selection) of a query, checked for its form."""
    if isinstance(query, str):
        query = json.loads(query)
    if not isinstance(query, dict):
        raise BadSyntax("a query is an object")
    entity, condition, selection = None, None, Selection()
    for key, value in query.items():
        if key == "$attributes":
            selection.attributes = _attributes(value)
        elif key == "$orderby":
            selection.order = [(p, bool(v)) for p, v in _paths(value, "$orderby", (0, 1))]
        elif key == "$groupby":
            selection.group = [p for p, _ in _paths(value, "$groupby", (1,))]
        elif key == "$options":
            for option, n in value.items():
                if option not in LIMITS:
                    raise BadSyntax(f"unknown option {option}")
                if isinstance(n, bool) or not isinstance(n, int) or n < 0:
                    raise BadSyntax(f"{option} takes a number")
                setattr(selection, LIMITS[option], n)
        elif key.startswith("$"):
            raise BadSyntax(f"unknown key {key}")
        elif entity is not None:
            raise BadSyntax("a query has one start entity")
        else:
            entity, condition = key, value
    if entity is None:
        raise BadSyntax("a query has a start entity")
    if isinstance(condition, bool) or not isinstance(condition, (dict, int, str)):
        raise BadSyntax(f"{condition!r} is neither an id nor a condition")
    return entity, condition if isinstance(condition, dict) else {"id": condition}, selection


def frame(model, table, query: dict | str) -> DataFrame:
    """A query's rows. Conditions are resolved before attributes, order and groups: the first says how to join."""
    entity, condition, selection = read(query)
    joined = Joined(model, table, model.entity(entity))
    conditions = Conditions(joined, lambda q: frame(model, table, q))
    where = conditions.read(condition)
    # What comes out joins its paths first; the condition then filters all, and Catalyst pushes it down.
    for path in [w.path for w in selection.attributes] + [p for p, _ in selection.order] + selection.group:
        joined.resolve(path)
    joined.df = conditions.apply(joined.df, where)
    return rows(joined, conditions.comparer, selection)
