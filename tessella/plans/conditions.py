"""Comparisons of an attribute with literals, as boolean columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import types
from ..errors import BadSyntax, BadValue
from ..functions.text import matches
from .joined import Joined, Target

#: Operators, and those that have a form that ignores case.
OPERATORS = ("$eq", "$neq", "$lt", "$gt", "$lte", "$gte", "$in", "$notinset", "$notin", "$like", "$notlike", "$null", "$notnull", "$between")
IGNORES_CASE = ("$eq", "$neq", "$lt", "$gt", "$lte", "$gte", "$in", "$notinset", "$notin", "$like", "$notlike")


@dataclass
class Comparer:
    """Builds comparisons; remembers those of bulk values for queries of their positions."""

    joined: Joined

    def __post_init__(self):
        self.bulk: dict[tuple, list[Callable[[Column], Column]]] = {}

    def target(self, path: str) -> Target:
        """The column a condition is about. A to-many relation stands for the ids of what it leads to."""
        found = self.joined.resolve(path)
        if found.relation is not None and found.attribute is None and not found.relation.column:
            node = self.joined.step(found.node, found.relation, False)
            key = node.entity.id
            return Target(node.col(key.name), key.datatype, node, attribute=key)
        return found

    def literal(self, target: Target, value, unit: int):
        """A typed value in the attribute's own unit, so that the column needs no cast."""
        code, attribute = types.scalar_of(target.datatype), target.attribute
        if code == "DT_ENUM" and attribute is not None:
            return self.joined.model.enum_index(attribute, value)
        out = types.coerce(code, value)
        if unit and attribute is not None and attribute.unit and unit != attribute.unit:
            factor, offset = self.joined.model.conversion(unit, attribute.unit)
            out = out * factor + offset
        return out

    def constant(self, target: Target, value, unit: int) -> Column:
        out = self.literal(target, value, unit)
        kind = types.SCALARS.get(types.scalar_of(target.datatype))
        if isinstance(out, dict):
            return F.struct(*[F.lit(v).cast(kind[k].dataType).alias(k) for k, v in out.items()])
        # A conversion may leave the integers.
        return F.lit(out) if isinstance(out, float) else F.lit(out).cast(kind)

    def compare(self, path: str, op: str, value, options: str = "", unit: int = 0) -> Column:
        target = self.target(path)
        if op == "$null":
            return target.column.isNull()
        if op == "$notnull":
            return target.column.isNotNull()
        if isinstance(value, dict):
            raise BadSyntax(f"{op} takes a value or a list, no object")
        if types.is_sequence(target.datatype) and not (op in ("$eq", "$neq") and isinstance(value, list)):
            # Of bulk data a condition is about the single values: rows with one that meets it.
            test = self.test(target, op, value, options, unit)
            self.bulk.setdefault((target.node.prefix, target.name), []).append(test)
            return F.exists(target.column, test)
        return self.test(target, op, value, options, unit)(target.column)

    def test(self, target: Target, op: str, value, options: str, unit: int) -> Callable[[Column], Column]:
        fold = "i" in options and types.is_string(target.datatype) and op in IGNORES_CASE
        low = (lambda c: F.lower(c)) if fold else (lambda c: c)
        if op in ("$in", "$notin", "$notinset"):
            if not isinstance(value, list):
                raise BadSyntax(f"{op} takes a list")
            values = [self.constant(target, v, unit) for v in self._grouped(target, value)]
            return (lambda c: low(c).isin(*map(low, values))) if op == "$in" else (lambda c: ~low(c).isin(*map(low, values)))
        if op == "$between":
            if not isinstance(value, list) or len(value) != 2:
                raise BadSyntax("$between takes two values")
            a, b = (self.constant(target, v, unit) for v in value)
            return lambda c: (c >= a) & (c < b)
        if op in ("$like", "$notlike"):
            pattern = types.coerce("DT_STRING", value)
            return lambda c: matches(c, pattern, fold) if op == "$like" else ~matches(c, pattern, fold)
        if isinstance(value, list):
            if types.is_sequence(target.datatype):
                whole = F.array(*[self.constant(target, v, unit) for v in self._grouped(target, value)])
                return lambda c: c == whole if op == "$eq" else c != whole
            if types.scalar_of(target.datatype) not in ("DT_COMPLEX", "DT_DCOMPLEX", "DT_EXTERNALREFERENCE"):
                if op == "$eq":
                    return self.test(target, "$in", value, options, unit)
                raise BadValue(f"{op} takes one value")
        right = low(self.constant(target, value, unit))
        return {
            "$eq": lambda c: low(c) == right,
            "$neq": lambda c: low(c) != right,
            "$lt": lambda c: low(c) < right,
            "$gt": lambda c: low(c) > right,
            "$lte": lambda c: low(c) <= right,
            "$gte": lambda c: low(c) >= right,
        }[op]

    @staticmethod
    def _grouped(target: Target, values: list) -> list:
        """Complex numbers and references of a flat list by twos and threes."""
        width = {"DT_COMPLEX": 2, "DT_DCOMPLEX": 2, "DT_EXTERNALREFERENCE": 3}.get(types.scalar_of(target.datatype), 1)
        if width == 1 or (values and isinstance(values[0], (list, tuple))):
            return values
        return [values[k : k + width] for k in range(0, len(values), width)]
