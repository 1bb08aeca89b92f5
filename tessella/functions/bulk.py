"""Functions of bulk data: channels whose values lie in one array per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import ARM, UNKNOWN, scalar_of

#: Fixed value: the bits of a flag that say that a value is valid.
VALID = 9
ARMS = [f.name for f in UNKNOWN.fields[1:]]


def cut(values: Column, skip: int, limit: int | None) -> Column:
    """The values from skip on, limit at most; [] past the end, null stays null."""
    if not skip and limit is None:
        return values
    return F.slice(values, F.lit(skip + 1), F.greatest(F.size(values) - skip, F.lit(0)) if limit is None else F.lit(limit))


def cut_unknown(value: Column, skip: int, limit: int | None) -> Column:
    """The same for a value whose rows say their type."""
    if not skip and limit is None:
        return value
    fields = [value["datatype"].alias("datatype"), *[cut(value[a], skip, limit).alias(a) for a in ARMS]]
    return F.when(value.isNotNull(), F.struct(*fields))


def is_valid(flag: Column) -> Column:
    return flag.bitwiseAND(F.lit(VALID).cast("smallint")) == VALID


def masked(values: Column, flags: Column) -> Column:
    """values with null where their flag is not valid; values beyond the flags are valid."""
    short = F.coalesce(F.size(flags), F.lit(0))
    checked = F.transform(values, lambda v, k: F.when((k >= short) | is_valid(F.get(flags, k)), v))
    return F.when(short <= 0, values).otherwise(checked)


def positions(values: Column, test: Callable[[Column], Column]) -> Column:
    """Positions, from 0, of the values that pass a test."""
    at = F.transform(values, lambda v, k: F.when(test(v), k))
    return F.filter(at, lambda k: k.isNotNull())


def linear(parameters: Column, n: Column) -> Column:
    """The values of an implicit linear channel: start + k * step for k below n."""
    k = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(k, lambda i: F.get(parameters, F.lit(0)) + i * F.get(parameters, F.lit(1)))


def constant(parameters: Column, n: Column) -> Column:
    return F.array_repeat(F.get(parameters, F.lit(0)), n.cast("int"))


def scaled(values: Column, parameters: Column) -> Column:
    """The values of a raw linear channel: offset + factor * value."""
    return F.transform(values, lambda v: F.get(parameters, F.lit(0)) + F.get(parameters, F.lit(1)) * v)


def calculated(values: Column, parameters: Column, kind: Column, n: Column, items: dict[str, int]) -> Column:
    """The channel's values as they are meant, by its kind of representation.

    kind holds a number of the enumeration items. Explicit values come as they are, linear
    implicit ones from the two parameters, raw linear ones scaled. For others no formula
    is known: a row of such a kind is an error.
    """
    doubles = values.cast("array<double>")
    out = F.when(kind.isNull(), doubles)
    known = {"explicit": doubles, "implicit_constant": constant(parameters, n), "implicit_linear": linear(parameters, n), "raw_linear": scaled(doubles, parameters)}
    for name, column in known.items():
        if name in items:
            out = out.when(kind == items[name], column)
    wrong = F.raise_error(F.concat(F.lit("no formula for sequence representation "), kind.cast("string"))).cast("array<double>")
    return out.otherwise(wrong)


def flattened(values: Column, fields: tuple[str, ...]) -> Column:
    """An array of structs as one array of their fields' values: pairs of complex numbers, triples of references."""
    return F.flatten(F.transform(values, lambda x: F.array(*[x[f] for f in fields])))


def tagged(datatype: str, values: Column) -> Column:
    """An array of a scalar type as a value that says its type."""
    arm = ARM[scalar_of(datatype)]
    fields = [F.lit(datatype).alias("datatype")]
    for f in UNKNOWN.fields[1:]:
        fields.append((values.cast(f.dataType) if f.name == arm else F.lit(None).cast(f.dataType)).alias(f.name))
    return F.struct(*fields).cast(UNKNOWN)


def parsed(text: Column, datatype: Column, codes: dict[int, str]) -> Column:
    """One text as a value of the type that a sibling column names by number; null where it cannot be read."""
    from .text import stored_date

    reads = {
        "str": text,
        "lng": text.try_cast("bigint"),
        "dbl": text.try_cast("double"),
        "bool": text.try_cast("boolean"),
        "ts": F.coalesce(stored_date(text), text.try_cast("timestamp_ntz")),
        "bin": F.encode(text, "utf-8"),
    }
    out = F.lit(None).cast(UNKNOWN)
    for number, code in codes.items():
        if code in ARM:
            out = F.when((datatype == number) & text.isNotNull(), tagged(code, F.array(reads[ARM[code]]))).otherwise(out)
    return out


def written(old: Column, new: Column, start: Column, mode: str) -> Column:
    """old with the values new at position start (from 0): APPEND, INSERT, UPDATE, or REMOVE (as many as new holds).

    An update past the end appends; positions between the end and start become null.
    """
    n = F.size(old)
    front = F.slice(old, 1, F.least(start, n))
    if mode == "APPEND":
        return F.concat(old, new)
    gap = F.array_repeat(F.get(F.slice(old, 1, 0), F.lit(0)), F.greatest(start - n, F.lit(0)))
    if mode == "INSERT":
        return F.concat(front, gap, new, F.slice(old, start + 1, F.greatest(n - start, F.lit(0))))
    if mode == "UPDATE":
        rest = F.slice(old, start + F.size(new) + 1, F.greatest(n - start - F.size(new), F.lit(0)))
        return F.concat(front, gap, new, rest)
    if mode == "REMOVE":
        return F.concat(front, F.slice(old, start + F.size(new) + 1, F.greatest(n - start - F.size(new), F.lit(0))))
    raise ValueError(f"unknown write mode {mode}")
