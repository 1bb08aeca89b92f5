"""Results by entity: every entity that a query puts out becomes a matrix of columns.

encoded() collects, as it writes one answer for one client: page the query, or
limit it, to bound what comes. pages() encodes a result of any size in its tasks.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterable, Iterator
from html import escape
from itertools import accumulate, islice

from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .. import types
from ..errors import QueryError
from ..model import Model

#: Fields of the plain form by type, and of the typed form.
PLAIN = {"DT_STRING": "str", "DT_BYTESTR": "byteStr", "DT_DATE": "date", "DT_BOOLEAN": "bool", "DT_EXTERNALREFERENCE": "extRef", "DT_BLOB": "str"}
TYPED = {
    "DT_STRING": "String", "DT_SHORT": "Long", "DT_FLOAT": "Float", "DT_BOOLEAN": "Boolean", "DT_BYTE": "Byte", "DT_LONG": "Long", "DT_DOUBLE": "Double",
    "DT_LONGLONG": "Longlong", "DT_ID": "Longlong", "DT_DATE": "Date", "DT_BYTESTR": "Bytestr", "DT_COMPLEX": "Float", "DT_DCOMPLEX": "Double",
    "DT_ENUM": "Long", "DT_EXTERNALREFERENCE": "String", "DT_BLOB": "String",
}
FORMS = {"application/json": "plain", "application/x-protobuf-json": "typed", "text/html": "html", "*/*": "plain"}


def form_of(accept: str) -> str:
    """The form that an Accept header likes best."""
    liked = []
    for k, part in enumerate(accept.split(",")):
        kind, *parameters = [x.strip() for x in part.split(";")]
        q = next((float(p[2:]) for p in parameters if p.startswith("q=")), 1.0)
        if kind in FORMS and q > 0:
            liked.append((-q, k, FORMS[kind]))
    if not liked:
        raise QueryError(f"none of {accept} can be written")
    return min(liked)[2]


def plain_field(datatype: str) -> str:
    """numVal, strVal, dateVal and so on; with Seq for sequences, unknownSeq for values that say their type."""
    if datatype == "DT_UNKNOWN":
        return "unknownSeq"
    return PLAIN.get(types.scalar_of(datatype), "num") + ("Seq" if types.is_sequence(datatype) else "Val")


def typed_field(datatype: str) -> str:
    if datatype == "DT_UNKNOWN":
        return "dtUnknown"
    return ("ds" if types.is_sequence(datatype) else "dt") + TYPED[types.scalar_of(datatype)]


def _value(value, datatype: str):
    """A value as JSON holds it; dates compact, complex numbers and references flat."""
    if value is None:
        return None
    if isinstance(value, list):
        flat = [_value(v, datatype) for v in value]
        if types.scalar_of(datatype) in ("DT_COMPLEX", "DT_DCOMPLEX", "DT_EXTERNALREFERENCE"):
            return [x for v in flat for x in (v or [])]
        return flat
    if isinstance(value, datetime.datetime):
        text = value.strftime("%Y%m%d%H%M%S%f")
        return text[:14] + text[14:].rstrip("0")
    if isinstance(value, (bytes, bytearray)):
        return value.hex()
    if hasattr(value, "asDict"):
        return [_value(v, datatype) for v in value.asDict().values()]
    return value


def _unknown(value) -> tuple[str, list] | None:
    if value is None:
        return None
    row = value.asDict()
    arm = types.ARM.get(row["datatype"])
    return row["datatype"], _value(row.get(arm) or [], "DT_STRING") if arm else []


def _columns(schema: StructType, rows: list):
    for k, f in enumerate(schema.fields):
        meta = f.metadata or {"entity": "", "name": f.name, "base": "", "aggregate": "NONE", "datatype": types.code_of(f.dataType), "relation": False}
        values = [r[k] for r in rows]
        if meta["relation"] and not types.is_sequence(meta["datatype"]):
            values = [v or None for v in values]  # a relation to 0 is none
        yield meta, values


def _entities(schema: StructType, found: list) -> dict[str, list]:
    out: dict[str, list] = {}
    for meta, values in _columns(schema, found):
        out.setdefault(meta["entity"], []).append((meta, values))
    return out


def plain(model: Model, schema: StructType, found: list, rows: int = 0, seqs: int = 0) -> dict:
    """{"matrices": [...]} with numVal, strSeq and so on. A missing value is null, a missing sequence []."""
    matrices = []
    for name, columns in _entities(schema, found).items():
        entity = model.entities.get(name)
        out = []
        for meta, values in columns:
            datatype = meta["datatype"]
            if datatype == "DT_UNKNOWN":
                pairs = [_unknown(v) for v in values]
                written = [p and {"dataType": p[0], plain_field(types.sequence_of(p[0])): p[1]} for p in pairs]
            else:
                written = [([] if types.is_sequence(datatype) else None) if v is None else _value(v, datatype) for v in values]
            shown = "DT_LONGLONG" if meta["relation"] and not types.is_sequence(datatype) else datatype
            out.append({"name": meta["name"], "baseName": meta["base"], "aggregate": meta["aggregate"], "values": {"dataType": shown, plain_field(datatype): written}})
        matrices.append({"name": name, "baseName": entity.base if entity else "", "rowSkipCount": rows, "seqSkipCount": seqs, "columns": out})
    return {"matrices": matrices}


def typed(model: Model, schema: StructType, found: list, rows: int = 0, seqs: int = 0) -> dict:
    """{"matrices": [...]} with dtString, dsDouble and so on. 64-bit integers are texts; flags say what is valid where something is not."""
    matrices = []

    def written(v, datatype: str):
        v = _value(v, datatype)
        long = types.scalar_of(datatype) in ("DT_LONGLONG", "DT_ID")
        return [str(x) if long and x is not None else x for x in v] if isinstance(v, list) else str(v) if long and v is not None else v

    empty = {"DT_STRING": "", "DT_BOOLEAN": False, "DT_LONGLONG": "0", "DT_ID": "0"}
    for name, columns in _entities(schema, found).items():
        entity = model.entities.get(name)
        out = []
        for meta, values in columns:
            datatype, flags = meta["datatype"], [v is not None for v in values]
            if datatype == "DT_UNKNOWN":
                pairs = [_unknown(v) or ("DT_UNKNOWN", []) for v in values]
                body = [{"datatype": d, typed_field(d): {"values": v}} if d != "DT_UNKNOWN" else {"datatype": d} for d, v in pairs]
            elif types.is_sequence(datatype):
                body = [{"values": [] if v is None else written(v, datatype)} for v in values]
            else:
                body = [empty.get(datatype, 0) if v is None else written(v, datatype) for v in values]
            column = {"name": meta["name"], "baseName": meta["base"], "datatype": datatype, typed_field(datatype): {"values": body}}
            if meta["aggregate"] != "NONE":
                column["aggregate"] = meta["aggregate"]
            out.append(column | ({} if all(flags) else {"flags": flags}))
        matrices.append({"name": name, "baseName": entity.base if entity else "", "objecttype": str(entity.aid) if entity else "0", "columns": out})
    return {"matrices": matrices}


def html(model: Model, schema: StructType, found: list, rows: int = 0, seqs: int = 0) -> str:
    """One table for each entity, a line for each column."""
    out = []
    for matrix in plain(model, schema, found, rows, seqs)["matrices"]:
        lines = []
        for c in matrix["columns"]:
            values = next(v for k, v in c["values"].items() if k != "dataType")
            cells = "".join(f"<td>{escape('' if v is None else json.dumps(v) if isinstance(v, (list, dict)) else str(v))}</td>" for v in values)
            lines.append(f"<tr><th>{escape(c['name'])}</th>{cells}</tr>")
        out.append(f"<table><caption>{escape(matrix['name'])}</caption>{''.join(lines)}</table>")
    return "\n".join(out)


def encoded(model: Model, df: DataFrame, accept: str = "application/json", rows: int = 0, seqs: int = 0):
    return FORM[form_of(accept)](model, df.schema, df.collect(), rows, seqs)


FORM = {"plain": plain, "typed": typed, "html": html}
#: Pages that one task encodes, and that reach the driver at a time where they are read one by one.
TASK_PAGES = 8


def pages(model: Model, df: DataFrame, size: int, accept: str = "application/json") -> RDD:
    """An ordered result, encoded in pages of size rows (the last may have fewer), in order; of no rows, one empty page.

    Tasks cut their part of the order into slices of pages; slices of a page meet in the task that
    encodes it. Workers have to be in the driver's time zone, as dates are written in theirs.
    """
    form, schema, source = FORM[form_of(accept)], df.schema, df.rdd
    starts = [0, *accumulate(source.mapPartitions(lambda part: [sum(1 for _ in part)]).collect())]
    if not starts[-1]:
        return source.context.parallelize([form(model, schema, [])], 1)
    last = (starts[-1] - 1) // size

    def cut(k: int, part: Iterable) -> Iterator:
        part, at = iter(part), starts[k]
        while found := list(islice(part, size - at % size)):
            yield at // size, (at, found)
            at += len(found)

    def encode(part: Iterable) -> Iterator:
        slices: dict[int, list] = {}
        for page, found in part:
            slices.setdefault(page, []).append(found)
        for page in sorted(slices):
            yield form(model, schema, [r for _, found in sorted(slices[page], key=lambda s: s[0]) for r in found])

    return source.mapPartitionsWithIndex(cut).partitionBy(last // TASK_PAGES + 1, lambda page: page // TASK_PAGES).mapPartitions(encode)
