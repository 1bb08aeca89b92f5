"""Queries as lists of texts: conditions like "name = A*", attributes like "MAX(scale)"."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame

from .. import types
from ..errors import BadSyntax
from .conditions import Comparer
from .joined import Joined
from .output import AGGREGATES, OTHERS, Selection, Wanted, all_attributes, rows

#: Limits that hold if a query says none.
ROW_LIMIT, SEQ_LIMIT = 10_000, 50

OUTER = re.compile(r"OUTER\(\s*([^()]+?)\s*\)")
AGGREGATED = re.compile(rf"({'|'.join((*AGGREGATES, *OTHERS))})\(\s*(.*)\s*\)")
DIRECTED = re.compile(r"(ASCENDING|DESCENDING)\(\s*(.*)\s*\)")
CONDITION = re.compile(r"\s*(?P<path>.*?)\s*(?P<op><>|!=|==|<=|>=|=|<|>)\s*(?P<value>.*)", re.S)


def path_of(text: str) -> str:
    """OUTER(relation).name as relation:OUTER.name."""
    return OUTER.sub(r"\1:OUTER", text.strip())


def _attribute(text: str) -> Wanted:
    found = AGGREGATED.fullmatch(text.strip())
    return Wanted(path_of(found[2]), found[1]) if found else Wanted(path_of(text))


def _directed(text: str) -> tuple[str, bool]:
    found = DIRECTED.fullmatch(text.strip())
    return (path_of(found[2]), found[1] == "ASCENDING") if found else (path_of(text), True)


class Tokens:
    """The conditions of a list: brackets, $not before $and before $or; neighbours without a word between are both meant."""

    def __init__(self, comparer: Comparer, tokens: list[str]):
        self.comparer, self.tokens, self.at, self.fold = comparer, tokens, 0, False

    def peek(self) -> str | None:
        while self.at < len(self.tokens) and self.tokens[self.at] in ("$cs", "$ci"):
            self.fold = self.tokens[self.at] == "$ci"
            self.at += 1
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def read(self) -> Column | None:
        if self.peek() is None:
            return None
        out = self.any_of()
        if self.peek() is not None:
            raise BadSyntax(f"unexpected {self.peek()}")
        return out

    def any_of(self) -> Column:
        out = self.all_of()
        while self.peek() == "$or":
            self.at += 1
            out = out | self.all_of()
        return out

    def all_of(self) -> Column:
        out = self.one()
        while (token := self.peek()) not in (None, "$or", "$close"):
            self.at += token == "$and"
            out = out & self.one()
        return out

    def one(self) -> Column:
        token = self.peek()
        if token is None or token in ("$and", "$or", "$close"):
            raise BadSyntax("a condition is missing")
        self.at += 1
        if token == "$not":
            return ~self.one()
        if token == "$open":
            out = self.any_of()
            if self.peek() != "$close":
                raise BadSyntax("a bracket is not closed")
            self.at += 1
            return out
        return self.condition(token)

    def condition(self, text: str) -> Column:
        found = CONDITION.fullmatch(text)
        if not found:
            raise BadSyntax(f"{text!r} is no condition")
        path, op, value = path_of(found["path"]), found["op"], found["value"]
        strings = types.is_string(self.comparer.target(path).datatype)
        # On strings = and <> take wildcards; case is only ever ignored by = <> == !=.
        name = {"=": "$like" if strings else "$eq", "<>": "$notlike" if strings else "$neq", "==": "$eq", "!=": "$neq", "<": "$lt", ">": "$gt", "<=": "$lte", ">=": "$gte"}[op]
        return self.comparer.compare(path, name, value, "i" if self.fold and op in ("=", "<>", "==", "!=") else "")


def frame(model, table, query: dict) -> DataFrame:
    """The rows of {"entity", "conditions", "attributes", "orderBy", "groupBy", "rowMaxCount", ...}."""
    joined = Joined(model, table, model.entity(query["entity"]))
    comparer = Comparer(joined)
    where = Tokens(comparer, list(query.get("conditions") or [])).read()
    every = all_attributes(joined.root)  # what a * stands for, beside whatever else is listed
    attributes = [w for a in query.get("attributes") or [] for w in (every if a.strip() == "*" else [_attribute(a)])]
    selection = Selection(
        attributes, [_directed(o) for o in query.get("orderBy") or []], [path_of(g) for g in query.get("groupBy") or []],
        query.get("rowMaxCount", ROW_LIMIT), query.get("rowSkipCount", 0), query.get("seqMaxCount", SEQ_LIMIT), query.get("seqSkipCount", 0),
    )
    for path in [w.path for w in selection.attributes] + [p for p, _ in selection.order] + selection.group:
        joined.resolve(path)
    if where is not None:
        joined.df = joined.df.where(where)
    return rows(joined, comparer, selection)
