"""The model over the test tables: an order store seen as measurement data."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .model import Attribute, Entity, Model, Relation, Unit
from .sources.tables import Tables
from .store import Store

ENUMERATIONS = {"quality_enum": {"bad": 0, "good": 1}, "toxic_enum": {"clean": 0, "toxic": 1}}
#: Money in three units of one dimension; part prices are stored in unit 1.
UNITS = [Unit(1, "coin", 1.0, 0.0, "money"), Unit(2, "hundred", 100.0, 0.0, "money"), Unit(3, "token", 0.5, 10.0, "money"), Unit(4, "metre", 1.0, 0.0, "length")]


def _entity(aid, name, base, table, prefix, columns, relations=(), units=None, enumerations=None) -> Entity:
    """columns: (column, type, base name). An attribute is called as its column without the prefix."""
    attributes = {}
    for column, datatype, own in columns:
        short = column.removeprefix(prefix)
        attributes[short] = Attribute(
            short, column, datatype, own, obligatory=own == "id", unique=own == "id", unit=(units or {}).get(short, 0), enumeration=(enumerations or {}).get(short, "")
        )
    return Entity(aid, name, base, table, attributes, {r.name: r for r in relations})


def _up(name, target, column, base="", inverse="", inverse_base="", kind="INFO", inverse_max=-1) -> Relation:
    return Relation(name, target, column, base, inverse, inverse_base, max=1, inverse_max=inverse_max, kind=kind)


def _down(name, target, inverse, base="", inverse_base="", kind="INFO", most=-1) -> Relation:
    return Relation(name, target, "", base, inverse, inverse_base, max=most, inverse_max=1, kind=kind)


def model() -> Model:
    tree = "FATHER_CHILD"
    return Model([
        _entity(1, "Region", "AoTest", "region", "r_", [("r_regionkey", "DT_LONG", "id"), ("r_name", "DT_STRING", "name")],
                [_down("nations", "Nation", "region", "children", "parent_test", tree)]),
        _entity(2, "Nation", "AoSubTest", "nation", "n_", [("n_nationkey", "DT_LONG", "id"), ("n_name", "DT_STRING", "name")],
                [_up("region", "Region", "n_regionkey", "parent_test", "nations", "children", tree),
                 _down("customers", "Customer", "nation", "children", "parent_test", tree), _down("suppliers", "Supplier", "nation")]),
        _entity(3, "Customer", "AoSubTest", "customer", "c_",
                [("c_custkey", "DT_LONGLONG", "id"), ("c_name", "DT_STRING", "name"), ("c_acctbal", "DT_DOUBLE", ""), ("c_mktsegment", "DT_STRING", "")],
                [_up("nation", "Nation", "c_nationkey", "parent_test", "customers", "children", tree),
                 _down("orders", "Order", "customer", "children", "test", tree), _down("events", "Event", "customer")]),
        _entity(4, "Supplier", "AoAny", "supplier", "s_",
                [("s_suppkey", "DT_LONGLONG", "id"), ("s_name", "DT_STRING", "name"), ("s_acctbal", "DT_DOUBLE", "")],
                [_up("nation", "Nation", "s_nationkey", "", "suppliers"), _down("lineitems", "LineItem", "supplier"),
                 Relation("parts", "Part", inverse="makers", max=-1, inverse_max=-1, bridge=("lineitem", "l_suppkey", "l_partkey"))]),
        _entity(5, "Part", "AoQuantity", "part", "p_",
                [("p_partkey", "DT_LONGLONG", "id"), ("p_name", "DT_STRING", "name"), ("p_brand", "DT_STRING", ""), ("p_type", "DT_STRING", ""), ("p_size", "DT_LONG", ""), ("p_retailprice", "DT_DOUBLE", "")],
                [_down("lineitems", "LineItem", "part", "", "quantity"),
                 Relation("makers", "Supplier", base="", inverse="parts", max=-1, inverse_max=-1, bridge=("lineitem", "l_partkey", "l_suppkey"))],
                units={"retailprice": 1}),
        _entity(6, "Order", "AoMeasurement", "orders", "o_",
                [("o_orderkey", "DT_LONGLONG", "id"), ("o_orderstatus", "DT_STRING", ""), ("o_totalprice", "DT_DOUBLE", ""), ("o_orderdate", "DT_DATE", "measurement_begin"), ("o_orderpriority", "DT_STRING", "")],
                [_up("customer", "Customer", "o_custkey", "test", "orders", "children", tree), _down("lineitems", "LineItem", "order", "measurement_quantities", "measurement", tree)],
                units={"totalprice": 1}),
        _entity(7, "LineItem", "AoMeasurementQuantity", "lineitem", "l_",
                [("l_linenumber", "DT_LONG", ""), ("l_quantity", "DT_DOUBLE", ""), ("l_extendedprice", "DT_DOUBLE", ""), ("l_discount", "DT_DOUBLE", ""), ("l_tax", "DT_DOUBLE", ""),
                 ("l_returnflag", "DT_STRING", ""), ("l_linestatus", "DT_STRING", ""), ("l_shipdate", "DT_DATE", "")],
                [_up("order", "Order", "l_orderkey", "measurement", "lineitems", "measurement_quantities", tree),
                 _up("part", "Part", "l_partkey", "quantity", "lineitems"), _up("supplier", "Supplier", "l_suppkey", "", "lineitems")]),
        _entity(8, "Event", "AoAny", "events", "",
                [("event_id", "DT_LONGLONG", "id"), ("ts", "DT_DATE", ""), ("event_type", "DT_STRING", "name"), ("value", "DT_DOUBLE", ""), ("props", "DT_STRING", "")],
                [_up("customer", "Customer", "user_id", "", "events")]),
        _entity(9, "Vector", "AoLocalColumn", "embeddings", "",
                [("vec_id", "DT_LONGLONG", "id"), ("embedding", "DS_FLOAT", "values"), ("label", "DT_LONG", "")]),
        _entity(10, "Document", "AoFile", "documents", "",
                [("doc_id", "DT_LONGLONG", "id"), ("text", "DT_STRING", ""), ("lang", "DT_STRING", ""), ("source", "DT_STRING", ""), ("n_chars", "DT_LONGLONG", "")],
                [_down("label", "Label", "document", most=1)]),
        _entity(11, "Label", "AoAny", "labels", "",
                [("quality", "DT_ENUM", ""), ("toxic", "DT_ENUM", "")],
                [_up("document", "Document", "doc_id", "", "label", inverse_max=1)], enumerations={"quality": "quality_enum", "toxic": "toxic_enum"}),
        _entity(12, "Page", "AoFile", "pages", "", [("page_id", "DT_LONGLONG", "id"), ("url", "DT_STRING", "name"), ("html", "DT_STRING", "")]),
        _entity(13, "Turn", "AoAny", "conversations", "", [("conv_id", "DT_LONGLONG", ""), ("turn", "DT_LONGLONG", ""), ("role", "DT_STRING", ""), ("text", "DT_STRING", "")]),
        _entity(14, "BenchmarkItem", "AoAny", "benchmark", "", [("item_id", "DT_LONGLONG", "id"), ("text", "DT_STRING", "")]),
    ], ENUMERATIONS, UNITS)


def store(spark: SparkSession, sf_dir: str) -> Store:
    return Store(spark, model(), Tables(spark, sf_dir))
