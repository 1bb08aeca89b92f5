"""A small store of measurement data, for trying things out and for tests: trees of tests, quantities, channels, parameters."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from .model import Attribute, Entity, Model, Relation, Unit
from .sources.tables import Tables
from .store import Store
from .types import CODES, UNKNOWN

DATATYPES = {name: number for number, name in enumerate(CODES)}
SEQUENCES = {"explicit": 0, "implicit_constant": 1, "implicit_linear": 2, "implicit_saw": 3, "raw_linear": 4}


def attributes(*rows) -> dict[str, Attribute]:
    out = {}
    for name, datatype, *rest in rows:
        base, more = (rest[0] if rest else ""), (rest[1] if len(rest) > 1 else {})
        out[name] = Attribute(name, name.lower(), datatype, base, **more)
    return out


def relations(*items: Relation) -> dict[str, Relation]:
    return {r.name: r for r in items}


def model() -> Model:
    tree = "FATHER_CHILD"
    return Model([
        Entity(2, "TestBed", "AoTest", "tests", attributes(("Id", "DT_ID", "id", {"obligatory": True, "unique": True}), ("Name", "DT_STRING", "name", {"obligatory": True}), ("Version", "DT_STRING", "version"), ("Location", "DT_STRING")),
               relations(Relation("Steps", "Step", base="children", inverse="Bed", inverse_base="parent_test", max=-1, inverse_max=1, kind=tree))),
        Entity(3, "Step", "AoSubTest", "steps", attributes(("Id", "DT_ID", "id"), ("Name", "DT_STRING", "name"), ("Version", "DT_STRING", "version")),
               relations(Relation("Bed", "TestBed", "bed", "parent_test", "Steps", "children", kind=tree), Relation("Parent", "Step", "parent", "", "Parts"),
                         Relation("Parts", "Step", inverse="Parent", max=-1, inverse_max=1))),
        Entity(4, "Run", "AoMeasurement", "runs", attributes(("Id", "DT_ID", "id"), ("Name", "DT_STRING", "name"), ("Begin", "DT_DATE", "measurement_begin"), ("Scale", "DT_DOUBLE", "scale", {"unit": 1})),
               relations(Relation("Step", "Step", "step", "test", "Runs", "children", kind=tree), Relation("Quantities", "Quantity", base="measurement_quantities", inverse="Run", max=-1, inverse_max=1))),
        Entity(5, "Quantity", "AoMeasurementQuantity", "quantities",
               attributes(("Id", "DT_ID", "id"), ("Name", "DT_STRING", "name"), ("DataType", "DT_ENUM", "datatype", {"enumeration": "datatype_enum"}), ("Minimum", "DT_DOUBLE", "minimum"), ("Maximum", "DT_DOUBLE", "maximum")),
               relations(Relation("Run", "Run", "run", "measurement", "Quantities", "measurement_quantities"), Relation("Unit", "Unit", "unit", "unit", "Quantities"))),
        Entity(6, "Unit", "AoUnit", "units", attributes(("Id", "DT_ID", "id"), ("Name", "DT_STRING", "name")), relations(Relation("Quantities", "Quantity", inverse="Unit", max=-1, inverse_max=1))),
        Entity(7, "Channel", "AoLocalColumn", "channels",
               attributes(("Id", "DT_ID", "id"), ("Name", "DT_STRING", "name"), ("Values", "DT_UNKNOWN", "values"), ("Doubles", "DS_DOUBLE"), ("Flags", "DS_SHORT", "flags"), ("Parameters", "DS_DOUBLE", "generation_parameters"),
                          ("Kind", "DT_ENUM", "sequence_representation", {"enumeration": "sequence_enum"}), ("Rows", "DT_LONG", "number_of_rows"), ("Independent", "DT_SHORT", "independent"), ("Submatrix", "DT_ID", "submatrix"))),
        Entity(8, "Parameter", "AoParameter", "parameters", attributes(("Id", "DT_ID", "id"), ("Name", "DT_STRING", "name"), ("Type", "DT_ENUM", "parameter_datatype", {"enumeration": "datatype_enum"}), ("Value", "DT_STRING", "pvalue"))),
        Entity(9, "Contact", "AoAny", "contacts", attributes(("Id", "DT_ID", "id"), ("Name", "DT_STRING", "name"), ("Photo", "DT_BLOB"), ("Signal", "DS_DCOMPLEX"), ("Refs", "DS_EXTERNALREFERENCE")),
               relations(Relation("Beds", "TestBed", inverse="Contacts", max=-1, inverse_max=-1, bridge=("contact_beds", "contact", "bed")))),
    ], {"datatype_enum": DATATYPES, "sequence_enum": SEQUENCES}, [Unit(1, "m", 1.0, 0.0, "length"), Unit(2, "km", 1000.0, 0.0, "length"), Unit(3, "C", 1.0, 273.15, "temperature"), Unit(4, "K", 1.0, 0.0, "temperature")])


def day(*parts) -> datetime.datetime:
    return datetime.datetime(*parts)


def tables(spark) -> Tables:
    make = spark.createDataFrame
    values = {
        1: ("DT_FLOAT", [-10000.0, -10000.0, -10000.0, 5.0]), 2: ("DT_LONG", [1, 2, 3, 4]), 3: ("DT_STRING", ["a", "b", "c", "d"]),
        4: ("DT_DATE", [day(2020, 1, 1), day(2020, 1, 2)]),
    }
    rows = []
    arms = [f.name for f in UNKNOWN.fields]
    for n, (code, v) in values.items():
        arm = {"DT_FLOAT": "dbl", "DT_LONG": "lng", "DT_STRING": "str", "DT_DATE": "ts"}[code]
        rows.append((n, tuple(code if a == "datatype" else v if a == arm else None for a in arms)))
    unknown = make(rows, f"key long, values {UNKNOWN.simpleString()}")
    channels = make([
        (1, "Time", [0.0, 0.1, 0.2], [15, 0, 9], [], 0, 3, 1, 24), (2, "Speed", [5.0, 6.0, 7.0, 8.0], [], [], 0, 4, 0, 24),
        (3, "Raw", [1.0, 2.0], [15, 15], [10.0, 2.0], 4, 2, 0, 24), (4, "Index", [], [], [1.0, 0.5], 2, 4, 0, 25),
    ], "id long, name string, doubles array<double>, flags array<smallint>, parameters array<double>, kind int, rows int, independent smallint, submatrix long")
    channels = channels.join(unknown, F.col("id") == F.col("key")).drop("key")
    return Tables(spark, given={
        "tests": make([(2, "BRKT-L8", "2.1", "Lund"), (3, "HEAT_EXT_07 B", "1.5", "Bern"), (4, "BRKT-L9", "1.2", "Perth"), (5, "brkt%x", None, None)], "id long, name string, version string, location string"),
        "steps": make([(10, "s10", "1", 2, None), (11, "s11", None, 2, 10), (12, "s12", "1", 3, 11), (13, "s13", "1", None, 12)], "id long, name string, version string, bed long, parent long"),
        "runs": make([(20, "r20", day(2010, 4, 5, 23, 44), 1500.0, 10), (21, "r21", day(2011, 6, 1), 20.0, 11), (22, "r22", None, None, 12)], "id long, name string, begin timestamp_ntz, scale double, step long"),
        "quantities": make([(30, "Time", 7, 0.0, 1.0, 20, 1), (31, "Speed", 8, -5.5, 9.0, 20, None), (32, "time", 11, 2.0, 3.0, 21, 2), (33, "Load", 7, None, None, 22, None)], "id long, name string, datatype int, minimum double, maximum double, run long, unit long"),
        "units": make([(1, "s"), (2, "m")], "id long, name string"),
        "channels": channels,
        "parameters": make([(1, "a", DATATYPES["DT_LONG"], "42"), (2, "b", DATATYPES["DT_STRING"], "text"), (3, "c", DATATYPES["DT_DOUBLE"], "1.5"), (4, "d", DATATYPES["DT_DATE"], "20200102"), (5, "e", DATATYPES["DT_LONG"], "no")], "id long, name string, type int, value string"),
        "contacts": make([(1, "ann", ("image/png", bytearray(b"0123456789")), [(1.0, 2.0), (3.0, 4.0)], [("d", "text/plain", "l")]), (2, "bob", None, None, None)],
                         "id long, name string, photo struct<header:string,content:binary>, signal array<struct<r:double,i:double>>, refs array<struct<description:string,mimeType:string,location:string>>"),
        "contact_beds": make([(1, 2), (1, 4), (2, 4)], "contact long, bed long"),
    })


def store(spark) -> Store:
    return Store(spark, model(), tables(spark))
