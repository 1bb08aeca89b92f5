import json

import pytest
from pyspark.sql import functions as F

from tessella import catalogue, types
from tessella.errors import BadSyntax, BadValue, ConstraintError, NotThere, QueryError, TransactionActive, TransactionNotActive, UnknownUnit
from tessella.functions import bulk, text
from tessella.model import Attribute, Entity, Model, Relation
from tessella.operators import channels, contents, matrices, paths
from tessella.operators.changes import Changes, Snapshots, children, rows_of, updated
from tessella.operators.sessions import Connections, Context
from tessella.sources.tables import Tables
from tessella.store import Store
from tessella import sample as measurements


@pytest.fixture(scope="module")
def store(spark):
    return measurements.store(spark)


@pytest.fixture
def changes(spark, store, tmp_path):
    return Changes(store.model, store.tables, Snapshots(spark, f"file://{tmp_path}"))


def names(changes, entity="TestBed", attribute="Name"):
    store = Store(changes.base.spark, changes.model, changes.tables())
    return sorted((r[0] for r in store.query({entity: {}, "$attributes": {attribute: 1}}).collect()), key=str)


def test_changes_of_instances(changes):
    changes.insert("TestBed", {"Id": [7], "Name": ["new"], "Version": [None]})
    assert names(changes) == ["BRKT-L8", "BRKT-L9", "HEAT_EXT_07 B", "brkt%x", "new"]
    changes.update("TestBed", {"Id": [7, 2], "name": ["newer", "first"]})
    changes.delete("TestBed", [3, 4])
    assert names(changes) == ["brkt%x", "first", "newer"]
    assert names(changes, attribute="Location") == ["Lund", None, None]
    with pytest.raises(ConstraintError):
        changes.insert("TestBed", {"Id": [7], "Name": ["again"]})
    with pytest.raises(ConstraintError):
        changes.insert("TestBed", {"Id": [8], "Name": [None]})
    with pytest.raises(QueryError):
        changes.insert("TestBed", {"Id": [8], "Nothing": [1]})
    with pytest.raises(QueryError):
        changes.insert("TestBed", {"Id": [8], "Name": []})


def test_recursive_delete(changes):
    changes.delete("TestBed", [2], recursive=True)
    assert names(changes, "Step", "Id") == [12, 13]


def test_transactions(changes):
    changes.start()
    with pytest.raises(TransactionActive):
        changes.start()
    changes.delete("TestBed", [2])
    assert "BRKT-L8" not in names(changes)
    changes.abort()
    assert "BRKT-L8" in names(changes)
    with pytest.raises(TransactionNotActive):
        changes.commit()
    changes.start()
    changes.delete("TestBed", [2])
    changes.insert("Unit", {"id": [9], "name": ["kg"]})
    assert changes.snapshots.current() == {}
    changes.commit()
    assert set(changes.snapshots.current()) == {"tests", "units"} and "BRKT-L8" not in names(changes)


def test_relations_and_vectors(changes):
    related = lambda: sorted(tuple(r) for r in Store(changes.base.spark, changes.model, changes.tables()).related("Contact", "Beds").collect())
    changes.relate("Contact", "Beds", 2, [2, 4])
    assert related() == [(1, 2), (1, 4), (2, 2), (2, 4)]
    changes.relate("Contact", "Beds", 1, [3], "UPDATE")
    changes.relate("Contact", "Beds", 2, [4], "REMOVE")
    assert related() == [(1, 3), (2, 2)]
    changes.relate("TestBed", "Steps", 4, [10, 13], "INSERT")
    store = lambda: Store(changes.base.spark, changes.model, changes.tables())
    assert [r[0] for r in store().query({"TestBed": 4, "$attributes": {"Steps": 1}}).collect()] == [[10, 13]]
    changes.relate("TestBed", "Steps", 4, [13], "REMOVE")
    changes.relate("Run", "Step", 22, [13])
    assert store().query({"Run": 22, "$attributes": {"Step": 1}}).first()[0] == 13
    value = lambda: store().query({"Channel": 2, "$attributes": {"Doubles": 1}}).first()[0]
    changes.write_vector("Channel", 2, "Doubles", [1.5, 2.5], 1, "UPDATE")
    assert value() == [5.0, 1.5, 2.5, 8.0]
    changes.write_vector("Channel", 2, "Doubles", [0.0], 1, "INSERT")
    changes.write_vector("Channel", 2, "Doubles", [9.0], mode="APPEND")
    assert value() == [5.0, 0.0, 1.5, 2.5, 8.0, 9.0]
    changes.write_vector("Channel", 2, "Doubles", [0.0, 0.0], 1, "REMOVE")
    assert value() == [5.0, 2.5, 8.0, 9.0]
    changes.write_vector("Channel", 2, "Doubles", [7.0], 5, "UPDATE")
    assert value() == [5.0, 2.5, 8.0, 9.0, None, 7.0]


def test_plain_matrices(store):
    made = store.matrices({"TestBed": {"Id": {"$lt": 5}}, "$attributes": {"Name": 1, "Id": 1, "Version": 1}, "$orderby": {"Id": 1}, "$options": {"$rowskip": 1}})
    (matrix,) = made["matrices"]
    assert (matrix["name"], matrix["baseName"], matrix["rowSkipCount"]) == ("TestBed", "AoTest", 1)
    assert matrix["columns"][0] == {"name": "Name", "baseName": "name", "aggregate": "NONE", "values": {"dataType": "DT_STRING", "strVal": ["HEAT_EXT_07 B", "BRKT-L9"]}}
    assert matrix["columns"][1]["values"] == {"dataType": "DT_ID", "numVal": [3, 4]}
    two = store.matrices({"Run": {}, "$attributes": {"Name": 1, "Begin": 1, "Step.Name": 1, "Step": 1}, "$orderby": {"Id": 1}})["matrices"]
    assert [m["name"] for m in two] == ["Run", "Step"]
    assert two[0]["columns"][1]["values"] == {"dataType": "DT_DATE", "dateVal": ["20100405234400", "20110601000000", None]}
    assert two[0]["columns"][2]["values"] == {"dataType": "DT_LONGLONG", "numVal": [10, 11, 12]}
    count = store.matrices({"Run": {}, "$attributes": {"scale": {"$max": 1}}})["matrices"][0]["columns"][0]
    assert count["aggregate"] == "MAX" and count["values"]["numVal"] == [1500.0]
    json.dumps(made)


def test_typed_matrices(store):
    query = {"Channel": {"id": {"$in": [1, 3]}}, "$attributes": {"id": 1, "values": 1, "flags": 1, "Parameters": 1}, "$orderby": {"id": 1}, "$options": {"$seqlimit": 2}}
    columns = {c["name"]: c for c in store.matrices(query, "application/x-protobuf-json")["matrices"][0]["columns"]}
    assert columns["Id"]["dtLonglong"]["values"] == ["1", "3"] and "flags" not in columns["Id"]
    assert columns["Values"]["dtUnknown"]["values"] == [{"datatype": "DT_FLOAT", "dtFloat": {"values": [-10000.0, -10000.0]}}, {"datatype": "DT_STRING", "dtString": {"values": ["a", "b"]}}]
    assert columns["Flags"]["dsLong"]["values"] == [{"values": [15, 0]}, {"values": [15, 15]}]
    missing = store.matrices({"TestBed": 5, "$attributes": {"Version": 1}}, "application/x-protobuf-json")["matrices"][0]["columns"][0]
    assert missing["flags"] == [False] and missing["dtString"]["values"] == [""]
    flat = store.matrices({"Contact": 1, "$attributes": {"Signal": 1, "Refs": 1}})["matrices"][0]["columns"]
    assert flat[0]["values"]["numSeq"] == [[1.0, 2.0, 3.0, 4.0]] and flat[1]["values"]["extRefSeq"] == [["d", "text/plain", "l"]]


def test_forms(store):
    assert matrices.form_of("text/html;q=0.5, application/json") == "plain" and matrices.form_of("text/html") == "html"
    assert matrices.form_of("application/x-protobuf-json;q=0.9,text/html;q=0.1") == "typed"
    with pytest.raises(QueryError):
        matrices.form_of("image/png")
    assert "<th>Name</th><td>s</td>" in store.matrices({"Unit": 1}, "text/html")


def test_every_type_round_trips(spark):
    day = "20200102030405"
    samples = {
        "DT_STRING": "a", "DT_SHORT": -1, "DT_FLOAT": 1.5, "DT_BOOLEAN": True, "DT_BYTE": 200, "DT_LONG": 2, "DT_DOUBLE": -1.1, "DT_LONGLONG": 2**40, "DT_ID": 9,
        "DT_DATE": day, "DT_BYTESTR": b"abc", "DT_COMPLEX": [1.5, 0.0], "DT_DCOMPLEX": [2.5, 1.0], "DT_ENUM": 3, "DT_EXTERNALREFERENCE": ["d", "m", "l"],
    }
    kinds = {c: samples[c] for c in samples} | {types.sequence_of(c): [samples[c]] * 2 for c in samples}
    attributes = {f"x{k}": Attribute(f"x{k}", f"x{k}", c, "id" if k == 8 else "") for k, c in enumerate(kinds)}
    entity = Entity(1, "All", "AoAny", "all", attributes)
    from tessella.operators.changes import rows_of

    rows = rows_of(spark, Model([entity]), entity, {f"x{k}": [v, None] for k, v in enumerate(kinds.values())})
    assert [f.dataType for f in rows.schema.fields] == [types.spark_type(c) for c in kinds]
    made = Store(spark, Model([entity]), Tables(spark, given={"all": rows})).matrices({"All": {}})
    columns = made["matrices"][0]["columns"]
    values = {c["values"]["dataType"]: next(v for k, v in c["values"].items() if k != "dataType")[0] for c in columns}
    assert values["DT_DATE"] == day and values["DS_DATE"] == [day] * 2 and values["DT_BYTESTR"] == b"abc".hex() and values["DT_COMPLEX"] == [1.5, 0.0]
    assert values["DS_EXTERNALREFERENCE"] == ["d", "m", "l"] * 2 and values["DT_BYTE"] == 200 and values["DT_LONGLONG"] == 2**40
    missing = {c["values"]["dataType"]: next(v for k, v in c["values"].items() if k != "dataType")[1] for c in columns}
    assert missing["DT_LONG"] is None and missing["DS_LONG"] == []


def test_literals():
    assert types.parse_date("2009").isoformat() == "2009-01-01T00:00:00"
    assert types.parse_date("201004052344001").isoformat() == "2010-04-05T23:44:00.100000"
    assert types.parse_date("2010-04-05T23:44:00.5Z").isoformat() == "2010-04-05T23:44:00.500000"
    assert types.parse_date("2010-04-05T23:44:00+02:00").isoformat() == "2010-04-05T21:44:00"
    assert types.parse_date("") is None and types.parse_date("20101305") is None and types.parse_date("soon") is None
    assert types.coerce("DT_LONGLONG", "4711") == 4711 and types.coerce("DT_BOOLEAN", "false") is False
    assert types.coerce_list("DS_COMPLEX", [1, 2, 3, 4]) == [{"r": 1.0, "i": 2.0}, {"r": 3.0, "i": 4.0}]
    for code, value in (("DT_SHORT", 40000), ("DT_LONG", "x"), ("DT_DATE", "x"), ("DT_BOOLEAN", "maybe"), ("DT_UNKNOWN", 1)):
        with pytest.raises(BadValue):
            types.coerce(code, value)
    assert len(types.CODES) == 32 and types.NUMBER["DS_ENUM"] == 31


def test_stored_dates_and_patterns(spark):
    rows = spark.createDataFrame([("20100405234400",), ("2010040523440012",), ("2009",), ("201013",), ("",), (None,), ("x",)], "t string")
    found = [r[0] and r[0].isoformat() for r in rows.select(text.stored_date(F.col("t"))).collect()]
    assert found == ["2010-04-05T23:44:00", "2010-04-05T23:44:00.120000", "2009-01-01T00:00:00", None, None, None, None]
    assert text.like_pattern("a*b?c\\*_%") == "a%b_c*\\_\\%" and text.matches_name("WILDCARD_ALL", "*CARD_A?L")


def test_flags(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 3.0], [15, 0]), ([1.0], []), ([1.0], None)], "v array<double>, f array<smallint>")
    assert [r[0] for r in rows.select(bulk.masked(F.col("v"), F.col("f"))).collect()] == [[1.0, None, 3.0], [1.0], [1.0]]


def test_unknown_representation_is_an_error(spark, store):
    with pytest.raises(Exception, match="no formula"):
        one = store.tables("channels").withColumn("kind", F.lit(3))
        Store(spark, store.model, store.tables.with_tables({"channels": one})).query({"Channel": 4, "$attributes": {"Doubles": {"$calculated": 1}}}).collect()


def test_channels(store):
    rows = store.entity("Channel").where("Submatrix = 24")
    wide = channels.table(rows, ["Time", "Speed"], group="Submatrix", name="Name", values="Doubles").orderBy("row").collect()
    assert [tuple(r)[1:] for r in wide] == [(0, 0.0, 5.0), (1, 0.1, 6.0), (2, 0.2, 7.0), (3, None, 8.0)]
    part = channels.block(rows, 1, 2, "Submatrix", "Name", "Doubles").where("channel = 'Speed'").orderBy("row").collect()
    assert [(r["row"], r["value"]) for r in part] == [(1, 6.0), (2, 7.0)]
    assert channels.counts(rows, "Submatrix", "Doubles").first()[1:] == (4, 3)
    assert channels.independent(rows, "Independent").count() == 1 and channels.columns(rows, "*e*", "Name").count() == 2
    a = channels.table(rows, ["Time", "Speed"], group="Submatrix", name="Name", values="Doubles")
    assert channels.joined([a, a.withColumnRenamed("Speed", "again")], ["Submatrix", "row", "Time"]).count() == 3
    assert channels.merged([a, a.drop("Speed")]).count() == 8
    assert [r[0] for r in channels.sorted_together([a, a], ["row"]).select("row").take(2)] == [0, 0]


def test_contents(store, spark, tmp_path):
    row = contents.chunk(store.model, store.tables, "Contact", "Photo", 2, 3, [1]).first()
    assert (row["length"], bytes(row["data"])) == (10, b"234")
    assert contents.download(store.model, store.tables, "Contact", "Photo", 1) == b"0123456789" and contents.download(store.model, store.tables, "Contact", "Photo", 2) == b""
    path = contents.upload_path(str(tmp_path), "Contact", 1, "Photo")
    (tmp_path / "contents/Contact/Photo").mkdir(parents=True)
    open(path, "wb").write(b"new")
    assert contents.files(spark, str(tmp_path), "Contact", "Photo").select("id", "length").first() == (1, 3)


def test_paths(store):
    made = {r["id"]: r["path"] for r in paths.created(store.model, store.tables, "Step").collect()}
    assert made[10] == "/[TestBed]BRKT-L8;2.1/[Step]s10;1" and made[11] == "/[TestBed]BRKT-L8;2.1/[Step]s11" and made[13] == "/[Step]s13;1"
    for key in (10, 11, 12):
        assert [tuple(r) for r in paths.resolved(store.model, store.tables, made[key]).collect()] == [("Step", key)]
    assert paths.parsed(r"/[A\]b]x\/y\;z;v1") == [("A]b", "x/y;z", "v1")]
    for bad in ("", "x", "/A", "/[A]b/"):
        with pytest.raises(BadSyntax):
            paths.parsed(bad)
    with pytest.raises(NotThere):
        paths.resolved(store.model, store.tables, "/[Unit]s/[TestBed]x")


def test_sessions():
    context = Context({"SERVER": "5.3"})
    assert context.get("WILDCARD_?LL") == {"WILDCARD_ALL": "*"} and len(context.get()) == 5
    context.set("SERVER", "6")
    assert context.get("S*") == {"SERVER": "6"}
    c = Connections(lambda p: object())
    c.create("a", {"USER": "u", "PASSWORD": "p"})
    with pytest.raises(QueryError):
        c.create("a", {})
    first = c.session("a")
    assert c.get("a") == {"USER": "u"} and c.session("a") is first
    c.update("a", {"USER": "v", "HOST": "h"})
    assert c.get("a") == {"USER": "v", "HOST": "h"} and c.session("a") is not first
    c.put_all({"b": {}, "c": {}})
    c.delete("b")
    assert c.names() == ["a", "c"]
    with pytest.raises(NotThere):
        c.get("b")


def test_model():
    m = catalogue.model()
    assert m.check() == [] and Model.from_json(m.to_json()).to_dict() == m.to_dict()
    shown = {e["name"]: e for e in m.to_dict()["entities"]}
    nation = {r["name"]: r for r in shown["Nation"]["relations"]}
    assert nation["region"]["type"] == "1-n" and nation["customers"]["type"] == "n-1" and {r["name"]: r for r in shown["Part"]["relations"]}["makers"]["type"] == "n-m"
    assert [a["enumeration"] for a in shown["Label"]["attributes"]] == ["quality_enum", "toxic_enum"]
    assert m.many_relations(m.entity("Nation")) == ["customers", "suppliers"] and m.name_of(m.entity("Order"), "measurement_begin") == "orderdate"
    assert [e.name for e in m.entities_of_base("AoFile")] == ["Document", "Page"] and m.entity("Region") in m.top_level()
    with pytest.raises(UnknownUnit):
        m.unit(99)


def test_model_changes(spark):
    m = catalogue.model().copy()
    m.add_attribute("Nation", Attribute("comment", "n_comment", "DT_STRING"))
    m.add_entity(Entity(99, "Note", "AoAny", "notes", {"id": Attribute("id", "id", "DT_ID", "id")}))
    m.add_relation("Note", Relation("nation", "Nation", "nation", inverse="notes"))
    m.create_enumeration("colours", {"red": 0})
    m.add_item("colours", "green")
    m.rename_item("colours", "red", "crimson")
    assert m.enumerations["colours"] == {"crimson": 0, "green": 1} and m.entity("Nation").relation("notes").max == -1
    # An attribute without a column is null.
    store = Store(spark, m, Tables(spark, "/root/testdata/sf0.001"))
    assert store.query({"Nation": {"comment": {"$null": 1}}}).count() == 25
    m.delete_attribute("Nation", "comment")
    m.delete_entity("Note")
    m.remove_enumeration("colours")
    assert m.entity("Nation").relation("notes") is None and m.check() == []
    with pytest.raises(QueryError):
        m.remove_enumeration("quality_enum")


def test_changes_that_name_an_id_twice(spark):
    store = measurements.store(spark)
    e = store.model.entity("TestBed")
    with pytest.raises(QueryError):
        updated(store.model, e, store.tables(e.table), rows_of(spark, store.model, e, {"Id": [2, 2], "Name": ["a", "b"]}))


def steps_in_steps(parent="FATHER_CHILD", bed="FATHER_CHILD"):
    from dataclasses import replace

    model = measurements.model()
    step = model.entities["Step"]
    step.relations.update({n: replace(r, kind=parent if n in ("Parent", "Parts") else bed) for n, r in step.relations.items()})
    return model


def test_recursive_delete_of_steps_in_steps(spark):
    model, tables = steps_in_steps(), measurements.tables(spark)
    below = lambda name, id: {n: sorted(r[0] for r in df.collect()) for n, df in children(model, tables, model.entity(name), spark.createDataFrame([(id,)], "id long")).items()}
    assert below("Step", 11) == {"Step": [12, 13]} and below("Step", 13) == {"Step": []}
    assert below("TestBed", 2)["Step"] == [10, 11, 12, 13]


def test_a_broken_change_leaves_nothing(spark, tmp_path):
    import os

    store = measurements.store(spark)
    changes = Changes(store.model, store.tables, Snapshots(spark, f"file://{tmp_path}"))
    changes.insert("TestBed", {"Id": [7], "Name": ["seven"]})
    kept = sorted(os.listdir(tmp_path / "tests"))
    for columns in ({"Id": [7], "Name": ["again"]}, {"Id": [8], "Name": [None]}):
        with pytest.raises(ConstraintError):
            changes.insert("TestBed", columns)
    assert sorted(x for x in os.listdir(tmp_path / "tests") if not x.startswith(".")) == kept


def test_two_commits_at_once(spark, tmp_path):
    store = measurements.store(spark)
    snapshots = Snapshots(spark, f"file://{tmp_path}")
    snapshots.commit({"tests": store.tables("tests")})
    version, before = snapshots.version()
    written = [snapshots.write({"units": store.tables("units")}) for _ in range(2)]
    snapshots.point(written[0], before, version)
    with pytest.raises(QueryError):
        snapshots.point(written[1], before, version)
    assert snapshots.current() == before | written[0]
    (tmp_path / "_pointers" / f"{version + 2:012d}").touch()  # a commit that broke off
    assert snapshots.current() == before | written[0]
    with pytest.raises(QueryError):
        snapshots.commit({"units": store.tables("units")})


def test_paths_of_things_in_things(spark):
    """Levels are added while there are any; too many are an error."""
    model = steps_in_steps(bed="INFO")
    rows = spark.createDataFrame([(k, f"s{k}", None, None, k - 1 if k else None) for k in range(6)], "id long, name string, version string, bed long, parent long")
    tables = Tables(spark, given={"steps": rows})
    found = {r["id"]: r["path"] for r in paths.created(model, tables, "Step").collect()}
    assert found[5] == "".join(f"/[Step]s{k}" for k in range(6)) and found[0] == "/[Step]s0"
    with pytest.raises(QueryError):
        paths.created(model, tables, "Step", most_steps=5)
