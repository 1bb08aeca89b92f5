import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessella import catalogue
from tessella.errors import BadSyntax, BadValue, IncompatibleUnits, QueryError, UnknownAttribute, UnknownEntity, UnknownRelation
from tessella.plans import nested
from tessella import sample as measurements


@pytest.fixture(scope="module")
def store(spark):
    return measurements.store(spark)


def got(store, query):
    return sorted((tuple(r) for r in store.query(query).collect()), key=str)


def ids(store, entity, condition, id_name="Id"):
    return [r[0] for r in got(store, {entity: condition, "$attributes": {id_name: 1}})]


def test_names_and_numbers(store):
    every = got(store, {"TestBed": {}})
    assert len(every) == 4 and got(store, {"AoTest": {}}) == every == got(store, {"2": {}})
    assert store.query({"AoTest": {}}).columns == ["Id", "Name", "Version", "Location"]
    assert ids(store, "AoTest", 3) == ids(store, "AoTest", "3") == [3]
    with pytest.raises(UnknownEntity):
        store.query({"aotest": {}})
    with pytest.raises(UnknownAttribute):
        store.query({"AoTest": {"NAME": "x"}})
    with pytest.raises(UnknownRelation):
        store.query({"AoTest": {"nothing.name": "x"}})


@pytest.mark.parametrize("condition, expected", [
    ({"Id": {"$in": [2, "4"]}}, [2, 4]),
    ({"name": {"$like": "BRKT*"}}, [2, 4]),
    ({"name": {"$like": "brkt*", "$options": "i"}}, [2, 4, 5]),
    ({"name": {"$like": "brkt\\%?"}}, [5]),
    ({"name": {"$like": "brkt\\??"}}, []),
    ({"name": {"$like": "*%?"}}, [5]),
    ({"name": {"$eq": "brkt-l8", "$options": "i"}}, [2]),
    ({"name": {"$notlike": "BRKT*"}}, [3, 5]),
    ({"version": {"$null": 1}}, [5]),
    ({"version": {"$notnull": 1}}, [2, 3, 4]),
    ({"version": {"$neq": "2.1"}}, [3, 4]),
    ({"version": {"$notin": ["2.1", "1.5"]}}, [4]),
    ({"version": {"$between": ["1.2", "2.1"]}}, [3, 4]),
    ({"$not": {"name": {"$like": "BRKT*"}}}, [3, 5]),
    ({"$or": [{"name": "BRKT-L8"}, {"version": "1.5", "Location": "Bern"}]}, [2, 3]),
    ({"$and": [{"id": {"$gt": 2}}, {"id": {"$lte": 4}}]}, [3, 4]),
    ({"name": ["BRKT-L8", "BRKT-L9"]}, [2, 4]),
    ({"children": 12}, [3]),
    ({}, [2, 3, 4, 5]),
])
def test_conditions(store, condition, expected):
    assert ids(store, "AoTest", condition) == expected


@pytest.mark.parametrize("condition, expected", [
    ({"measurement_begin": {"$gte": "201004"}}, [20, 21]),
    ({"measurement_begin": {"$between": ["2010-04-05T23:44:00.000Z", "2010-04-06T00:00:00Z"]}}, [20]),
    ({"measurement_begin": "20100405234400"}, [20]),
    ({"measurement_begin": {"$lt": "20110601000000001"}}, [20, 21]),
    ({"scale": {"$gte": 1.5, "$unit": 2}}, [20]),
    ({"scale": {"$unit": 1, "$lt": "100"}}, [21]),
    ({"test": 11}, [21]),
    ({"test.id": {"$in": [10, 12]}}, [20, 22]),
    ({"test.parent_test.name": "BRKT-L8"}, [20, 21]),
    ({"test.Parent.Parent.name": "s10"}, [22]),
    ({"test": {"$or": [{"name": "s10"}, {"version": {"$null": 1}}]}}, [20, 21]),
    ({"test.Parent:OUTER.name": {"$null": 1}}, [20]),
])
def test_paths_dates_units(store, condition, expected):
    assert ids(store, "AoMeasurement", condition) == expected


def test_enumerations(store):
    assert ids(store, "Quantity", {"datatype": "DT_LONGLONG"}) == ids(store, "Quantity", {"datatype": 8}) == [31]
    assert ids(store, "Quantity", {"datatype": {"$in": ["DT_BYTESTR", "8"]}}) == [31, 32]
    with pytest.raises(QueryError):
        store.query({"Quantity": {"datatype": "dt_longlong"}})
    rows = got(store, {"Quantity": 31, "$attributes": {"datatype": {"$options": "e"}, "minimum": 1}})
    assert rows == [("DT_LONGLONG", -5.5)]


def test_joins(store):
    inner = got(store, {"Quantity": {}, "$attributes": {"name": 1, "unit.name": 1}})
    outer = got(store, {"Quantity": {}, "$attributes": {"name": 1, "unit:OUTER.name": 1}})
    assert inner == [("Time", "s"), ("time", "m")] and len(outer) == 4
    down = got(store, {"TestBed": {}, "$attributes": {"Name": 1, "children.Name": 1}})
    assert down == [("BRKT-L8", "s10"), ("BRKT-L8", "s11"), ("HEAT_EXT_07 B", "s12")]
    assert got(store, {"TestBed": 2, "$attributes": {"children": 1}}) == [([10, 11],)]
    assert got(store, {"TestBed": 5, "$attributes": {"children": 1}}) == [([],)]
    both = got(store, {"Contact": {}, "$attributes": {"Name": 1, "Beds.Name": 1}})
    assert both == [("ann", "BRKT-L8"), ("ann", "BRKT-L9"), ("bob", "BRKT-L9")]
    assert got(store, {"Contact": {}, "$attributes": {"Id": 1, "Beds": 1}}) == [(1, [2, 4]), (2, [4])]
    # The first to name a prefix says how it is joined: the condition, then the attributes.
    first = {"Quantity": {"unit:OUTER.name": {"$null": 1}}, "$attributes": {"name": 1, "unit.name": 1}}
    assert got(store, first) == [("Load", None), ("Speed", None)]
    # A recursive relation is another instance at every step.
    assert got(store, {"Step": 13, "$attributes": {"Name": 1, "Parent.Name": 1, "Parent.Parent.Name": 1}}) == [("s13", "s12", "s11")]
    # An inner join below an outer one drops rows.
    assert len(got(store, {"Step": {}, "$attributes": {"Name": 1, "Bed:OUTER.Name": 1, "Parent:OUTER.Bed.Name": 1}})) == 3


def test_foreign_key_needs_no_join(store):
    plan = store.query({"Run": {"test.id": 10}, "$attributes": {"name": 1, "test.id": 1}})._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_aggregates(store):
    query = {"Quantity": {}, "$attributes": {"maximum": {"$min": 1, "$max": 1, "$count": 1, "$dcount": 1}}}
    assert got(store, query) == [(1.0, 9.0, 4, 3)]
    assert store.query(query).columns == ["MIN(maximum)", "MAX(maximum)", "COUNT(maximum)", "DCOUNT(maximum)"]
    grouped = {"Quantity": {}, "$attributes": {"measurement.name": 1, "maximum": {"$stddev": 1, "$avg": 1, "$sum": 1}}, "$groupby": {"measurement.name": 1}, "$orderby": {"measurement.name": 0}}
    rows = store.query(grouped).collect()
    assert [r[0] for r in rows] == ["r22", "r21", "r20"] and rows[2][2] == 5.0 and abs(rows[2][1] - 5.656854) < 1e-6
    by_id = {"Quantity": {}, "$attributes": {"measurement.id": 1, "measurement.name": 1, "id": {"$count": 1}}, "$groupby": {"measurement": 1}}
    assert got(store, by_id) == [(20, "r20", 2), (21, "r21", 1), (22, "r22", 1)]
    with pytest.raises(QueryError):
        store.query({"Quantity": {}, "$attributes": {"name": 1, "maximum": {"$max": 1}}})
    assert got(store, {"Step": {}, "$attributes": {"version": {"$distinct": 1}}}) == [("1",), (None,)]
    assert got(store, {"Step": {}, "$attributes": {"version": 1}, "$groupby": {"version": 1}}) == [("1",), (None,)]


def test_order_and_limits(store):
    rows = store.query({"TestBed": {}, "$attributes": {"Id": 1}, "$orderby": {"version": 1}}).collect()
    assert [r[0] for r in rows] == [5, 4, 3, 2]  # null first upward
    rows = store.query({"TestBed": {}, "$attributes": {"Id": 1}, "$orderby": {"version": 0}, "$options": {"$rowlimit": 2, "$rowskip": 1}}).collect()
    assert [r[0] for r in rows] == [3, 4]


def test_bulk(store):
    cut = {"Channel": {"submatrix": 24}, "$attributes": {"id": 1, "values": 1, "flags": 1}, "$options": {"$seqlimit": 2, "$seqskip": 1}}
    rows = {r[0]: r for r in store.query(cut).collect()}
    assert rows[1]["values"]["dbl"] == [-10000.0, -10000.0] and rows[3]["values"]["str"] == ["b", "c"] and rows[1]["flags"] == [0, 9] and rows[2]["flags"] == []
    point = {"Channel": {"Doubles": {"$gt": 5.5, "$lt": 8}}, "$attributes": {"id": 1, "Doubles": {"$point": 1}}}
    assert got(store, point) == [(2, [1, 2])]
    calculated = got(store, {"Channel": {"id": {"$in": [2, 3, 4]}}, "$attributes": {"id": 1, "Doubles": {"$calculated": 1}}})
    assert calculated == [(2, [5.0, 6.0, 7.0, 8.0]), (3, [12.0, 14.0]), (4, [1.0, 1.5, 2.0, 2.5])]


def test_options_and_units_of_attributes(store):
    rows = {r[0]: r[1] for r in store.query({"Parameter": {}, "$attributes": {"name": 1, "pvalue": {"$options": "u"}}}).collect()}
    assert rows["a"]["lng"] == [42] and rows["b"]["str"] == ["text"] and rows["c"]["dbl"] == [1.5] and rows["d"]["ts"] == [datetime.datetime(2020, 1, 2)]
    assert rows["e"]["lng"] == [None]
    assert got(store, {"Run": {}, "$attributes": {"scale": {"$unit": 2}}}) == [(0.02,), (1.5,), (None,)]
    with pytest.raises(IncompatibleUnits):
        store.query({"Run": {}, "$attributes": {"scale": {"$unit": 4}}})
    assert measurements.model().conversion(3, 4) == (1.0, 273.15)


def test_query_as_value(store):
    inner = {"Unit": {"name": "m"}, "$attributes": {"id": 1}}
    assert ids(store, "Quantity", {"unit": {"$in": inner}}) == [32]
    assert ids(store, "Quantity", {"unit": {"$notin": inner}}) == [30]
    with pytest.raises(BadSyntax):
        store.query({"Quantity": {"$or": [{"unit": {"$in": inner}}]}})


@pytest.mark.parametrize("query", [
    {"AoTest": {}, "AoSubTest": {}}, {}, {"AoTest": {}, "$where": {}}, {"AoTest": {}, "$options": {"$top": 1}}, {"AoTest": {}, "$options": {"$rowlimit": "1"}},
    {"AoTest": {}, "$attributes": {"name": [1]}}, {"AoTest": {}, "$attributes": {"name": {"$median": 1}}}, {"AoTest": {}, "$attributes": {"$max": 1}},
    {"AoTest": {}, "$orderby": {"name": 2}}, {"AoTest": {}, "$orderby": {"$name": 1}}, {"AoTest": {}, "$orderby": {"name": [1]}}, {"AoTest": {}, "$groupby": {"name": 0}}, {"AoTest": {}, "$groupby": {"name": [1]}},
    {"AoTest": {}, "$groupby": {"$x": 1}}, {"AoTest": {"$and": {"name": 1}}}, {"AoTest": {"$or": "x"}}, {"AoTest": {"name": {"$regex": "x"}}}, {"AoTest": {"name": {"$eq": {"a": 1}}}},
    {"AoTest": {"$eq": 1}}, {"AoTest": {"$not": [1]}}, {"AoTest": {"name": {"$between": [1]}}}, {"AoTest": {"name": {"$in": 1}}}, {"AoTest": []}, {"AoTest": {"a..b": 1}}, {"AoTest": {"children:INNER.name": 1}},
])
def test_bad_syntax(store, query):
    with pytest.raises(BadSyntax):
        store.query(query)


@pytest.mark.parametrize("condition", [{"Id": "x"}, {"Id": 1.5}])
def test_bad_values(store, condition):
    with pytest.raises(BadValue):
        store.query({"AoTest": condition})


@pytest.mark.parametrize("query, expected", [
    ({"entity": "TestBed", "conditions": ["Name = BRKT*"], "attributes": ["Id"]}, [(2,), (4,)]),
    ({"entity": "AoTest", "conditions": ["$ci", "name = brkt*"], "attributes": ["Id"]}, [(2,), (4,), (5,)]),
    ({"entity": "AoTest", "conditions": ["$ci", "name == brkt-l8", "$cs", "$or", "name == brkt-l9"], "attributes": ["Id"]}, [(2,)]),
    ({"entity": "AoTest", "conditions": ["name <> BRKT*"], "attributes": ["Id"]}, [(3,), (5,)]),
    ({"entity": "AoTest", "conditions": ["Id >= 3", "Id < 5"], "attributes": ["Id"]}, [(3,), (4,)]),
    ({"entity": "AoTest", "conditions": ["$not", "$open", "Id = 3", "$or", "Id = 4", "$close", "$and", "Id != 5"], "attributes": ["Id"]}, [(2,)]),
    ({"entity": "Quantity", "conditions": ["measurement.name = r20"], "attributes": ["name", "OUTER(unit).name"]}, [("Speed", None), ("Time", "s")]),
    ({"entity": "Quantity", "attributes": ["STDDEV(maximum)", "COUNT(id)"], "conditions": ["datatype == DT_DOUBLE"]}, [(None, 2)]),
])
def test_listed(store, query, expected):
    assert got(store, query) == expected


def test_listed_errors_and_limits(store):
    for conditions in (["$open", "Id = 3"], ["Id"], ["$and", "Id = 3"], ["Id = 3", "$close"]):
        with pytest.raises(BadSyntax):
            store.query({"entity": "AoTest", "conditions": conditions})
    rows = store.query({"entity": "AoTest", "attributes": ["Id"], "orderBy": ["DESCENDING(Id)"], "rowMaxCount": 2, "rowSkipCount": 1}).collect()
    assert [r[0] for r in rows] == [4, 3]


def test_text_of_a_query(store):
    assert ids(store, "TestBed", {"Id": 2}) == [r[0] for r in store.query('{"TestBed": {"Id": 2}, "$attributes": {"Id": 1}}').collect()]
    assert nested.read({"E": 5})[1] == {"id": 5}


LEAF = st.one_of(
    st.tuples(st.sampled_from(["$eq", "$neq", "$lt", "$gt", "$lte", "$gte"]), st.integers(0, 24)).map(lambda x: {"id": {x[0]: x[1]}}),
    st.lists(st.integers(0, 24), min_size=1, max_size=4).map(lambda x: {"id": {"$in": x}}),
    st.tuples(st.integers(0, 24), st.integers(0, 24)).map(lambda x: {"id": {"$between": list(x)}}),
    st.sampled_from(["A*", "*A", "?R*", "*I*"]).map(lambda x: {"name": {"$like": x}}),
    st.integers(0, 4).map(lambda x: {"region": x}),
)
TREE = st.recursive(
    LEAF,
    lambda inner: st.one_of(
        st.lists(inner, min_size=1, max_size=3).map(lambda x: {"$and": x}), st.lists(inner, min_size=1, max_size=3).map(lambda x: {"$or": x}), inner.map(lambda x: {"$not": x})
    ),
    max_leaves=6,
)


def holds(condition, row):
    import fnmatch
    import operator

    compare = {"$eq": operator.eq, "$neq": operator.ne, "$lt": operator.lt, "$gt": operator.gt, "$lte": operator.le, "$gte": operator.ge}
    out = True
    for key, value in condition.items():
        if key == "$and":
            out &= all(holds(v, row) for v in value)
        elif key == "$or":
            out &= any(holds(v, row) for v in value)
        elif key == "$not":
            out &= not holds(value, row)
        elif isinstance(value, dict):
            ((op, x),) = value.items()
            v = row[key]
            out &= v in x if op == "$in" else x[0] <= v < x[1] if op == "$between" else fnmatch.fnmatchcase(v, x) if op == "$like" else compare[op](v, x)
        else:
            out &= row[key] == value
    return out


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TREE)
def test_condition_trees(spark, condition):
    nations = catalogue.store(spark, "/root/testdata/sf0.001")
    rows = [{"id": r[0], "name": r[1], "region": r[2]} for r in nations.query({"Nation": {}}).collect()]
    assert ids(nations, "Nation", condition, "id") == sorted((r["id"] for r in rows if holds(condition, r)), key=lambda x: str((x,)))


def test_star_beside_other_attributes(spark):
    store = measurements.store(spark)
    plain = store.query({"entity": "TestBed"}).columns
    found = store.query({"entity": "TestBed", "attributes": ["*", "OUTER(Steps).Name"]})
    assert found.columns[: len(plain)] == plain and len(found.columns) == len(plain) + 1


def test_matrix_pages(spark):
    store = measurements.store(spark)
    query = {"Step": {}, "$attributes": {"Id": 1, "Name": 1}}
    pages = list(store.matrix_pages(query, ["Id"], 3))
    columns = [[c["values"] for c in m["columns"]] for p in pages for m in p["matrices"]]
    ids = [x for c in columns for x in next(v for k, v in c[0].items() if k != "dataType")]
    assert len(pages) == 2 and ids == [10, 11, 12, 13]
    whole = store.matrices(query)["matrices"][0]["columns"][0]
    assert pages[0]["matrices"][0]["columns"][0]["values"]["dataType"] == whole["values"]["dataType"]
    assert [m["columns"] for p in store.matrix_pages({"Step": {"Id": 999}, "$attributes": {"Id": 1}}, ["Id"], 3) for m in p["matrices"]][0][0]["name"] == "Id"


def test_encoded_pages_are_cut_from_one_order(spark):
    from tessella.model import Attribute, Entity, Model
    from tessella.sources.tables import Tables
    from tessella.store import Store

    ids = [7 * k % 1000 for k in range(1000)]
    rows = spark.createDataFrame([(None if k < 40 else k, f"n{k}") for k in ids], "id long, name string").repartition(3)
    entity = Entity(1, "All", "AoAny", "all", {n: Attribute(n, n, t, n) for n, t in (("id", "DT_LONGLONG"), ("name", "DT_STRING"))})
    store = Store(spark, Model([entity]), Tables(spark, given={"all": rows}))
    column = lambda m, k: next(v for n, v in m["columns"][k]["values"].items() if n != "dataType")
    query = {"All": {}, "$attributes": {"id": 1, "name": 1}}
    for size in (30, 1000, 5000):
        # Rows without a key come first, and lie across pages of 30.
        pages = [m for p in store.matrix_pages(query, ["id"], size) for m in p["matrices"]]
        assert [len(column(m, 0)) for m in pages] == [min(size, 1000 - k) for k in range(0, 1000, size)]
        assert [x for m in pages for x in column(m, 0)] == [None] * 40 + list(range(40, 1000))
        assert sorted(x for m in pages for x in column(m, 1)) == sorted(f"n{k}" for k in ids)
    skipped = [x for p in store.matrix_pages(query | {"$options": {"$rowskip": 50}}, ["id"], 100) for m in p["matrices"] for x in column(m, 0)]
    assert skipped == list(range(50, 1000))


def test_views_of_sql_are_its_own(spark):
    store = measurements.store(spark)
    spark.range(3).createOrReplaceTempView("Unit")
    try:
        assert store.sql("SELECT count(*) FROM Unit").first()[0] == 3  # the caller's view holds
        assert store.sql("SELECT count(*) AS n FROM Step JOIN TestBed ON Step.Bed = TestBed.Id").first()["n"] == 3
        assert not {"Step", "TestBed", "step", "testbed"} & {t.name for t in spark.catalog.listTables()}
    finally:
        spark.catalog.dropTempView("Unit")
