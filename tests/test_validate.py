"""Nested documents against a schema, with paths."""

from pyspark.sql import functions as F

from proofloom.operators import validate as V

N = V.Node
SCHEMA = {
    "key": N(required=True, pattern="^C-[0-9]+$"),
    "owner": N(required=True, fields={"name": N(required=True, least_size=2, most_size=5), "kind": N(one_of=("a", "b"))}),
    "units": N(
        least_size=1,
        distinct="id",
        items=N(fields={"id": N(required=True), "price": N(least=0, most=100, checks={"even": lambda x: x % 2 == 0}), "tags": N(distinct="", items=N(required=True, pattern="^[a-z]+$"))}),
    ),
}
TYPE = "struct<key:string,owner:struct<name:string,kind:string>,units:array<struct<id:int,price:int,tags:array<string>>>>"


def broken(spark, *documents):
    rows = V.parsed(spark.createDataFrame(list(enumerate(documents)), "i int, text string"), "text", TYPE, "d")
    found = V.report(rows.select("i", "d.*"), ["i"], SCHEMA)
    return {i: [(r.path, r.check) for r in found.where(f"i = {i}").collect()] for i in range(len(documents))}, [r.d_kind for r in rows.orderBy("i").collect()]


def test_paths_reach_into_structs_and_arrays(spark):
    good = '{"key": "C-1", "owner": {"name": "Ana", "kind": "a"}, "units": [{"id": 1, "price": 4, "tags": ["x"]}]}'
    bad = '{"key": "1", "owner": {"name": "A", "kind": "c"}, "units": [{"id": 1, "price": 101, "tags": ["x", null, "X", "x"]}, {"id": 1, "price": -1}, {"price": null, "tags": []}, null]}'
    none = '{"units": []}'
    found, kinds = broken(spark, good, bad, none, "{", "null", None)
    assert found[0] == []
    assert found[1] == [
        ("key", "pattern"), ("owner.name", "least size"), ("owner.kind", "one of"), ("units", "distinct"), ("units[0].price", "most"), ("units[0].price", "even"), ("units[0].tags", "distinct"),
        ("units[0].tags[1]", "required"), ("units[0].tags[2]", "pattern"), ("units[1].price", "least"), ("units[1].price", "even"), ("units[2].id", "required"), ("units[3].id", "required"),
    ]
    assert found[2] == [("key", "required"), ("owner", "required"), ("owner.name", "required"), ("units", "least size")]
    assert found[3][0] == ("key", "required") and kinds == [None, None, None, "malformed", None, None]


def test_no_shuffle_and_no_python(spark):
    df = spark.createDataFrame([], TYPE.removeprefix("struct<").removesuffix(">"))
    plan = V.report(df, [], SCHEMA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert V.report(df, [], SCHEMA).count() == 0 and F
