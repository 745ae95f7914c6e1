"""What follows a verdict, on literal rows: refusals, suspects, recorded runs, objections, mapped payloads."""

import json

import pytest
from pyspark.sql import functions as F

from proofloom.operators import evidence as E
from proofloom.operators import export as X
from proofloom.operators import fold
from proofloom.operators import journal as J
from proofloom.operators import log as L


def test_every_event_has_its_state_and_refusals_are_rows(spark):
    rows = [(1, 2, "b"), (1, 1, "a"), (1, 3, "a"), (1, 4, None), (None, 1, "b"), (None, 2, "a"), (2, 1, "x")]
    df = spark.createDataFrame(rows, "k int, at int, kind string").repartition(3)
    found = fold.replayed(df, "k", ["at"], "kind", {("S", "a"): "A", ("A", "b"): "B"}, "S").collect()
    assert {(r.k, r.at): (r.seq, r.state, r.accepted) for r in found} == {
        (1, 1): (1, "A", True), (1, 2): (2, "B", True), (1, 3): (3, "B", False), (1, 4): (4, "B", False), (None, 1): (1, "S", False), (None, 2): (2, "A", True), (2, 1): (1, "S", False),
    }
    assert fold.replayed(df.where("1 = 0"), "k", ["at"], "kind", {}, "S").count() == 0


def test_suspects_are_kept_whole(spark):
    rows = [(1, 5, False, "sheet", 1), (1, 5, True, "plate", 2), (1, 6, True, "plate", 3), (2, 7, True, "plate", 4), (3, 1, False, "sheet", 5), (3, 2, False, "sheet", 6), (3, 1, True, "plate", 7), (3, 9, True, "plate", 8), (None, 1, False, "sheet", 9), (None, 2, True, "plate", 10)]
    facts = spark.createDataFrame(rows, "unit int, v int, ocr boolean, kind string, seq int")
    said = E.consolidate(facts, ["unit"], "v", F.col("ocr"), F.col("kind"), ["sheet"], "seq")
    found = E.suspects(facts, ["unit"], "v", F.col("ocr"), said.select("unit", "value", "raw")).collect()
    assert {(r.unit, r.seq, r.v, r.chosen) for r in found} == {(1, 3, 6, 5), (3, 8, 9, 1), (None, 10, 2, 1)}


def test_a_recorded_run_is_the_same_every_time_and_has_the_order_of_its_kinds(spark):
    part = lambda rows: spark.createDataFrame(rows, "k int, place int, payload string")
    parts = {"verdict given": part([(1, 0, "ok")]), "case opened": part([(1, 0, "x"), (2, 0, "y")]), "evidence proposed": part([(1, 2, "b"), (1, 1, "c"), (1, 1, "a"), (1, 1, None)])}
    log = L.recorded(parts, "k").where("k = 1").orderBy("seq").collect()
    assert [(r.seq, r.kind, r.payload) for r in log] == [(1, "case opened", "x"), (2, "evidence proposed", None), (3, "evidence proposed", "a"), (4, "evidence proposed", "c"), (5, "evidence proposed", "b"), (6, "verdict given", "ok")]
    again = L.recorded({k: v.repartition(3) for k, v in parts.items()}, "k").where("k = 1").orderBy("seq").collect()
    assert [r.own_hash for r in again] == [r.own_hash for r in log] and log[1].prev_hash == log[0].own_hash
    assert L.broken_links(L.recorded(parts, "k"), "k", F.concat_ws(":", "kind", "payload")).count() == 0
    assert len(L.RUN) == 11
    with pytest.raises(ValueError, match="no such kinds"):
        L.run_events({"gossip": parts["case opened"]}, "k")


def test_citations_come_before_likeness_and_nothing_is_escalated(spark):
    reasons = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    cited = spark.createDataFrame([(1, 7)], "k int, item int")
    alike = spark.createDataFrame([(1, 7, 90), (1, 8, 40), (2, 9, 60)], "k int, item int, confidence int")
    found = {(r.k, r.item, r.confidence, r.by) for r in J.interpreted(reasons, ["k"], cited, alike, "item").collect()}
    assert found == {(1, 7, 100, "citation"), (1, 8, 40, "likeness"), (2, 9, 60, "likeness"), (3, None, None, "escalation")}


def test_mapped_payloads_say_where_something_is_missing(spark):
    rows = [(1, "n", [("u1", 5), (None, None)]), (2, None, []), (3, "m", None)]
    df = spark.createDataFrame(rows, "k int, name string, units array<struct<id:string,pm:int>>")
    m = X.mapped(df, ["k"], {"title": (F.col("name"), True), "note": (F.lit(None).cast("string"), False)}, "units", "id", {"power": ("pm", True), "serial": ("id", False)})
    found = {r.k: (json.loads(r.payload)["detail"], r.shortfalls) for r in m.collect()}
    assert found[1][0]["units"] == [{"key": "u1", "fields": {"power": "5", "serial": "u1"}}, {"key": "1", "fields": {}}] and found[1][0]["case"] == {"title": "n"}
    assert found[1][1] == ["detail.units[1].power"] and found[2][1] == ["detail.case.title"] and found[3][1] == []
    manifest = spark.createDataFrame([("a", "x", "s", 3, None), ("a#1", "x", None, None, "a")], "path string, kind string, sha string, bytes int, parent string")
    assert [tuple(r) for r in X.attachments(manifest).orderBy("path").collect()] == [("a", "x", "s", 3, None, False), ("a#1", "x", None, None, "a", True)]


def test_sources_with_dots_in_their_keys(spark):
    assert X.paths_of("a.b.c") == ["$['a.b.c']", "$['a.b']['c']", "$['a']['b.c']", "$['a']['b']['c']"]
    docs = [(1, '{"a.b": {"c": 1}, "a": {"b": {"c": 2}}}'), (2, '{"a": {"b.c": 3}}'), (3, '{"a": {"b": {"c": 4}}}'), (4, "{}"), (5, "no json"), (6, None), (7, '{"a": {"b": {"c": null}}}')]
    rows = X.selected(spark.createDataFrame(docs, "k int, d string"), "d", [("x", "a.b.c", True), ("y", "z", False)]).collect()
    assert {r.k: (r.payload.x, r.shortfalls) for r in rows} == {1: ("1", []), 2: ("3", []), 3: ("4", []), 4: (None, ["x"]), 5: (None, ["x"]), 6: (None, ["x"]), 7: (None, ["x"])}


def test_the_mapping_and_the_platform_table_are_whole():
    from proofloom.plans import mapping, platform

    for text, n in ((mapping.CASE, 32), (mapping.UNIT, 28)):
        rows = mapping.rows_of(text)
        assert len(rows) == len({r[0] for r in rows}) == n
    assert X.load_mapping({a: b for a, b, _ in mapping.rows_of(mapping.CASE)}, mapping.TOP)
    states = platform.state_rows()
    assert len(states) == 19 and sum(r[3] for r in states) == 8 and {r[4] for r in states} == {None, "ENTREGADA", "EN_PLATAFORMA", "PENDIENTE_SUBSANACION", "CERRADA"}
    assert all(r[5] is None or r[4] in ("CERRADA", "PENDIENTE_SUBSANACION") for r in states)


def test_levels_and_renamed_documents(spark):
    facts = spark.createDataFrame([("a.x", None), ("a.y", None), ("b", 1), ("b", None), ("c", 1)], "v string, k int")
    found = [r.level for r in E.levels(facts, "v", F.col("k"), {"a.y": "case", "c": "case"}, ["a"]).collect()]
    assert found == ["unit", "case", "unit", "case", "case"]
    docs = spark.createDataFrame([(1, "Año.txt", "aa"), (2, "b", "bb"), (3, "c", "cc"), (4, None, "aa")], "d int, name string, sha string")
    said = spark.createDataFrame([("AA", "ano.TXT"), ("bb", "other"), ("cc", None), (None, "x")], "sha string, name string")
    assert [(r.d, r.declared_name) for r in E.renamed(docs, "name", "sha", said).collect()] == [(2, "other")]


def test_objections_meet_what_logs_have_before_they_are_multiplied(spark, monkeypatch):
    from proofloom.operators import log as L

    monkeypatch.setattr(L, "SLICE", 2)  # a group of many members is dealt to slices
    members = spark.createDataFrame([(i % 2, i) for i in range(20)] + [(None, 99)], "g int, u int")
    marked = spark.createDataFrame([(0, 4, 7), (1, 5, 8), (0, 2, 7), (3, 1, 9), (1, 1, None)], "g int, named int, e int")
    known = spark.createDataFrame([(4, 7), (6, 7), (6, 7), (3, 8), (2, 8), (1, None)], "u int, e int")
    rows = L.peer_events(marked, members, "g", "u", "named", "e", known)
    has = {(r.u, r.e) for r in known.collect() if r.e is not None}
    want = [(u, e, named == u) for g, named, e in [(0, 4, 7), (1, 5, 8), (0, 2, 7), (1, 1, None)] for u in range(g, 20, 2) if (u, e) not in has]
    assert sorted(map(str, (tuple(r) for r in rows.select("u", "e", "direct").collect()))) == sorted(map(str, want))
    above = str(rows._jdf.queryExecution().optimizedPlan()).split("Join Inner")[0]
    assert "Anti" not in above  # nothing is looked up in the product


def test_heads_of_runs_move_their_events_once(spark):
    from proofloom.operators import log as L

    one = lambda rows: spark.createDataFrame(rows, "k int, place string, payload string")
    parts = {"case opened": one([(1, "", "O"), (2, "", "F"), (None, "", "x")]), "document registered": one([(1, "2", "a/b"), (1, "1", "c/d"), (2, "1", None)]), "verdict given": one([(1, "", "done")])}
    made = dict(parts, **{"document registered": parts["document registered"].withColumn("payload", F.sha2("payload", 256))})
    log = L.recorded(made, "k").collect()
    want = {k: (len(rows), len({r.kind for r in rows}), max(rows, key=lambda r: r.seq).own_hash) for k in (1, 2, None) for rows in [[r for r in log if r.k == k]]}
    found = L.recorded_heads(parts, "k", digested=("document registered",))
    assert {r.k: (r.n, r.kinds, r.head) for r in found.collect()} == want
    assert str(found._jdf.queryExecution().executedPlan()).split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
