"""The context of a case, both worlds of a rulebook, and rule sets against each other, on literal rows."""

import pytest
from pyspark.sql import functions as F

from proofloom.operators import context as X
from proofloom.operators import rulebook as R
from proofloom.operators import whatif as W
from proofloom.plans import rulecase

FACTS = "case_id int, variable string, source string, kind string, value string"


def test_context_has_every_side_of_a_value(spark):
    rows = [
        (1, "P", "plate", "shown", "7.50"), (1, "P", "sheet", "shown", "7.5"), (1, "P", "letter", "declared", "8"), (1, "P", "plate", "shown", "7.50"), (1, "P", "odd", "shown", "none"),
        (1, "N", "b", "declared", "2"), (1, "N", "a", "derived", "3"), (1, "L", "x", "shown", "v"), (1, "L", "y", "shown", "u"), (1, "L", "y", "shown", None), (1, "other", "x", "shown", "z"),
        (None, "N", "a", "derived", "5"), (2, "P", "sheet", "shown", None), (3, "P", "plate", "shown", "1"), (3, "P", "sheet", "shown", "2"),
    ]
    declared = [X.Datum("P", "decimal(9,2)"), X.Datum("N", "int"), X.Datum("L", many=True), X.Datum("Z")]
    df = X.datum_rows(spark.createDataFrame(rows, FACTS).repartition(3), ["case_id"], declared, ["derived", "shown"], ["sheet", "plate"])
    found = {r.case_id: r for r in df.withColumn("conflicts", X.in_conflict(declared)).withColumn("same", X.agreed("P")).withColumn("said", X.of_kind("N", "declared")).collect()}
    assert set(found) == {1, None, 3}  # a case without a usable fact has no row
    one = found[1]
    assert str(one.P.value) == "7.50" and one.P.kind == "shown" and one.P.source == "sheet"
    assert {k: str(v) for k, v in one.P.by_source.items()} == {"sheet": "7.50", "plate": "7.50", "letter": "8.00", "odd": "None"}
    assert {k: str(v) for k, v in one.P.by_kind.items()} == {"shown": "7.50", "declared": "8.00"}
    assert (one.N.value, one.N.kind, one.said, one.Z, one.L.value) == (3, "derived", 2, None, ["u", "v"])
    assert one.N.conflict is False and found[None].N.value == 5 and found[None].P is None
    assert found[3].conflicts == ["P"] and found[3].same is False and found[1].same is False
    assert X.datum_rows(spark.createDataFrame([], FACTS), ["case_id"], declared, [], []).count() == 0


def test_equal_numbers_in_other_notation_are_no_conflict(spark):
    rows = [(1, "P", "a", "shown", "7.5"), (1, "P", "b", "shown", "7.50"), (1, "T", "a", "shown", "7.5"), (1, "T", "b", "shown", "7.50")]
    declared = [X.Datum("P", "double"), X.Datum("T")]
    row = X.datum_rows(spark.createDataFrame(rows, FACTS), ["case_id"], declared, [], []).withColumn("c", X.in_conflict(declared)).first()
    assert row.c == ["T"] and row.P.value == 7.5


@pytest.mark.parametrize(
    "row,want",
    [  # scope, mended rule, blocking rule, conflict, total, stand-in -> stopped, skipped, provisional, total, k, verdict, as known
        ((True, True, True, False, 100, 100), (False, False, False, 100, True, "PREVALIDATED", "PREVALIDATED")),
        ((True, False, True, False, None, 100), (False, False, True, 100, True, "FIXABLE", "FIXABLE")),
        ((True, False, True, False, None, 10), (False, False, True, 10, False, "BLOCKED", "FIXABLE")),
        ((True, False, True, False, 100, 10), (False, False, True, 100, True, "FIXABLE", "FIXABLE")),
        ((True, True, True, False, None, 10), (False, False, False, None, None, "PREVALIDATED", "PREVALIDATED")),
        ((True, None, True, True, 100, 100), (False, True, False, None, None, "BLOCKED", "BLOCKED")),
        ((True, True, False, False, 100, 100), (False, True, False, None, None, "BLOCKED", "BLOCKED")),
        ((False, False, False, True, 100, 100), (True, True, False, None, None, "NOT_ELIGIBLE", "NOT_ELIGIBLE")),
        ((None, None, None, None, None, None), (False, False, False, None, None, "PREVALIDATED", "PREVALIDATED")),
    ],
)
def test_two_worlds(spark, row, want):
    c = F.col
    rules = [R.Rule("s", "SCOPE", c("a"), "scope"), R.Rule("f", "FIXABLE", c("b")), R.Rule("d", "DATA", c("x")), R.Rule("k", "DATA", c("total") >= 50, "calculation")]
    df = spark.createDataFrame([row], "a boolean, b boolean, x boolean, conflict boolean, total int, other int")
    found = R.two_worlds(df, rules, {"total": "other"}, c("conflict")).first()
    assert (found.stopped, found.skipped, found.provisional, found.total, found.k, found.verdict, found.verdict_as_known) == want


def test_versions_are_judged_in_one_pass_and_told_apart(spark):
    c = F.col
    rows = [(1, 0, "a", "5"), (1, 1, "a", "50"), (1, 2, "a", None), (1, 1, "b", "x"), (2, 0, "a", "7"), (None, 0, "b", "9"), (3, 0, "z", "1")]
    events = spark.createDataFrame(rows, "k int, at int, variable string, value string").repartition(3)
    cases = W.last_values(events, "k", c("variable"), c("value"), ["at"], {"a": "int", "b": "int"})
    assert {r.k: (r.a, r.b) for r in cases.collect()} == {1: (50, None), 2: (7, None), None: (None, 9), 3: (None, None)}
    versions = {"old": [R.Rule("low", "DATA", c("a") < 10)], "new": [R.Rule("high", "FIXABLE", c("a") > 10), R.Rule("low", "DATA", c("a") < 10)], "late": [R.Rule("low", "DATA", c("a") < 100)]}
    rows = W.judged(cases, versions)
    assert "Exchange" not in str(W.judged(spark.createDataFrame([(1, 2, 3)], "k int, a int, b int"), versions)._jdf.queryExecution().executedPlan())
    found = {r.k: r for r in rows.collect()}
    assert W.rule_names(versions) == ["low", "high"]
    assert (found[1].old_failed, found[1].new_failed, found[1].late_failed) == (1, 1, 0) and (found[2].new_failed, found[3].new_open) == (2, 3)
    moved = {(r.k, r.version): tuple(r)[2:] for r in W.changes(rows, ["k"], versions, "old").collect()}
    assert moved == {(1, "late"): ("BLOCKED", "PREVALIDATED", "", "low"), (2, "new"): ("PREVALIDATED", "FIXABLE", "high", "")}


def test_the_rulebook_is_whole_and_both_worlds_differ(spark, sf):
    assert [r.name for r in rulecase._book()] == rulecase.RULES and len(set(rulecase.RULES)) == 26
    rows = rulecase.q_case_rules(spark, sf).collect()
    assert {"NOT_ELIGIBLE", "BLOCKED", "FIXABLE"} <= {r.verdict for r in rows}
    assert any(r.provisional and r.truncated is not None for r in rows) and all(r.truncated is None for r in rows if r.skipped)


def test_comparisons_stay_within_a_family(spark):
    from datetime import date

    from proofloom.functions import three_valued as K

    df = spark.createDataFrame([(1, 2.5, "1", "x", date(2024, 1, 1), True, None)], "i int, d double, s string, t string, day date, b boolean, n int")
    c = F.col
    cases = {
        ("i", "<", "d"): True, ("i", "==", "d"): False, ("s", "==", "t"): False, ("s", "<", "t"): None, ("i", "==", "s"): None, ("t", "<", "i"): None, ("day", ">=", "day"): True, ("day", "<", "i"): None,
        ("b", "==", "b"): True, ("b", "<", "b"): None, ("b", "==", "i"): None, ("i", "<", "n"): None, ("day", "!=", "s"): None,
    }
    row = df.select(*[K.compare(df, c(a), op, c(b)).alias(str(k)) for k, (a, op, b) in enumerate(cases)]).first()
    assert list(row) == list(cases.values())


def test_facts_that_rows_tell_of_themselves_are_as_facts_in_rows_and_nothing_moves(spark):
    c = F.col
    told = [
        ("P", "plate", "shown", c("a")), ("P", "sheet", "shown", c("b")), ("P", "letter", "declared", c("x")), ("P", "odd", "shown", F.lit("none")), ("P", "plate", "shown", c("x")),
        ("N", "b", "declared", c("x")), ("N", "a", "derived", c("y")), ("L", "x", "shown", c("a")), ("L", "y", "shown", c("b")), ("L", "y", "shown", F.when(c("y") > 3, "w")), ("other", "x", "shown", c("a")),
    ]
    declared = [X.Datum("P", "decimal(9,2)"), X.Datum("N", "int"), X.Datum("L", many=True), X.Datum("Z")]
    rows = spark.createDataFrame([(1, "7.50", "7.5", 8, 3), (2, None, "1", None, 4), (3, "1", "1", 1, None), (4, None, None, None, None)], "case_id int, a string, b string, x int, y int")
    each = F.array(*[F.struct(F.lit(v).alias("variable"), F.lit(s).alias("source"), F.lit(k).alias("kind"), x.cast("string").alias("value")) for v, s, k, x in told])
    facts = rows.select("case_id", F.explode(each).alias("f")).select("case_id", "f.*")
    order = (["derived", "shown"], ["sheet", "plate"])
    in_rows, own = X.datum_rows(facts, ["case_id"], declared, *order), X.told_rows(rows, ["case_id"], told, declared, *order)
    fields = [f"{n}.{f}" for n in ("P", "N", "Z") for f in ("value", "kind", "source")] + [f"{n}.{f}" for n in ("P", "N") for f in ("by_source", "by_kind")] + ["L.value"]
    say = lambda df: sorted(str(tuple(r)) for r in df.select("case_id", *[(F.array_sort(F.map_entries(c(f))) if "by_" in f else c(f)) for f in fields], X.agreed("P"), X.of_kind("N", "declared"), X.in_conflict(declared)).collect())
    assert say(own.where("case_id < 4")) == say(in_rows.where("case_id < 4"))
    four = own.where("case_id = 4").first()
    assert (four.N.value, four.N.conflict, four.L.value, four.P.by_source) == (None, False, None, {"odd": None})
    assert "Exchange" not in str(own._jdf.queryExecution().executedPlan())


def test_units_and_cases_tell_their_facts_without_a_row_for_each(spark, sf):
    plan = str(rulecase.q_unit_context(spark, sf)._jdf.queryExecution().executedPlan())
    assert "Exchange" not in plan and "Generate" not in plan
    assert "Generate" not in str(rulecase.q_case_rules(spark, sf)._jdf.queryExecution().executedPlan())
