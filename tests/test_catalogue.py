"""Every catalogue query against DuckDB, and the operators' rules on literal rows."""

import hashlib
import os
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from proofloom.functions import text as T
from proofloom.functions import three_valued as K
from proofloom.operators import fold
from proofloom.operators import journal as J
from proofloom.operators import log as L
from proofloom.operators import lookup as U
from proofloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted("|".join(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(want.fetchall(), want.columns)


@pytest.mark.parametrize("rows,want", [([], None), ([True], True), ([True, None], None), ([None, False], False)])
def test_all_rows(spark, rows, want):
    df = spark.createDataFrame([(x,) for x in rows], "x boolean").agg(K.all_rows(F.col("x")).alias("r"))
    assert df.first().r is want


def test_lists(spark):
    df = spark.createDataFrame([([], 1), ([1, None], 2), ([2, 2], 2), ([None], 3)], "a array<int>, x int")
    rows = df.select(K.in_list(F.col("x"), F.col("a")), K.unique(F.col("a")), K.for_each(F.col("a"), lambda e: e > 1), K.count_known(F.col("a"), lambda e: e > 1)).collect()
    assert [tuple(r) for r in rows] == [(False, None, None, 0), (False, True, False, None), (True, True, True, 2), (False, None, None, None)]


def test_text(spark):
    row = spark.range(1).select(T.spanish_number(F.lit("P: 1.485,50 kW")), T.spanish_number(F.lit("none")), T.fold(F.lit(" Año  ÉL ")), T.plain_decimal(F.lit("10.500").cast("decimal(9,3)")), T.names_code(F.lit("a-C1-2"), F.lit("C1")), T.names_code(F.lit("aC1-2"), F.lit("C1"))).first()
    assert (float(row[0]), *row[1:]) == (1485.5, None, "ano el", "10.5", True, False)


def test_interpolation_has_no_extrapolation(spark):
    table = spark.createDataFrame([(90, 4.0), (110, 5.55)], "k int, v double")
    rows = spark.createDataFrame([(89,), (90,), (100,), (110,), (111,)], "x int")
    found = {r.x: r.y for r in U.interpolate(rows, "x", table, "k", "v", "y").collect()}
    assert found == {89: None, 90: 4.0, 100: pytest.approx(4.775), 110: 5.55, 111: None}


def test_tampering_is_found_at_the_first_link(spark):
    e = spark.createDataFrame([(1, i, f"c{i}") for i in range(5)], "k int, i int, c string")
    stored = L.linked(e, "k", ["i"], F.col("c"))
    assert L.broken_links(stored, "k", F.col("c")).count() == 0
    forged = stored.withColumn("c", F.when(F.col("i") >= 3, "x").otherwise(F.col("c")))
    assert L.broken_links(forged, "k", F.col("c")).first().first_broken == 4


def test_a_row_forged_with_its_hashes_is_found_at_the_next_one(spark):
    e = spark.createDataFrame([(k, i, f"c{i}") for k in (1, None) for i in range(5)], "k int, i int, c string")
    rows = [r.asDict() for r in L.linked(e, "k", ["i"], F.col("c")).collect()]
    for r in rows:
        before = next((x for x in rows if x["k"] == r["k"] and x["seq"] == r["seq"] - 1), None)
        assert r["prev_hash"] == (before["own_hash"] if before else "")
        assert r["own_hash"] == hashlib.sha256(f"{r['prev_hash']}|{r['c']}".encode()).hexdigest()
    own = next(r for r in rows if r["k"] == 1 and r["seq"] == 3)
    after = next(r for r in rows if r["k"] == 1 and r["seq"] == 4)
    own["c"] = "forged"
    own["own_hash"] = after["prev_hash"] = hashlib.sha256(f"{own['prev_hash']}|forged".encode()).hexdigest()
    stored = spark.createDataFrame([(r["k"], r["c"], r["seq"], r["prev_hash"], r["own_hash"]) for r in rows], "k int, c string, seq long, prev_hash string, own_hash string")
    assert [tuple(r) for r in L.broken_links(stored, "k", F.col("c")).collect()] == [(1, 4)]
    heads = {r.k: (r.n_events, r.head) for r in L.chained(e, "k", ["i"], F.col("c")).collect()}
    last = {r["k"]: r["own_hash"] for r in L.linked(e, "k", ["i"], F.col("c")).where("seq = 5").collect()}
    assert heads == {k: (5, h) for k, h in last.items()}


def test_replay_by_spans_equals_a_plain_loop(spark):
    rnd = random.Random(3)
    moves = {("a", "x"): "b", ("b", "y"): "c", ("c", "x"): "a", ("b", "x"): "b"}
    log = [(k, i, rnd.choice("xyz")) for k in range(4) for i in range(rnd.randint(1, 60))]
    want = {}
    for k in range(4):
        state, refused, first = "a", 0, None
        for _, _, x in sorted(r for r in log if r[0] == k):
            if (state, x) in moves:
                state = moves[state, x]
            else:
                refused, first = refused + 1, first or f"{state} -> {x}"
        want[k] = (state, refused, first)

    def step(state, e):
        to = F.lit(None).cast("string")
        for (a, x), b in moves.items():
            to = F.when((state == a) & (e["kind"] == x), b).otherwise(to)
        return to

    df = spark.createDataFrame(log, "k int, i int, t string")
    for span in (1, 7, 1000):
        rows = fold.replay_spans(df, "k", ["i"], ["a", "b", "c"], "a", step, [F.col("t").alias("kind")], span).collect()
        assert {r.k: (r.state, r.rejected, r.error) for r in rows} == want


def test_no_python_in_plans(spark, sf):
    for name in ("q_verdict", "q_rule_matrix_long", "q_rulebook", "q_state_machine", "q_term_weight_topk"):
        plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_rarest_terms_reads_each_text_once(spark, sf):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan shows what is used again
    try:
        plan = catalogue.QUERIES["q_term_weight_topk"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert plan.count("FileScan") == 1 and plan.count("regexp_extract_all") == 1


def test_rarest_terms_equals_a_plain_count(spark):
    rnd = random.Random(5)
    docs = [(i if i % 9 else None if i % 2 else 3, [f"t{t:02}" for t in sorted({int(rnd.expovariate(0.15)) for _ in range(rnd.randint(0, 12))})]) for i in range(1, 120)] + [(500, None), (501, ["t00"])]
    df = Counter(t for _, terms in docs for t in terms or [])
    own = {}
    for doc, terms in docs:
        own.setdefault(doc, []).extend((df[t], t) for t in terms or [])
    want = Counter((doc, t, n, k) for doc, terms in own.items() for k, (n, t) in enumerate(sorted(terms)[:3], 1))
    rows = spark.createDataFrame(docs, "doc_id long, terms array<string>")
    for least in (0, 2, 10, 1000):  # all terms heavy, most, some, none
        assert Counter(tuple(r) for r in J.rarest_terms(rows, "doc_id", F.col("terms"), 3, 0.0, least).select("doc_id", "term", "df", "k").collect()) == want


def test_significant_terms_of_odd_texts(spark):
    texts = ["Año ÁRBOL arbol Éclair e", "abc abcd-abcde_12345 x", "K\u212aLVIN \u0130stanbul straße señor SEÑOR", "日本語 tokyo\u00a0tower\u2003tower", "a" * 5000 + " " + "ÿ" * 10, "", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").repartition(2)
    split = F.array_distinct(F.filter(F.split(T.fold(F.col("x")), "[^a-z0-9]+"), lambda t: F.length(t) >= 4))
    found = {r.i: (r.got, r.want) for r in rows.select("i", T.significant_terms(F.col("x")).alias("got"), split.alias("want")).collect()}
    assert all(got == want for got, want in found.values())
    assert found[0][0] == ["arbol", "eclair"] and found[1][0] == ["abcd", "abcde", "12345"] and found[6][0] is None


def test_entry_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for name in ("__spark_entry__.py", "proofloom"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    shutil.rmtree(tmp_path / "proofloom/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) == len(e.oracle_sql()) > 40; assert not [q for q in e.queries() if q.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
