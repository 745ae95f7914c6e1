"""Sources, sinks and streams: what is written is what is read, and a stream says what a batch says."""

import hashlib

import pytest
from pyspark.sql import functions as F

from proofloom.operators import export as X
from proofloom.operators import log as L
from proofloom.operators import lookup as U
from proofloom.plans.catalogue import MOVES
from proofloom.sources import files, jsonl, reports, tables, tree
from proofloom.streaming import journal as stream


def test_files_by_content(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, content in {"b.txt": "x\ny", "a.txt": "x\ny", "sub/c.pdf": "%PDF", ".hidden": "no", "~d.txt": "no", "e.tmp": "no"}.items():
        (tmp_path / name).write_text(content)
    found = {r.doc_id: r for r in files.ingested(files.files_of(spark, str(tmp_path))).collect()}
    text, pdf = (hashlib.sha256(x).hexdigest() for x in (b"x\ny", b"%PDF"))
    assert set(found) == {text, pdf} and found[text].path.endswith("a.txt") and found[text].n_lines == 2
    assert found[pdf].warning == "no reader for pdf" and found[pdf].n_lines is None
    part = spark.range(1).select(files.part_id(F.lit("d"), F.lit(2), F.lit(5))).first()[0]
    assert part == hashlib.sha256(b"d:p2-5").hexdigest()


def test_combined_documents_are_read_in_parts(spark, tmp_path):
    texts = {"a.txt": "cover\fBILL 1\nx\fmore\fBILL 2", "b.txt": "BILL 3\fend", "c.md": "plain", "d.txt": "plain", "e.pdf": "BILL\fBILL", "f.txt": ""}
    for name, content in texts.items():
        (tmp_path / name).write_text(content)
    pages = files.pages_of(files.files_of(spark, str(tmp_path)))
    found = {(r.doc_id, r.first): r for r in files.read_documents(pages, F.col("text").startswith("BILL")).collect()}
    sha = {n: hashlib.sha256(t.encode()).hexdigest() for n, t in texts.items()}
    part = lambda n, i, p: hashlib.sha256(f"{sha[n]}:p{i}-{p}".encode()).hexdigest()
    assert {k: (r.id, r.last, r.text) for k, r in found.items() if k[0] != sha["f.txt"]} == {
        (sha["a.txt"], 2): (part("a.txt", 1, 2), 3, "BILL 1\nx\fmore"), (sha["a.txt"], 4): (part("a.txt", 2, 4), 4, "BILL 2"),
        (sha["b.txt"], 1): (sha["b.txt"], 2, "BILL 3\fend"), (sha["c.md"], 1): (sha["c.md"], 1, "plain"),
    }


def tree_of(folder):
    return {str(p.relative_to(folder)): (p.read_bytes(), p.stat().st_mtime_ns) for p in folder.rglob("*") if p.is_file() and not any(x.startswith(".") for x in p.relative_to(folder).parts)}


def test_hand_off_writes_a_tree_and_reads_it_again(spark, tmp_path):
    out = tmp_path / "out"
    rows = spark.createDataFrame([("case=1/report.md", "a"), ("case=1/data/x.json", "{}"), ("case=2/report.md", "ñ"), ("case=2/report.md", "ñ"), ("empty.txt", None)], "p string, text string").repartition(3)
    first = {tuple(r) for r in tree.hand_off(rows, str(out), "p", "text").collect()}
    paths = ["case=1/report.md", "case=1/data/x.json", "case=2/report.md", "empty.txt"]
    assert first == {(p, "moved", "ok") for p in paths}
    before = tree_of(out)
    assert {k: v for k, (v, _) in before.items()} == {"case=1/report.md": b"a", "case=1/data/x.json": b"{}", "case=2/report.md": "ñ".encode(), "empty.txt": b""}
    assert {tuple(r) for r in tree.hand_off(rows, str(out), "p", "text").collect()} == {(p, "kept", "ok") for p in paths}
    assert tree_of(out) == before  # a second run touches no file
    less = rows.where("p like 'case=1%'").withColumn("text", F.concat("text", F.lit("!")))
    assert {tuple(r) for r in tree.hand_off(less, f"file://{out}", "p", "text").collect()} == {(p, "moved", "ok") for p in paths[:2]} | {(paths[2], None, "extra")}
    assert not list(out.glob(".staging/*"))


def test_a_hand_off_that_fails_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    rows = spark.range(200).selectExpr("concat('d', id, '/f.txt') as p", "if(id = 177, raise_error('half way'), string(id)) as text").repartition(2)
    two = spark.createDataFrame([("a", "1"), ("a", "2")], "p string, text string")
    bad = [spark.createDataFrame([("ok", "1"), (p, "2")], "p string, text string") for p in ("../x", "/x", "", None, "a/../../x", ".hidden", "a//b")]
    for df in (rows, two, *bad):
        with pytest.raises(Exception, match=r"half way|several contents|no path"):
            tree.hand_off(df, str(out), "p", "text")
        assert tree_of(out) == {} and not list(out.glob(".staging/*"))


def test_a_log_that_is_appended_twice_has_every_event_once(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value").where("user_id < 10")
    path = str(tmp_path / "log")
    part = events.where("event_id % 2 = 0")
    jsonl.append_once(part.union(part), path)
    assert jsonl.read_log(spark, path).count() == part.count()
    for _ in range(2):
        jsonl.append_once(events, path)
        assert jsonl.read_log(spark, path).count() == events.count() == jsonl.read_log(spark, path).select("event_id").distinct().count()
    jsonl.append_once(events.where("1 = 0"), path)
    assert jsonl.read_log(spark, path).count() == events.count()


def test_reference_tables_are_checked(spark, tmp_path):
    spec = tables.TableSpec("losses", "kw", "loss", {"kw": "int", "loss": "decimal(9,3)"})

    def write(text):
        path = tmp_path / f"{abs(hash(text))}.csv"
        path.write_text(text)
        return str(path)

    rows, warnings = tables.read_table(spark, write("kw,loss\n90,4.0\n110,5.55\n"), spec)
    assert [(r.kw, float(r.loss)) for r in rows.orderBy("kw").collect()] == [(90, 4.0), (110, 5.55)] and warnings == []
    assert tables.read_table(spark, write("kw,loss\n90,4.0\n110,3\n"), spec)[1]
    for bad in ("loss,kw\n1,2\n", "kw,loss\n90,x\n", "kw,loss\n90,1\n90,2\n", "kw,loss\n90,-1\n", "kw,loss\n,4.0\n", "kw,loss\n90,\n", "kw,loss\n90,4\n,\n"):
        with pytest.raises(tables.TableError):
            tables.read_table(spark, write(bad), spec)
    assert tables.undeclared(spec, {"kw", "price"}) == ["price"]


@pytest.mark.parametrize("n", [0, 1, 3, 900])
def test_interpolation_in_large_tables_equals_the_broadcast_way(spark, n):
    table = spark.range(n).selectExpr("cast(id * id as double) as k", "cast(id * 7 % 11 as double) as v")
    rows = spark.range(2000).selectExpr("cast(id * 13 % 1999 as double) * case when id % 5 = 0 then 300 else 7 end as x").union(spark.createDataFrame([(None,), (0.0,), (0.0,)], "x double"))
    one, two = (sorted((str(r.x), str(None if r.f is None else round(r.f, 6))) for r in U.interpolate(rows, "x", table, "k", "v", "f", most).collect()) for most in (10_000, -1 if n == 0 else 0))
    assert one == two


@pytest.fixture
def rocks(spark):
    from proofloom.streaming.ordered import PROVIDER

    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    yield
    spark.conf.set(name, old)


def ran(df, name, mode, folder):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(folder / name)).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return len(q.recentProgress)


def events_of(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value").where("user_id < 20")


def test_log_of_lines_and_its_stream(spark, sf, tmp_path, rocks):
    """Chains and states that are carried on over several batches are those of the whole log."""
    events = events_of(spark, sf)
    content = F.concat_ws(":", "event_id", "event_type")
    stored = L.linked(events, "user_id", ["ts", "event_id"], content)
    t1, t2 = events.agg(F.percentile_approx("ts", F.array(F.lit(0.3), F.lit(0.7)))).first()[0]
    for part in (F.col("ts") < t1, (F.col("ts") >= t1) & (F.col("ts") < t2), F.col("ts") >= t2):
        jsonl.write_log(stored.where(part), str(tmp_path / "log"))
    back = jsonl.read_log(spark, str(tmp_path / "log"))
    assert back.count() == events.count() and L.broken_links(back, "user_id", content).isEmpty()
    assert L.broken_links(back.withColumn("event_type", F.when(F.col("seq") == 2, "x").otherwise(F.col("event_type"))), "user_id", content).count() > 0

    assert ran(stream.carried(jsonl.stream_log(spark, str(tmp_path / "log"), files_a_time=1), MOVES, "OPEN"), "carried", "append", tmp_path) > 2
    live = spark.table("carried")
    heads = {r.user_id: (r.n_events, r.head) for r in L.chained(events, "user_id", ["ts", "event_id"], content).collect()}
    last = live.groupBy("user_id").agg(F.max("seq").alias("n"), F.max_by("own_hash", "seq").alias("h"), F.max_by("state", "seq").alias("state"), F.count_if(~F.col("accepted")).alias("rejected")).collect()
    assert {r.user_id: (r.n, r.h) for r in last} == heads
    replayed = {r.user_id: (r.state, r.rejected) for r in L.replay(events, "user_id", ["ts", "event_id"], "OPEN", MOVES, "event_type").collect()}
    assert {r.user_id: (r.state, r.rejected) for r in last} == replayed


def test_streams_drop_repeats_over_batches(spark, sf, tmp_path):
    events = events_of(spark, sf)
    jsonl.write_log(events, str(tmp_path / "log"))
    jsonl.write_log(events.where("event_id % 2 = 0"), str(tmp_path / "log"))  # again, in later batches
    assert ran(stream.once(jsonl.stream_log(spark, str(tmp_path / "log"), files_a_time=1), "40 days"), "once", "append", tmp_path) >= 2
    assert spark.table("once").count() == events.count()


def test_windows_close_and_what_is_too_late_is_left_out(spark, tmp_path):
    from datetime import datetime

    at = lambda day, hour: datetime(2024, 1, day, hour)
    batches = [[(1, at(1, 1), "a"), (2, at(1, 20), "b")], [(3, at(2, 5), "a"), (4, at(1, 23), "a")], [(5, at(3, 12), "a")], [(7, at(3, 13), "b")], [(6, at(1, 2), "a")], [(8, at(5, 0), "a")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame([(e, t, 1, k, 1.0) for e, t, k in rows], "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "in" / f"p={i}"))
    source = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p=*"))
    assert ran(stream.counted(source, "1 day", "6 hours"), "counted", "append", tmp_path) >= 5
    found = {(r.start.day, r.event_type): r.n for r in spark.table("counted").collect()}
    assert found == {(1, "a"): 2, (1, "b"): 1, (2, "a"): 1, (3, "a"): 1, (3, "b"): 1}  # the late event of the first day came after it had closed; the fifth day is open


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "a|b")], "k int, total decimal(9,2), name string")
    report = reports.markdown(F.concat(F.lit("Case "), F.col("k")), {"Facts": {"total": F.col("total"), "name": F.col("name")}})
    assert rows.select(report).first()[0].splitlines() == ["# Case 1", "", "## Facts", "", "| name | value |", "|-|-|", "| total | no data |", "| name | a\\|b |"]
    assert rows.select(reports.as_json({"b": F.col("k"), "a": F.lit(1.5).cast("decimal(4,2)")})).first()[0] == '{"a":"1.50","b":"1"}'
    reports.write_reports(rows, "k", report, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().key == 1


def test_mappings_are_checked_when_loaded():
    assert X.load_mapping({"a": "case.id"}, {"case"}) == {"a": "case.id"}
    with pytest.raises(X.UnknownField):
        X.load_mapping({"a": "cas.id"}, {"case"})


def test_late_reports_enter_the_log_in_order(spark, tmp_path, rocks):
    """A stream of several batches in shuffled arrival says what the same reports say in order; refusals are rows."""
    import random
    from datetime import datetime, timedelta

    from proofloom.streaming import ordered

    rnd = random.Random(4)
    moves = {("OPEN", "a"): "ACTIVE", ("ACTIVE", "b"): "READY", ("READY", "c"): "SENT", ("SENT", "a"): "OPEN"}
    begin = datetime(2024, 1, 1)
    rows = [(k, begin + timedelta(minutes=rnd.randrange(600)), rnd.randrange(2), rnd.choice("abcd")) for k in range(5) for _ in range(40)]
    rows += rnd.sample(rows, 30)  # alike reports
    rows.sort(key=lambda r: r[1] + timedelta(minutes=rnd.randrange(100)))  # up to 100 minutes late
    rows = [(k, at, {"a": 0, "b": 0}.get(kind, 1), i, kind) for i, (k, at, _, kind) in enumerate(rows)]
    schema = "case_id long, at timestamp, rank int, arrival long, kind string"
    log = tmp_path / "log"
    parts = [rows[i : i + 30] for i in range(0, len(rows), 30)] + [[(99, begin + timedelta(days=9), 0, 10**6, "a")], [(99, begin + timedelta(days=10), 0, 10**6, "a")]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(log / f"p={i:03d}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(log / "p=*"))
    assert ran(ordered.in_order(source, moves, "OPEN", "101 minutes"), "ordered", "append", tmp_path) > 5
    first = {}
    for k, at, rank, arrival, kind in rows:
        first[k, at, kind] = min(first.get((k, at, kind), (rank, arrival)), (rank, arrival))
    want = []
    for k in range(5):
        state = "OPEN"
        own = sorted((at, rank, arrival, kind) for (c, at, kind), (rank, arrival) in first.items() if c == k)
        for i, (at, _, arrival, kind) in enumerate(own, 1):
            to = moves.get((state, kind))
            state = to or state
            want.append((k, i, at, kind, arrival, state, to is not None))
    found = [(r.case_id, r.seq, r["at"], r.kind, r.arrival, r.state, r.accepted) for r in spark.table("ordered").where("case_id < 99").collect()]
    assert sorted(found) == sorted(want)
    assert {r[-1] for r in want} == {True, False}
