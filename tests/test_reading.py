"""Phrases by automaton and by equality, fields by labels, islands of lines, on literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from proofloom.operators import fields as D
from proofloom.operators import phrases as P
from proofloom.plans.lexicon import field_rows, fields


@pytest.mark.parametrize("most", [P.MOST_CHARS, 0])
def test_phrases(spark, most):
    rnd = random.Random(3)
    words = ["a", "b", "año", "c-d", "E", "x1"]
    texts = [(i, " ".join(rnd.choice(words) + rnd.choice(["", ",", "\n"]) for _ in range(rnd.randint(0, 40)))) for i in range(60)] + [(100, None), (101, ""), (102, "a" * 5000), (103, "b a b a b")]
    phrases = {" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))) for _ in range(200)} | {"", "...", "nowhere at all", "b a b"}
    docs = spark.createDataFrame(texts, "k long, text string").repartition(3)
    lexicon = spark.createDataFrame([(p,) for p in phrases], "p string")
    plain = {r.x: r.y for r in spark.createDataFrame([(x,) for x in {t for _, t in texts if t is not None} | phrases], "x string").select("x", F.trim(P.plain_words(F.col("x"))).alias("y")).collect()}
    want = set()
    for k, t in texts:
        w = plain.get(t, "").split()
        for p in {plain[p] for p in phrases} - {""}:
            q = p.split()
            at = next((i for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q), None)
            if at is not None:
                want.add((k, p, at))
    assert {tuple(r) for r in P.found(docs, "k", "text", lexicon, "p", most).select("k", "phrase", "at").collect()} == want
    assert P.found(docs, "k", "text", lexicon.where("p = '...'"), "p", most).count() == 0


def test_best_kind(spark):
    lexicon = spark.createDataFrame([("a b", "x"), ("c", "x"), ("C ", "y"), ("d", "z"), ("e", "z"), ("f", "z")], "p string, kind string")
    docs = spark.createDataFrame([(1, "A, b; c"), (2, "d e"), (3, "c d"), (4, "none")], "k int, text string")
    scored = P.scores(P.found(docs, "k", "text", lexicon, "p"), "k", lexicon, "p", "kind")
    whole = spark.createDataFrame([("x", 2), ("y", 1), ("z", 3)], "kind string, n int")
    assert {r.k: (r.kind, round(r.share, 3)) for r in P.best_kind(scored, "k", "kind", whole, 0.5).collect()} == {1: ("x", 1.0), 2: ("z", 0.667), 3: ("y", 1.0)}
    assert {r.k: r.kind for r in P.best_kind(scored, "k", "kind").collect()} == {1: "x", 2: "z", 3: "x"}


LEXICON = """
bill; total; number; shown; amount due | amount
bill; day; date; shown; day of issue
bill; unit*; serial; shown; serial
bill; name; text; shown; customer name
"""


def read(spark, *texts):
    docs = spark.createDataFrame([(i, "bill", t) for i, t in enumerate(texts)], "d int, kind string, text string")
    lines = D.with_islands(D.lines_of(docs, "d", "text", "kind"), "d", F.col("line").startswith("Item |"), F.col("line").startswith("Total |"))
    return lines, sorted(tuple(r) for r in D.extracted(lines, "d", "kind", fields(spark, LEXICON)).select("d", "variable", "value", "method", "key", "row").collect())


def test_tables_come_before_text_and_the_first_candidate_that_converts_counts(spark):
    texts = [
        "Amount | none\nAMOUNT DUE | 1.200,50 EUR\nThe amount due: 7",  # a cell that converts counts, one that doesn't is passed over
        "the amount due is unknown\n1.000\namount: 5",  # first label in order, its next line
        "amount due, none\nnothing\nAmount 5 paid",  # of each label only the first line counts, and neither converts
        "Serial | MTR-1A\nDay of issue | 1/2/2024\nSERIAL | VSD-22\nAmount | 3",  # keys are inherited by what stands below
        "Item | units | price\nAmount | 3\nTotal | 9",  # a line of an island is no row of labels, but it is text
        "Customer   name |  A  B \nday 2024-02-03 of issue",
        "customer\nname",  # words of different lines
        None,
    ]
    _, found = read(spark, *texts)
    assert found == [
        (0, "total", "1200.50", "table", None, 1),
        (1, "total", "1000", "text", None, 0),
        (3, "day", "2024-02-01", "table", "MTR-1A", 1),
        (3, "total", "3", "table", "VSD-22", 3),
        (3, "unit", "MTR-1A", "table", "MTR-1A", 0),
        (3, "unit", "VSD-22", "table", "VSD-22", 2),
        (4, "total", "3", "text", None, 1),
        (5, "name", "A B", "table", None, 0),
    ]


def test_islands_of_lines(spark):
    lines, _ = read(spark, "x | 1 | 2\nItem | n | p\na | 2 | 1.000,5\nnot a cell\nb | x | y\nTotal | 3\nc | 1 | 1\nItem |\nd | 1 | 7", "Item |", "")
    rows = D.line_items(lines, "d", F.upper("text")).collect()
    found = {(r.d, r.island): [(x.row, x.text, None if x.quantity is None else float(x.quantity), None if x.amount is None else float(x.amount), x.kind) for x in r["items"]] for r in rows}
    assert found == {(0, 1): [(2, "a", 2.0, 1000.5, "A"), (4, "b", None, None, "B")], (0, 2): [(8, "d", 1.0, 7.0, "D")]}


def test_the_lexicon_of_fields_is_whole(spark):
    rows = field_rows()
    assert len(rows) == len({(r[0], r[1]) for r in rows}) > 50 and {r[3] for r in rows} == {"number", "integer", "date", "text", "serial", "hash", "code"}
    assert {r[2] for r in rows if r[7]} == {"num_serie_motor", "num_serie_variador"}
    assert fields(spark).where("label <> lower(label)").count() == 0


def test_texts_and_hits_are_held_in_bounded_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(P, "MOST_READ", 10)
    monkeypatch.setattr(P, "MOST_HITS", 2)

    class Sent:
        value = ("pieces", [" a ", " b ", " c "])

    texts = [" a b c ", " c ", None, " ", " b a " * 9, " a "]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array([t if t is not None else " " for t in texts])], ["row", "text"])
    pieces = list(P._scan(iter([batch]), Sent()))
    assert max(p.num_rows for p in pieces) <= 2
    assert [tuple(r.values()) for p in pieces for r in p.to_pylist()] == [(0, "a", 0), (0, "b", 1), (0, "c", 2), (1, "c", 0), (4, "b", 0), (4, "a", 1), (5, "a", 0)]
    assert [r for r, _ in P._texts(batch)] == list(range(6))


def test_islands_are_told_in_a_documents_own_row(spark):
    rnd = random.Random(5)
    texts = [(i, "\n".join(rnd.choice(["o | x", "c | y", "oc", "", "a | 1 | 2", "b"]) for _ in range(rnd.randint(1, 12)))) for i in range(200)] + [(200, None), (201, ""), (202, "o | x"), (None, "o\na")]
    docs = spark.createDataFrame(texts, "d int, text string").withColumn("kind", F.lit("k")).repartition(3)
    opens, closes = lambda x: x.startswith("o"), lambda x: x.endswith("c") | x.startswith("c")
    want = D.with_islands(D.lines_of(docs, "d", "text", "kind"), "d", opens(F.col("line")), closes(F.col("line")))
    found = D.lines_and_islands(docs, "d", "text", opens, closes, "kind")
    assert want.columns == found.columns
    assert sorted(map(str, (tuple(r) for r in want.collect()))) == sorted(map(str, (tuple(r) for r in found.collect())))
    alone = docs.sparkSession.createDataFrame([(1, "a", "k")], "d int, text string, kind string")
    assert "Exchange" not in str(D.lines_and_islands(alone, "d", "text", opens, closes, "kind")._jdf.queryExecution().executedPlan())


MORE = """
bill; part*; serial; shown; nº de serie | º
bill; n; integer; declared; número total (de piezas) | the | amount
bill; n; code; declared; code
note; total; number; declared; total (all) | serial
note; hash; hash; shown; (x)
"""


def test_facts_of_a_documents_own_row_are_those_of_its_lines(spark):
    rnd = random.Random(7)
    labels = ["amount due", "Amount", "day of issue", "serial", "SERIAL", "nº de serie", "Nº  de serie", "no de serie", "customer name", "Número total (de piezas)", "the", "code", "total (all)", "(x)", "º", "piezas de número total", ""]
    values = ["7", "1.200,50 EUR", "3,5", "1,2,3", "1/2/2024", "2024-02-03", "MTR-1A", "VSD-22-B", "B123", "n/d", "", "  A  B ", "ab" * 32, "-5", "日本", "| 9", "4 | 5", "."]
    others = ["Item | n | p", "Item |", "Total | 9", "Total | ", "", " ", "|", " | ", "a | | b", "\tAmount | 3\r", "amount", "due"]
    line = lambda: rnd.choice(others) if rnd.random() < 0.2 else rnd.choice(labels) + rnd.choice([" | ", ": ", " ", " - ", "| ", " |  "]) + rnd.choice(values)
    texts = [(i, rnd.choice(["bill", "bill", "note", "other", None]), "\n".join(line() for _ in range(rnd.randint(0, 12)))) for i in range(600)]
    texts += [(1000, "bill", None), (1001, "note", ""), (1002, None, "Amount | 3"), (1003, "bill", "\n".join(line() for _ in range(2000)))]
    docs = spark.createDataFrame(texts, "d int, kind string, text string").repartition(3)
    lexicon = fields(spark, LEXICON + MORE.lstrip())
    opens, closes = lambda x: x.startswith("Item |"), lambda x: x.startswith("Total |")
    want = D.extracted(D.lines_and_islands(docs, "d", "text", opens, closes, "kind"), "d", "kind", lexicon)
    told = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    found = D.facts(docs, "d", "kind", "text", opens, closes, lexicon)
    assert found.columns == want.columns and [f.dataType for f in found.schema] == [f.dataType for f in want.schema]
    assert told(found) == told(want) == told(D.facts(docs, "d", "kind", "text", opens, closes, lexicon, 1))
    assert {r.method for r in found.collect()} == {"table", "text"}


def test_facts_move_no_lines(spark):
    docs = spark.createDataFrame([(1, "bill", "Amount | 3")], "d int, kind string, text string")
    plan = D.facts(docs, "d", "kind", "text", lambda x: x.startswith("o"), lambda x: x.startswith("c"), fields(spark, LEXICON))
    assert "hashpartitioning(d" not in str(plan._jdf.queryExecution().executedPlan())


def test_ordinals_in_text_are_letters(spark):
    docs = spark.createDataFrame([(1, "bill", "Nº: MTR-1A, the second")], "d int, kind string, text string")
    lexicon = fields(spark, "bill; unit*; serial; shown; nº")
    never = lambda x: x.startswith("Item |")
    for found in (D.facts(docs, "d", "kind", "text", never, never, lexicon), D.extracted(D.lines_and_islands(docs, "d", "text", never, never, "kind"), "d", "kind", lexicon)):
        assert [tuple(r) for r in found.collect()] == [(1, "unit", "MTR-1A", "shown", "text", None, 0)]
