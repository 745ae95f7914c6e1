"""Queries of reading documents whole: phrases of a lexicon table, fields by labels, lines of invoices.

The invoices and data sheets that are read are texts which Spark makes of ``orders``, ``customer``, ``lineitem`` and ``part``.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofloom.functions import text as T
from proofloom.operators import fields as D
from proofloom.operators import phrases as P
from proofloom.plans.lexicon import fields
from proofloom.plans.registry import query

c, lit = F.col, F.lit
_FOLD = "trim(regexp_replace(lower(translate({}, '" + T.ACCENTED + "', '" + T.FOLDED + r"')), '[\t\n\x0B\f\r ]+', ' ', 'g'))"
_PLAIN = lambda x: f"trim(regexp_replace({_FOLD.format(f'''coalesce({x}, '')''')}, '[^a-z0-9]+', ' ', 'g'))"

# ---- phrases

_LEXICON = f"""b AS (SELECT item_id, string_split({_PLAIN("text")}, ' ') AS w FROM benchmark), q AS (SELECT item_id, i, w, n FROM b, unnest(range(1, len(w) + 1)) AS t(i), unnest([2, 3]) AS u(n) WHERE i + n - 1 <= len(w)),
x AS (SELECT DISTINCT array_to_string(w[i:i + n - 1], ' ') AS phrase, item_id % 5 AS kind FROM q), d AS (SELECT doc_id, ' ' || {_PLAIN("text")} || ' ' AS t FROM documents),
h AS (SELECT doc_id, phrase, t FROM d JOIN (SELECT DISTINCT phrase FROM x) ON contains(t, ' ' || phrase || ' '))"""


def _lexicon(t):
    words = F.split(F.trim(P.plain_words(c("text"))), " ")
    own = t("benchmark").select((c("item_id") % 5).alias("kind"), words.alias("w"))
    runs = F.flatten(F.array(*[F.transform(F.sequence(lit(1), F.greatest(F.size("w") - n + 1, lit(1))), lambda i: F.when(i + n - 1 <= F.size("w"), F.array_join(F.slice("w", i, n), " "))) for n in (2, 3)]))  # noqa: B023
    return own.select("kind", F.explode(F.array_compact(runs)).alias("phrase")).distinct()


@query(f"""WITH {_LEXICON} SELECT doc_id, count(*) AS n, min(phrase) AS lowest, max(phrase) AS highest, min(length(substr(t, 1, instr(t, ' ' || phrase || ' '))) - length(replace(substr(t, 1, instr(t, ' ' || phrase || ' ')), ' ', '')) - 1)::INT AS first_at FROM h GROUP BY 1""")
def q_phrase_hits(t):
    """The phrases of a lexicon table (all runs of two or three words of ``benchmark``) in all documents, in one pass over each text."""
    hits = P.found(t("documents"), "doc_id", "text", _lexicon(t), "phrase")
    return hits.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("phrase").alias("lowest"), F.max("phrase").alias("highest"), F.min("at").alias("first_at"))


@query(f"""WITH {_LEXICON}, k AS (SELECT kind, count(*) AS n FROM x GROUP BY 1), s AS (SELECT doc_id, kind, count(*) AS said FROM h JOIN x USING (phrase) GROUP BY ALL), r AS (SELECT doc_id, s.kind, said / n AS share FROM s JOIN k ON s.kind = k.kind)
SELECT doc_id, kind, round(share, 9) AS share FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, kind) AS i FROM r WHERE share >= 0.01) WHERE i = 1""")
def q_phrase_class(t):
    """The kind of which a document says the largest share of phrases, by a lexicon table."""
    lexicon = _lexicon(t)
    scored = P.scores(P.found(t("documents"), "doc_id", "text", lexicon, "phrase"), "doc_id", lexicon, "phrase", "kind")
    whole = lexicon.groupBy("kind").agg(F.count("*").alias("n"))
    return P.best_kind(scored, "doc_id", "kind", whole, 0.01).select("doc_id", "kind", F.round("share", 9).alias("share"))


# ---- fields and lines


def _papers(t):
    """(doc_id, kind, text): an invoice of every order, with a row for each of its lineitems, and a data sheet of every part."""
    o, k = c("o_orderkey"), c("c_custkey")
    money = lambda x: F.translate(F.format_number(x.cast("decimal(18,2)"), 2), ",.", ".,")
    parts = t("part").select("p_partkey", "p_name")
    rows = t("lineitem").join(parts, c("l_partkey") == c("p_partkey"))
    head = F.when(c("l_partkey") % 5 == 0, "Variador de velocidad ").when(c("l_partkey") % 5 == 1, "Puesta en marcha de ").when(c("l_partkey") % 5 == 2, "Motor ").otherwise("Material ")
    line = F.concat(head, "p_name", lit(" | "), c("l_quantity").cast("int"), lit(" | "), F.when(c("l_linenumber") == 3, lit("s/n")).otherwise(money(c("l_extendedprice"))))
    rows = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", line.alias("x"))
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice", "x")  # an order's lines, sorted once
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    items = rows.withColumn("items", F.collect_list("x").over(whole)).withColumn("n", F.row_number().over(own)).where("n = 1").select("l_orderkey", "items")
    when = lambda n, yes, no: F.when(o % n == 0, yes).otherwise(no)
    nif = F.concat(lit("B"), k)
    lines = F.concat(
        F.array(
            F.concat(lit("Factura F-"), o), F.concat(lit("Receptor (cliente) | "), "c_name"), when(4, lit("Datos del cliente"), F.concat(lit("NIF del receptor | "), nif)),
            F.concat(when(5, lit("Fecha de pedido | "), lit("Fecha de Factura | ")), F.date_format("o_orderdate", "dd/MM/yyyy")), lit(""),
            F.concat(lit("Nº de variadores facturados | "), when(3, lit("varios"), (o % 6).cast("string"))), lit("Concepto | Unidades | Importe"),
        ),
        F.coalesce("items", F.array().cast("array<string>")),
        F.array(
            F.concat(lit("Total | "), money(c("o_totalprice"))), when(8, lit("El NIF del receptor:"), when(4, F.concat(lit("El NIF, del receptor - "), nif), lit("gracias"))), when(8, nif, lit("fin")),
            when(9, F.concat(lit("Número total de motores: "), o % 7), lit("")),
        ),
    )
    bills = t("orders").join(t("customer"), c("o_custkey") == c("c_custkey")).join(items, c("l_orderkey") == c("o_orderkey"), "left")
    bills = bills.select(F.concat(lit("o"), o).alias("doc_id"), lit("factura").alias("kind"), F.array_join(lines, "\n").alias("text"))
    p = c("p_partkey")
    two = F.when(p % 2 == 0, F.concat(lit("\nNº de serie del motor | MTR-"), 1000 + p % 9000, lit("-B\npotencia nominal PM | 7,50 kW"))).otherwise("")
    rated = F.when(p % 3 == 0, F.concat(lit("Potencia nominal  | n/d\nLa potencia nominal es de "), "p_size", lit(",5 kW"))).otherwise(F.concat(lit("POTENCIA NOMINAL | "), "p_size", lit(",5 kW")))
    sheets = t("part").select(F.concat(lit("p"), p), lit("ficha_tecnica_motor"), F.concat(lit("Nº de serie del motor | MTR-"), 1000 + p % 9000, lit("-AB\n"), rated, lit("\nVelocidad nominal n1 | 1.485 rpm"), two))
    return bills.union(sheets)


def _opens(x):
    return x.startswith("Concepto" + D.CELLS) & x.endswith("Importe")


def _closes(x):
    return x.startswith("Total" + D.CELLS)


def _lines(t):
    return D.lines_and_islands(_papers(t), "doc_id", "text", _opens, _closes, "kind")


@query("""WITH o AS (SELECT o_orderkey AS o, o_custkey AS k, c_name, o_orderdate, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey),
f AS (SELECT 'o' || o AS doc_id, 'titular_razon_social' AS variable, c_name AS value, 'table' AS method, NULL AS key, 1 AS row FROM o UNION ALL SELECT 'o' || o, 'fecha_inicio_actuacion', strftime(o_orderdate, '%Y-%m-%d'), 'table', NULL, 3 FROM o
UNION ALL SELECT 'o' || o, 'titular_nif', 'B' || k, CASE WHEN o % 4 = 0 THEN 'text' ELSE 'table' END, NULL, CASE WHEN o % 4 = 0 THEN 8 + n ELSE 2 END FROM o
UNION ALL SELECT 'o' || o, 'n_motores', CASE WHEN o % 3 = 0 THEN (o % 7)::VARCHAR ELSE (o % 6)::VARCHAR END, CASE WHEN o % 3 = 0 THEN 'text' ELSE 'table' END, NULL, CASE WHEN o % 3 = 0 THEN 10 + n ELSE 5 END FROM o WHERE o % 3 <> 0 OR o % 9 = 0
UNION ALL SELECT 'p' || p_partkey, 'num_serie_motor', 'MTR-' || (1000 + p_partkey % 9000) || '-AB', 'table', 'MTR-' || (1000 + p_partkey % 9000) || '-AB', 0 FROM part
UNION ALL SELECT 'p' || p_partkey, 'N1', '1485', 'table', 'MTR-' || (1000 + p_partkey % 9000) || '-AB', CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 2 END FROM part
UNION ALL SELECT 'p' || p_partkey, 'PM', p_size || '.5', 'table', 'MTR-' || (1000 + p_partkey % 9000) || '-AB', 1 FROM part WHERE p_partkey % 3 <> 0
UNION ALL SELECT 'p' || p_partkey, 'PM', p_size || '.5', 'text', NULL, 1 FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 <> 0
UNION ALL SELECT 'p' || p_partkey, 'num_serie_motor', 'MTR-' || (1000 + p_partkey % 9000), 'table', 'MTR-' || (1000 + p_partkey % 9000), CASE WHEN p_partkey % 3 = 0 THEN 4 ELSE 3 END FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT 'p' || p_partkey, 'PM', '7.50', 'table', 'MTR-' || (1000 + p_partkey % 9000), CASE WHEN p_partkey % 3 = 0 THEN 5 ELSE 4 END FROM part WHERE p_partkey % 2 = 0)
SELECT doc_id, variable, value, method, key, row::INT AS row FROM f""")
def q_extracted_fields(t):
    """Facts of all invoices and data sheets by the lexicon of fields: tables first, inherited keys, then labelled text for what no table gave."""
    spark = t("region").sparkSession
    return D.facts(_papers(t), "doc_id", "kind", "text", _opens, _closes, fields(spark)).select("doc_id", "variable", "value", "method", "key", "row")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity::INT AS q, CASE WHEN l_linenumber <> 3 THEN l_extendedprice::DECIMAL(18,2) END AS a,
CASE WHEN l_partkey % 5 = 1 THEN 'instalacion' WHEN l_partkey % 5 = 0 THEN 'variador' WHEN l_partkey % 5 = 2 THEN 'motor' ELSE 'otro' END AS kind FROM lineitem)
SELECT 'o' || l_orderkey AS doc_id, count(*) AS n, sum(q)::BIGINT AS units, sum(a)::DOUBLE AS amount, count(*) FILTER (a IS NULL) AS unreadable, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds,
arg_max(kind, (coalesce(a, 0), -l_linenumber, -l_partkey, -l_extendedprice)) AS largest FROM l GROUP BY 1""")
def q_invoice_lines(t):
    """The lines between the head and the total of each invoice: how many, of what kinds, their amounts, and which is the largest."""
    signals = {"instalacion": ("puesta en marcha",), "variador": ("variador",), "motor": ("motor",)}
    said, kind = T.fold(c("text")), F.lit(None).cast("string")
    for name, words in reversed(signals.items()):
        for w in words:
            kind = F.when(said.contains(w), name).otherwise(kind)
    rows = D.line_items(_lines(t), "doc_id", F.coalesce(kind, lit("otro")))
    total = lambda name: F.aggregate(F.filter(F.transform("items", lambda x: x[name]), lambda v: v.isNotNull()), lit(0).cast("decimal(28,4)"), lambda a, v: (a + v).cast("decimal(28,4)"))
    best = F.array_max(F.transform("items", lambda x: F.struct(F.coalesce(x["amount"], lit(0)).alias("a"), (-x["row"]).alias("r"), x["kind"].alias("kind"))))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("items", lambda x: x["kind"]))), ",")
    return rows.select(
        "doc_id", F.size("items").cast("long").alias("n"), total("quantity").cast("long").alias("units"), F.when(F.exists("items", lambda x: x["amount"].isNotNull()), total("amount")).cast("double").alias("amount"),
        F.size(F.filter("items", lambda x: x["amount"].isNull())).cast("long").alias("unreadable"), kinds.alias("kinds"), best["kind"].alias("largest"),
    )
