"""Queries that carry every operator onto the star-schema tables, each next to the SQL that says the same.

Orders stand for cases, lineitems for their units, events for the event log (a user is a case), parts for declared values, documents
for documents, customers, nations and regions for who may see what.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofloom.functions import text as T
from proofloom.functions import three_valued as K
from proofloom.operators import consolidate as C
from proofloom.operators import journal as J
from proofloom.operators import log as L
from proofloom.operators import lookup as U
from proofloom.operators import metrics as M
from proofloom.operators import series as S
from proofloom.operators import verdict as V
from proofloom.plans import casework, exchange, extraction, followup, journal, mapping, platform, reading, rulecase  # noqa: F401  their queries join the catalogue
from proofloom.plans.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

c, lit = F.col, F.lit
MONEY = "decimal(18,4)"

# ---- three-valued logic


@query("""SELECT l_orderkey, CASE WHEN count(*) FILTER (q > 45) > 0 THEN 'FAIL' WHEN count(*) FILTER (q IS NULL) > 0 THEN 'NOT_EVALUABLE' ELSE 'PASS' END AS result
FROM (SELECT l_orderkey, nullif(l_quantity, 7) AS q FROM lineitem) GROUP BY l_orderkey""")
def q_kleene_all(t):
    """All units hold: false, else open, else true."""
    ok = K.all_rows(F.nullif(c("l_quantity"), lit(7.0)) <= 45)
    return t("lineitem").groupBy("l_orderkey").agg(F.when(ok, "PASS").when(~ok, "FAIL").otherwise("NOT_EVALUABLE").alias("result"))


@query("""SELECT a, b, count(*) AS n, a AND b AS both_hold, a OR b AS one_holds, NOT a AS not_a, NOT a OR b AS implied FROM
(SELECT nullif(l_returnflag, 'N') = 'R' AS a, nullif(l_linestatus, 'O') = 'F' AS b FROM lineitem) GROUP BY ALL""")
def q_kleene_and_or(t):
    """And, or, not and implication over open values."""
    rows = t("lineitem").select((F.nullif(c("l_returnflag"), lit("N")) == "R").alias("a"), (F.nullif(c("l_linestatus"), lit("O")) == "F").alias("b"))
    rows = rows.groupBy("a", "b").agg(F.count("*").alias("n"))
    return rows.select("a", "b", "n", (c("a") & c("b")).alias("both_hold"), (c("a") | c("b")).alias("one_holds"), (~c("a")).alias("not_a"), (~c("a") | c("b")).alias("implied"))


@query("""SELECT CASE WHEN 5 < q AND q <= 40 THEN 'yes' WHEN NOT (5 < q AND q <= 40) THEN 'no' ELSE 'open' END AS inside, count(*) AS n
FROM (SELECT nullif(l_quantity, 40) AS q FROM lineitem) GROUP BY 1""")
def q_chain_compare(t):
    """A chained comparison with an open bound."""
    q = F.nullif(c("l_quantity"), lit(40.0))
    inside = (q > 5) & (q <= 40)
    return t("lineitem").groupBy(F.when(inside, "yes").when(~inside, "no").otherwise("open").alias("inside")).agg(F.count("*").alias("n"))


@query("""SELECT p_type, count(*) FILTER (list_contains(list_filter([nullif(p_size % 3, 0), 1], lambda e: e IS NOT NULL), p_size % 2)) AS n FROM part GROUP BY p_type""")
def q_in_list_nullsafe(t):
    """Membership that ignores open items of the list."""
    found = K.in_list(c("p_size") % 2, F.array(F.nullif(c("p_size") % 3, lit(0)), lit(1)))
    return t("part").groupBy("p_type").agg(F.count_if(found).alias("n"))


@query("""SELECT o_orderpriority, count(*) AS n FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_discount > 0.08) GROUP BY 1""")
def q_exists_where(t):
    """Some unit holds: a semi join."""
    bad = t("lineitem").where("l_returnflag = 'R' and l_discount > 0.08").select("l_orderkey")
    return t("orders").join(bad, c("o_orderkey") == c("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT o_orderpriority, count(*) AS n FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND NOT l_tax < 0.05) GROUP BY 1""")
def q_all_implication(t):
    """All units fulfil an implication: an anti join with those that don't."""
    bad = t("lineitem").where((c("l_returnflag") == "R") & ~(c("l_tax") < 0.05)).select("l_orderkey")
    return t("orders").join(bad, c("o_orderkey") == c("l_orderkey"), "left_anti").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, CASE WHEN count(*) FILTER (q IS NULL) = 0 THEN count(*) FILTER (q > 30) END AS n,
(CASE WHEN count(*) = count(q) THEN sum(q) END)::DOUBLE AS total, CASE WHEN count(q) > 0 THEN min(q) = max(q) END AS one_value
FROM (SELECT l_orderkey, nullif(l_quantity, 13)::DECIMAL(18,4) AS q FROM lineitem) GROUP BY l_orderkey""")
def q_guarded_aggregates(t):
    """Count, sum and uniqueness that stay open where a row is."""
    q = F.nullif(c("l_quantity"), lit(13.0)).cast(MONEY)
    n = F.when(F.count_if(q.isNull()) == 0, F.count_if(q > 30))
    return t("lineitem").groupBy("l_orderkey").agg(n.alias("n"), K.sum_rows(q).cast("double").alias("total"), K.unique_rows(q).alias("one_value"))


@query("""SELECT p_brand, sum(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END) AS total FROM (SELECT p_brand, nullif(p_size, 9) AS a, nullif(p_partkey % 50, 3) AS b FROM part) GROUP BY 1""")
def q_least_nullprop(t):
    """The least of several, open if one is."""
    least = K.least_known(F.nullif(c("p_size"), lit(9)).cast("long"), F.nullif(c("p_partkey") % 50, lit(3).cast("long")))
    return t("part").groupBy("p_brand").agg(F.sum(least).alias("total"))


@query("""WITH a AS (SELECT l_orderkey, list(nullif(l_linenumber, 2)) AS x FROM lineitem GROUP BY 1)
SELECT count(*) FILTER (len(x) > 0 AND len(list_filter(x, lambda e: e > 6)) > 0) AS some_over,
count(*) FILTER (len(list_filter(x, lambda e: e IS NULL)) = 0 AND len(list_filter(x, lambda e: e > 3)) > 1) AS two_over,
count(*) FILTER (len(list_distinct(x)) = 1) AS one_value, count(*) FILTER (len(list_filter(x, lambda e: NOT e < 7)) = 0 AND len(list_filter(x, lambda e: e IS NULL)) = 0) AS all_below FROM a""")
def q_quantified_lists(t):
    """Exists, count, unique and for-each over the list of a case's units."""
    a = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.nullif(c("l_linenumber"), lit(2)).alias("v"))).alias("x")).select(F.transform("x", lambda e: e["v"]).alias("x"))
    return a.agg(
        F.count_if(F.exists("x", lambda e: e > 6)).alias("some_over"),
        F.count_if(K.count_known(c("x"), lambda e: e > 3) > 1).alias("two_over"),
        F.count_if(K.unique(c("x"))).alias("one_value"),
        F.count_if(K.for_each(c("x"), lambda e: e < 7)).alias("all_below"),
    )


@query("""SELECT count(*) FILTER (o_orderdate + INTERVAL 36 MONTH >= l_shipdate) AS in_time, count(*) AS n, count(*) FILTER (l_shipdate >= o_orderdate + INTERVAL 10 DAY) AS after_ten
FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def q_date_plus_years(t):
    """Dates plus years and days."""
    rows = t("orders").join(t("lineitem"), c("o_orderkey") == c("l_orderkey"))
    by = F.add_months("o_orderdate", 36) >= F.to_date("l_shipdate")
    return rows.agg(F.count_if(by).alias("in_time"), F.count("*").alias("n"), F.count_if(F.to_date("l_shipdate") >= F.date_add("o_orderdate", 10)).alias("after_ten"))


@query("""SELECT o_orderkey, sha256(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)) AS h FROM orders""")
def q_sha256_fields(t):
    """Fingerprints of rows."""
    return t("orders").select("o_orderkey", F.sha2(F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), 256).alias("h"))


@query("""SELECT u.user_id, coalesce(string_agg(r.t, ',' ORDER BY r.t) FILTER (e.user_id IS NULL), '') AS missing
FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (VALUES ('click'), ('purchase'), ('signup')) r(t)
LEFT JOIN (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 3 = 0) e ON e.user_id = u.user_id AND e.event_type = r.t GROUP BY 1""")
def q_presence_required(t):
    """Required kinds that a case lacks: from the set it has, no cross join."""
    need = F.array(lit("click"), lit("purchase"), lit("signup"))
    has = F.collect_set(F.when(c("event_id") % 3 == 0, c("event_type")))
    return t("events").groupBy("user_id").agg(F.array_join(F.array_sort(F.array_except(need, has)), ",").alias("missing"))


# ---- tables, formulas, rules

_TABLE = "SELECT p_size AS k, (min(p_retailprice) / 100)::DECIMAL(18,4) AS v FROM part WHERE p_size % 5 = 0 GROUP BY 1"


def _table(t):
    return t("part").where("p_size % 5 = 0").groupBy(c("p_size").cast("int").alias("k")).agg((F.min("p_retailprice") / 100).cast(MONEY).alias("v"))


@query(f"""WITH r AS ({_TABLE}), n AS (SELECT k, v, lead(k) OVER (ORDER BY k) AS k2, lead(v) OVER (ORDER BY k) AS v2 FROM r)
SELECT p_partkey, round(CASE WHEN p_size = k THEN v::DOUBLE ELSE v::DOUBLE + (p_size - k)::DOUBLE * (v2 - v)::DOUBLE / (k2 - k) END, 6) AS looked_up
FROM part LEFT JOIN n ON p_size = k OR (p_size > k AND p_size < k2)""")
def q_table_interpolate(t):
    """Exact or interpolated lookup, none outside of the table."""
    table = _table(t).withColumn("v", c("v").cast("double"))
    return U.interpolate(t("part").select("p_partkey", "p_size"), "p_size", table, "k", "v", "f").select("p_partkey", F.round("f", 6).alias("looked_up"))


@query("""SELECT e.event_id, v.value AS seen FROM (SELECT * FROM events WHERE event_type = 'purchase') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts > v.ts""")
def q_asof_version(t):
    """The version in force: the last view before each purchase."""
    rows = t("events").where("event_type in ('view', 'purchase')")
    rows = U.as_of(rows, "user_id", [c("ts"), c("event_id")], c("event_type") == "view", c("value"), "seen")
    return rows.where("event_type = 'purchase'").select("event_id", "seen")


@query("""SELECT l_orderkey, (CASE WHEN count(*) = count(o) THEN sum(o) END)::DOUBLE AS total, CASE WHEN count(*) = count(o) THEN trunc(sum(o))::BIGINT END AS whole, count(*) FILTER (o IS NULL) AS failed FROM
(SELECT l_orderkey, CASE WHEN l_discount < 0.1 AND l_quantity < 50 THEN l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)) * (1 + l_tax::DECIMAL(4,2)) END AS o FROM lineitem) GROUP BY 1""")
def q_unit_formula_total(t):
    """A decimal formula a unit, void where a control fails, and the case's total, void if a unit is."""
    one = lit(1).cast("decimal(1,0)")
    out = c("l_extendedprice").cast("decimal(12,2)") * (one - c("l_discount").cast("decimal(4,2)")) * (one + c("l_tax").cast("decimal(4,2)"))
    rows = t("lineitem").select("l_orderkey", F.when((c("l_discount") < 0.1) & (c("l_quantity") < 50), out).alias("o"))
    total = K.sum_rows(c("o"))
    return rows.groupBy("l_orderkey").agg(total.cast("double").alias("total"), total.cast("bigint").alias("whole"), F.count_if(c("o").isNull()).alias("failed"))


def _rules():
    return [
        V.Rule("r_scope", "SCOPE", c("o_orderpriority") != "5-LOW", phase=0),
        V.Rule("r_sum", "DATA", c("lines_total") <= c("o_totalprice") * 2),
        V.Rule("r_lines", "FIXABLE", c("n_lines") >= 2),
        V.Rule("r_ship", "FIXABLE", c("last_ship") >= c("o_orderdate")),
        V.Rule("r_large", "NOTICE", c("o_totalprice") < 450000),
    ]


def _cases(t):
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sum(c("l_extendedprice").cast("decimal(12,2)")).alias("lines_total"), F.max("l_shipdate").alias("last_ship"))
    orders = t("orders").withColumn("o_totalprice", c("o_totalprice").cast("decimal(12,2)"))
    return V.results(orders.join(lines, c("o_orderkey") == c("l_orderkey"), "left"), _rules())


_CASES = """l AS (SELECT l_orderkey, count(*) AS n_lines, sum(l_extendedprice::DECIMAL(12,2)) AS lines_total, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1),
x AS (SELECT *, o_orderpriority <> '5-LOW' AS r_scope FROM orders LEFT JOIN l ON o_orderkey = l_orderkey),
r AS (SELECT *, CASE WHEN r_scope THEN lines_total <= o_totalprice::DECIMAL(12,2) * 2 END AS r_sum, CASE WHEN r_scope THEN n_lines >= 2 END AS r_lines,
  CASE WHEN r_scope THEN last_ship >= o_orderdate END AS r_ship, CASE WHEN r_scope THEN o_totalprice::DECIMAL(12,2) < 450000 END AS r_large FROM x),
m AS (SELECT o_orderkey, u.rule, u.severity, CASE WHEN u.ok THEN 'PASS' WHEN NOT u.ok THEN 'FAIL' ELSE 'NOT_EVALUABLE' END AS result FROM r,
  unnest([{'rule': 'r_scope', 'severity': 'SCOPE', 'ok': r_scope}, {'rule': 'r_sum', 'severity': 'DATA', 'ok': r_sum}, {'rule': 'r_lines', 'severity': 'FIXABLE', 'ok': r_lines},
  {'rule': 'r_ship', 'severity': 'FIXABLE', 'ok': r_ship}, {'rule': 'r_large', 'severity': 'NOTICE', 'ok': r_large}]) AS t(u))"""


@query(f"WITH {_CASES} SELECT * FROM m")
def q_rule_matrix_long(t):
    """Every rule of every case, masked where the scope failed."""
    return V.long_form(_cases(t), ["o_orderkey"], _rules())


@query(f"""WITH {_CASES} SELECT o_orderkey, NOT r_scope AS stopped, CASE WHEN NOT r_scope THEN 'NOT_ELIGIBLE' WHEN NOT r_sum THEN 'BLOCKED'
WHEN NOT r_lines OR NOT r_ship THEN 'FIXABLE' ELSE 'PREVALIDATED' END AS verdict FROM r""")
def q_verdict(t):
    """The verdict of each case: the worst severity among its failing rules."""
    return _cases(t).select("o_orderkey", "stopped", V.verdict(_rules()).alias("verdict"))


@query(f"WITH {_CASES} SELECT rule, severity, count(*) AS n FROM m WHERE result = 'FAIL' GROUP BY ALL ORDER BY n DESC, rule LIMIT 3")
def q_shortfalls_topk(t):
    """The rules that fail most often."""
    return V.shortfalls(V.long_form(_cases(t), ["o_orderkey"], _rules()), 3)


@query("""SELECT p_partkey, coalesce(a, b) AS used, a IS NULL AND b IS NOT NULL AS provisional FROM (SELECT p_partkey, nullif(p_size, 10) AS a, nullif(p_size % 7, 2) AS b FROM part)""")
def q_provisional_sub(t):
    """A missing input takes its sibling, provisionally."""
    rows = t("part").select("p_partkey", F.nullif(c("p_size"), lit(10)).alias("a"), F.nullif(c("p_size") % 7, lit(2)).alias("b"))
    return rows.select("p_partkey", F.coalesce("a", "b").alias("used"), (c("a").isNull() & c("b").isNotNull()).alias("provisional"))


# ---- consolidation

_EVIDENCE = """e AS (SELECT l_partkey AS unit, 'line' AS source, round(l_extendedprice / l_quantity)::BIGINT AS v, 2 AS prio, l_orderkey * 10 + l_linenumber AS seq FROM lineitem
UNION ALL SELECT p_partkey, 'part', round(p_retailprice)::BIGINT, 1, p_partkey FROM part)"""


def _evidence(t):
    lines = t("lineitem").select(c("l_partkey").alias("unit"), lit("line").alias("source"), F.round(c("l_extendedprice") / c("l_quantity")).cast("long").alias("v"), lit(2).alias("prio"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("seq"))
    return lines.unionByName(t("part").select(c("p_partkey").alias("unit"), lit("part").alias("source"), F.round("p_retailprice").cast("long").alias("v"), lit(1).alias("prio"), c("p_partkey").alias("seq")))


@query(f"""WITH {_EVIDENCE} SELECT unit, count(*) AS n_sources, min(v) < max(v) AS conflict, CASE WHEN min(v) = max(v) THEN min(v) END AS value, arg_min(source, prio * 1000000000 + seq) AS best_source FROM e GROUP BY unit""")
def q_consolidate_conflict(t):
    """Facts from several sources: conflicts have no value, priorities choose the source."""
    return C.consolidate(_evidence(t), ["unit"], "v", "source", "seq", c("prio"))


@query(f"""WITH {_EVIDENCE}, s AS (SELECT unit, v, dense_rank() OVER (PARTITION BY unit, source ORDER BY v) AS k, source FROM e)
SELECT CASE WHEN k > 1 THEN source || '#' || k ELSE source END AS named, count(*) AS n, min(v) AS least FROM s GROUP BY 1""")
def q_source_suffix(t):
    """Numbered names for the further values of a source."""
    return C.suffixed_sources(_evidence(t), ["unit"], "source", "v", "named").groupBy("named").agg(F.count("*").alias("n"), F.min("v").alias("least"))


@query("""SELECT l_suppkey, CASE WHEN min(l_partkey) = max(l_partkey) THEN min(l_partkey) END AS l_partkey, min(l_partkey) = max(l_partkey) AS resolved FROM lineitem GROUP BY 1""")
def q_secondary_key(t):
    """A secondary key's primary one, if there is one only."""
    return C.resolve_secondary(t("lineitem"), "l_suppkey", "l_partkey")


_FOLD = "trim(regexp_replace(lower(translate({}, '" + T.ACCENTED + "', '" + T.FOLDED + r"')), '[\t\n\x0B\f\r ]+', ' ', 'g'))"


@query("""WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents), g AS (SELECT h, min(doc_id) AS first, count(*) AS n FROM h GROUP BY 1)
SELECT doc_id, first, n FROM h JOIN g USING (h) WHERE n > 1""")
def q_hash_link(t):
    """Documents linked by equal fingerprints."""
    h = t("documents").select("doc_id", F.sha2(F.coalesce("text", lit("")), 256).alias("h"))
    g = h.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return h.join(g, "h").select("doc_id", "first", "n")


# ---- time series


@query("""WITH g AS (SELECT user_id, floor(epoch(ts) / 60)::BIGINT - lag(floor(epoch(ts) / 60)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
k AS (SELECT user_id, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY ALL)
SELECT user_id, gap, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, gap) AS r FROM k) WHERE r = 1""")
def q_mode_interval(t):
    """The most frequent gap between a unit's readings."""
    return S.modal_gap(t("events"), "user_id", c("ts"), ["ts", "event_id"], 60)


@query("""SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'view') AS n_running, round(avg(value) FILTER (event_type = 'view'), 6) AS mean_running,
round(count(*) FILTER (event_type = 'view') * 8760.0 / count(*), 6)::DOUBLE AS hours_running FROM events GROUP BY 1""")
def q_running_mean_extrap(t):
    """Mean over running rows and hours a year."""
    return S.running_share(t("events"), "user_id", c("event_type") == "view", c("value"), 8760.0)


@query("""SELECT user_id, count(*) AS n, sha256(string_agg(event_id || ';' || event_type, chr(10) ORDER BY ts, event_id)) AS sha256 FROM events GROUP BY 1""")
def q_canonical_fingerprint(t):
    """The fingerprint of a unit's lines in order."""
    return S.fingerprint(t("events"), "user_id", ["ts", "event_id"], F.concat_ws(";", "event_id", "event_type"))


# ---- text


@query(f"SELECT doc_id, sha256({_FOLD.format("coalesce(text, '')")}) AS h FROM documents")
def q_text_normalize(t):
    """Folded texts, as fingerprints."""
    return t("documents").select("doc_id", F.sha2(T.fold(F.coalesce("text", lit(""))), 256).alias("h"))


@query("""SELECT o_orderkey, o_orderkey AS whole, (o_totalprice::DECIMAL(18,2))::DOUBLE AS parsed FROM orders""")
def q_number_parse(t):
    """Numbers in Spanish notation, written and read again."""
    text = F.translate(F.format_number(c("o_totalprice").cast("decimal(18,2)"), 2), ",.", ".,")
    return t("orders").select("o_orderkey", T.spanish_number(F.concat(c("o_orderkey").cast("string"), lit(" kWh"))).cast("bigint").alias("whole"), T.spanish_number(F.concat(lit("Total: "), text, lit(" EUR"))).cast("double").alias("parsed"))


@query("""WITH s AS (SELECT doc_id, unnest([{'k': 'licence', 's': (contains(x, 'icens'))::INT * 2 + (contains(x, 'CC'))::INT}, {'k': 'table', 's': (contains(x, ' | '))::INT * 3},
{'k': 'prose', 's': (contains(x, '. '))::INT}]) AS u FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents))
SELECT doc_id, CASE WHEN max(u.s) > 0 THEN arg_max(u.k, u.s * 10 - CASE u.k WHEN 'licence' THEN 0 WHEN 'table' THEN 1 ELSE 2 END) ELSE 'unclassified' END AS kind, max(u.s) AS score FROM s GROUP BY doc_id""")
def q_doc_classify(t):
    """The kind of a document by the best score of a lexicon, ties by its order; no shuffle."""
    has = lambda s: F.coalesce("text", lit("")).contains(s).cast("int")
    scores = [("licence", has("icens") * 2 + has("CC")), ("table", has(" | ") * 3), ("prose", has(". "))]
    best = F.greatest(*[s for _, s in scores])
    kind = F.when(best == 0, "unclassified")
    for name, s in scores:
        kind = kind.when(s == best, name)
    return t("documents").select("doc_id", kind.alias("kind"), best.alias("score"))


@query("""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), x AS (SELECT doc_id, i, l[i] AS line, l[i + 1] AS after FROM l, unnest(range(1, len(l) + 1)) AS u(i))
SELECT doc_id, i::INT AS line_no, length(line) AS n, sha256(coalesce(after, '')) AS next_line FROM x WHERE contains(line, ' | ')""")
def q_label_lines(t):
    """Lines with a label's mark, and the line after each."""
    lines = t("documents").select("doc_id", F.split(F.coalesce("text", lit("")), "\n").alias("l"))
    rows = lines.select("doc_id", "l", F.posexplode("l").alias("i", "line")).where(c("line").contains(" | "))
    return rows.select("doc_id", (c("i") + 1).alias("line_no"), F.length("line").alias("n"), F.sha2(F.coalesce(F.get("l", c("i") + 1), lit("")), 256).alias("next_line"))


@query(f"""WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex({_FOLD.format("coalesce(text, '')")}, '[^a-z0-9]+'), lambda x: length(x) >= 4))) AS term FROM documents),
d AS (SELECT term, count(*) AS df FROM t GROUP BY 1), r AS (SELECT doc_id, term, df, row_number() OVER (PARTITION BY doc_id ORDER BY df, term) AS k FROM t JOIN d USING (term))
SELECT doc_id, term, df, k::INT AS k FROM r WHERE k <= 3""")
def q_term_weight_topk(t):
    """The three rarest terms of each document, by an inverted index."""
    return J.rarest_terms(t("documents"), "doc_id", T.significant_terms(F.coalesce("text", lit(""))), 3)


# ---- the event log

_CONTENT = "event_id || ':' || event_type"


def _content():
    return F.concat_ws(":", "event_id", "event_type")


@query(f"""WITH RECURSIVE o AS (SELECT user_id, {_CONTENT} AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
h AS (SELECT user_id, i, sha256('|' || x) AS h FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, sha256(h.h || '|' || o.x) FROM h JOIN o ON o.user_id = h.user_id AND o.i = h.i + 1)
SELECT user_id, max(i) AS n_events, arg_max(h, i) AS head FROM h GROUP BY 1""")
def q_chain_hash(t):
    """The head of each case's hash chain."""
    return L.chained(t("events"), "user_id", ["ts", "event_id"], _content())


@query(f"""WITH o AS (SELECT user_id, event_id, sha256({_CONTENT}) AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT user_id, min(i) AS first_broken FROM o WHERE event_id % 97 = 5 GROUP BY 1""")
def q_chain_verify(t):
    """The first broken link of each log in which some contents were altered."""
    stored = L.linked(t("events"), "user_id", ["ts", "event_id"], _content())
    altered = stored.withColumn("event_type", F.when(c("event_id") % 97 == 5, "altered").otherwise(c("event_type")))
    return L.broken_links(altered, "user_id", _content())


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def q_idempotent(t):
    """Events that come twice count once."""
    e = t("events")
    again = e.union(e.where("event_id % 2 = 0")).dropDuplicates(["user_id", "event_type", "ts", "event_id"])
    return again.groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT event_type AS state, count(*) AS n FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1) GROUP BY 1""")
def q_state_latest(t):
    """Cases by their latest event."""
    last = t("events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    return last.groupBy("state").agg(F.count("*").alias("n"))


# A graph of states, (state, event) -> state.
MOVES = {("OPEN", "view"): "ACTIVE", ("OPEN", "signup"): "ACTIVE", ("ACTIVE", "click"): "READY", ("READY", "purchase"): "SENT", ("READY", "error"): "ACTIVE", ("SENT", "error"): "REVIEW", ("REVIEW", "click"): "ACTIVE"}
_MOVES = ", ".join(f"('{a}', '{b}', '{s}')" for (a, b), s in MOVES.items())


@query(f"""WITH RECURSIVE g(a, e, b) AS (VALUES {_MOVES}), o AS (SELECT user_id, event_type AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 'OPEN' AS state, 0 AS rejected FROM events UNION ALL
SELECT o.user_id, o.i, coalesce(g.b, s.state), s.rejected + (g.b IS NULL)::INT FROM s JOIN o ON o.user_id = s.user_id AND o.i = s.i + 1 LEFT JOIN g ON g.a = s.state AND g.e = o.e)
SELECT user_id, arg_max(state, i) AS state, max(rejected) AS rejected FROM s GROUP BY 1""")
def q_state_machine(t):
    """Logs replayed over a graph of states."""
    return L.replay(t("events"), "user_id", ["ts", "event_id"], "OPEN", MOVES, "event_type")


@query("""WITH m AS (SELECT DISTINCT user_id % 10 AS bundle, user_id FROM events), d AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 190)
SELECT bundle, user_id, user_id IN (SELECT user_id FROM d) AS direct FROM m WHERE bundle IN (SELECT user_id % 10 FROM d)""")
def q_contagion(t):
    """An objection to one member reaches all members of its bundle."""
    members = t("events").select((c("user_id") % 10).alias("bundle"), "user_id").distinct()
    return L.spread(t("events").where("event_type = 'error' and value > 190"), members, "bundle", "user_id")


@query("""SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'left' WHEN user_id % 5 = 0 THEN 'right' ELSE 'both' END AS side, CASE WHEN user_id % 3 = 0 OR user_id % 5 = 0 THEN
CASE WHEN user_id % 3 = 0 THEN 'n,last' ELSE 'n,last' END ELSE 'n' END AS fields FROM (SELECT DISTINCT user_id FROM events) WHERE NOT (user_id % 3 = 0 AND user_id % 5 = 0) AND (user_id % 3 = 0 OR user_id % 5 = 0 OR user_id % 7 = 0)""")
def q_replay_divergence(t):
    """Where a recorded table and a replayed one differ."""
    a = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    left = a.where("user_id % 5 <> 0")
    right = a.where("user_id % 3 <> 0").withColumn("n", F.when(c("user_id") % 7 == 0, c("n") + 1).otherwise(c("n")))
    return L.divergences(left, right, ["user_id"], ["n", "last"])


@query("""SELECT o_orderkey, o_orderkey % 4 <> 0 AS named FROM orders""")
def q_reconcile_code(t):
    """Codes that stand in a composed reference as a segment of their own, not within another."""
    code = F.concat(lit("c"), c("o_orderkey").cast("string"))
    ref = F.when(c("o_orderkey") % 4 == 0, F.concat(lit("ex-x"), code, lit("-1"))).otherwise(F.concat(lit("ex-"), code, lit("-1")))
    return t("orders").select("o_orderkey", T.names_code(ref, code).alias("named"))


# ---- access, mapping, manifest, metrics


@query("""SELECT r_name, c_mktsegment, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE (r_name, c_mktsegment) IN (('ASIA', 'BUILDING'), ('EUROPE', 'MACHINERY'), ('EUROPE', 'BUILDING')) GROUP BY ALL""")
def q_access_blocks(t):
    """What a principal may see is filtered before anything is summed."""
    grant = (c("r_name") == "ASIA") & (c("c_mktsegment") == "BUILDING") | (c("r_name") == "EUROPE") & c("c_mktsegment").isin("MACHINERY", "BUILDING")
    seen = t("customer").join(t("nation"), c("c_nationkey") == c("n_nationkey")).join(t("region"), c("n_regionkey") == c("r_regionkey")).where(grant)
    return t("orders").join(seen, c("o_custkey") == c("c_custkey")).groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("n"), F.sum(c("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN json_extract_string(props, '$.z') IS NULL THEN 'z' ELSE '' END AS missing FROM events""")
def q_mapping_missing(t):
    """Fields by path, and the mandatory ones that are missing."""
    path = {x: F.get_json_object("props", f"$.{x}") for x in ("k", "z")}
    missing = F.array_compact(F.array(*[F.when(v.isNull(), x) for x, v in path.items()]))
    return t("events").select("event_id", path["k"].alias("k"), F.array_join(missing, ",").alias("missing"))


@query("""WITH a AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents), x AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS k FROM a WHERE doc_id % 2 = 0),
y AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS k FROM a WHERE doc_id % 2 = 1) SELECT x.doc_id AS listed, y.doc_id AS found FROM x JOIN y USING (h, k)""")
def q_manifest_pairs(t):
    """Listed and found files paired by content; equal contents in order."""
    a = t("documents").select("doc_id", F.sha2(F.coalesce("text", lit("")), 256).alias("h"))
    a = M.ranked(a.withColumn("side", c("doc_id") % 2), ["h", "side"], "doc_id", "k")
    x, y = a.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "listed"), a.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "found")
    return x.join(y, ["h", "k"]).select("listed", "found")


@query("""SELECT round(quantile_cont(d, 0.5), 3) AS p50, round(quantile_cont(d, 0.9), 3) AS p90, count(*) AS n FROM (SELECT user_id, epoch_us(max(ts) FILTER (event_type = 'purchase')) / 1e6 - epoch_us(min(ts) FILTER (event_type = 'signup')) / 1e6 AS d FROM events GROUP BY 1) WHERE d > 0""")
def q_elapsed_pct(t):
    """Time between two kinds of event: median and ninth decile."""
    at = lambda kind: F.unix_micros(F.when(c("event_type") == kind, c("ts").cast("timestamp"))) / 1e6
    d = t("events").groupBy("user_id").agg((F.max(at("purchase")) - F.min(at("signup"))).alias("d")).where("d > 0")
    q = M.continuous_quantiles(d, "d", {"p50": 0.5, "p90": 0.9})
    at = lambda name: F.round(lit(q[name]).cast("double"), 3).alias(name)
    return d.sparkSession.range(1).select(at("p50"), at("p90"), lit(q["n"]).cast("long").alias("n"))


@query("""SELECT user_id, floor(epoch(TIMESTAMP '2024-03-01' - max(ts)) / 60)::BIGINT AS minutes_open FROM events GROUP BY 1 HAVING arg_max(event_type, (ts, event_id)) = 'error'""")
def q_queue_age(t):
    """Open items and their age at an instant."""
    last = t("events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e")).where("e.event_type = 'error'")
    return last.select("user_id", F.floor((lit(1709251200000000) - F.unix_micros(c("e.ts").cast("timestamp"))) / 60000000).alias("minutes_open"))


@query("""SELECT s.user_id, count(DISTINCT s.event_id) AS n FROM events s JOIN events p ON s.user_id = p.user_id AND s.event_type = 'signup' AND p.event_type = 'purchase' AND s.value::BIGINT = p.value::BIGINT GROUP BY 1""")
def q_same_actor(t):
    """The same one opened and approved: a semi join on case and value."""
    v = F.bround("value").cast("long")
    s = t("events").where("event_type = 'signup'").select("user_id", "event_id", v.alias("v"))
    p = t("events").where("event_type = 'purchase'").select("user_id", v.alias("v"))
    return s.join(p, ["user_id", "v"], "left_semi").groupBy("user_id").agg(F.count("*").alias("n"))


@query("""SELECT r_name, n_name, c_mktsegment, count(*) AS n, grouping(r_name)::INT AS gr, grouping(n_name)::INT AS gn FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""")
def q_cuts_rollup(t):
    """Counts by region, nation and segment, with subtotals."""
    rows = t("customer").join(t("nation"), c("c_nationkey") == c("n_nationkey")).join(t("region"), c("n_regionkey") == c("r_regionkey"))
    return rows.rollup("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.grouping("r_name").cast("int").alias("gr"), F.grouping("n_name").cast("int").alias("gn"))


@query("""SELECT c_nationkey, c_mktsegment, count(*) AS n, count(*) = 1 AS orphan, CASE WHEN count(nullif(c_custkey % 4, 0)) > 0 THEN min(nullif(c_custkey % 4, 0)) = max(nullif(c_custkey % 4, 0)) END AS one_verifier FROM customer GROUP BY ALL""")
def q_composition_valid(t):
    """Bundles by their grouping keys: uniqueness, orphans."""
    v = F.nullif(c("c_custkey") % 4, lit(0).cast("long"))
    return t("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), (F.count("*") == 1).alias("orphan"), K.unique_rows(v).alias("one_verifier"))


@query(f"""WITH {_CASES}, f AS (SELECT o_orderkey, coalesce(string_agg(rule, ',' ORDER BY rule) FILTER (result = 'FAIL'), '') AS failed, count(*) FILTER (result = 'NOT_EVALUABLE') AS ne FROM m GROUP BY 1)
SELECT failed = CASE WHEN o_orderkey % 2 = 0 THEN 'r_scope' ELSE '' END AS agrees, ne <= 4 AS ne_covered, count(*) AS n FROM f GROUP BY ALL""")
def q_golden_compare(t):
    """Expected against obtained: failed rules by equality, open ones by inclusion."""
    rules = [r.name for r in _rules()]
    failed = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(~c(r), r) for r in rules]))), ",")
    open_rules = F.array_compact(F.array(*[F.when(c(r).isNull(), r) for r in rules]))
    expected = F.when(c("o_orderkey") % 2 == 0, "r_scope").otherwise("")
    allowed = F.array(*[lit(r) for r in rules if r != "r_scope"])
    rows = _cases(t).select((failed == expected).alias("agrees"), (F.size(F.array_except(open_rules, allowed)) == 0).alias("ne_covered"))
    return rows.groupBy("agrees", "ne_covered").agg(F.count("*").alias("n"))
