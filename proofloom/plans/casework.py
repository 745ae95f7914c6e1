"""Queries of the calculation, the rules and consolidation: lineitems are units, orders their cases, parts and lineitems sources of facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofloom.functions import text as T
from proofloom.functions import three_valued as K
from proofloom.operators import evidence as E
from proofloom.operators import lookup as U
from proofloom.operators import rulebook as R
from proofloom.operators import savings as S
from proofloom.plans.registry import query

c, lit = F.col, F.lit

# ---- calculation

_LOSSES = "losses AS (SELECT p_size AS kw, (min(p_partkey) % 90 + 10)::BIGINT AS loss_e2, bool_or(p_partkey % 3 = 0) AS unverified FROM part WHERE p_size % 5 <> 0 GROUP BY 1)"
_UNITS = f"""{_LOSSES}, u AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT AS pm, 1000 + l_linenumber * 100 AS n1, (600 + l_partkey % 800)::INT AS n2,
least(2000 + l_suppkey * 37 % 7500, nullif(2000 + l_orderkey * 13 % 7500, 2013))::BIGINT AS h, CASE WHEN 2000 + l_orderkey * 13 % 7500 = 2013 THEN NULL ELSE 1 END AS known,
loss_e2, unverified, CASE WHEN l_tax > 0.07 THEN l_tax END AS given, l_discount * 500 AS mean_power FROM lineitem LEFT JOIN losses ON l_quantity = kw),
x AS (SELECT *, CASE WHEN known = 1 THEN (n2 < n1 AND h > 0 AND h <= 8760) ELSE CASE WHEN NOT n2 < n1 THEN false END END AS pre,
CASE WHEN known = 1 AND n2 < n1 AND h > 0 AND h <= 8760 AND loss_e2 IS NOT NULL THEN ((pm * 100 - loss_e2)::HUGEINT * (n1::HUGEINT * n1 * n1 - n2::HUGEINT * n2 * n2) * h * 10000000) // (n1::HUGEINT * n1 * n1) END AS raw FROM u),
y AS (SELECT *, raw <= pm::HUGEINT * h * 1000000000 AND mean_power <= pm AS controls FROM x),
z AS (SELECT *, CASE WHEN coalesce(controls, true) THEN raw END AS e9 FROM y)"""


def _units(t):
    losses = t("part").where("p_size % 5 <> 0").groupBy(c("p_size").alias("kw")).agg((F.min("p_partkey") % 90 + 10).alias("loss_e2"), F.bool_or(c("p_partkey") % 3 == 0).alias("unverified"))
    rows = t("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        c("l_quantity").cast("long").alias("pm"),
        (1000 + c("l_linenumber") * 100).alias("n1"),
        (600 + c("l_partkey") % 800).cast("int").alias("n2"),
        S.hours(2000 + c("l_suppkey") * 37 % 7500, F.nullif(2000 + c("l_orderkey") * 13 % 7500, lit(2013).cast("long"))).alias("h"),
        F.when(c("l_tax") > 0.07, c("l_tax")).alias("given"),
        (c("l_discount") * 500).alias("mean_power"),
    )
    rows = S.entry_filter(rows, ["given"])  # losses come from the table, never from outside
    rows = U.exact(rows, "pm", losses, "kw")
    saving = S.unit_saving(c("pm") * 100 - c("loss_e2"), 2, c("n1"), c("n2"), c("h"))
    controls = {"within rated energy": c("output") <= c("pm") * c("h"), "mean below rated": c("mean_power") <= c("pm")}
    return S.evaluate(rows, saving, [c("n2") < c("n1"), (c("h") > 0) & (c("h") <= 8760)], controls)


@query(f"""WITH {_UNITS} SELECT l_orderkey, count(*) AS units, (CASE WHEN count(*) = count(e9) THEN sum(e9) END / 1e9)::DOUBLE AS total,
CASE WHEN count(*) = count(e9) THEN (sum(e9) // 1000000000)::BIGINT END AS truncated FROM z GROUP BY 1""")
def q_savings_total(t):
    """Derived inputs, preconditions, formula with a cube and a division, controls, and the total of each case, exact and truncated."""
    rows = S.totals(_units(t), ["l_orderkey"], "output")
    return rows.select("l_orderkey", "units", c("total").cast("double").alias("total"), c("truncated").cast("long").alias("truncated"))


@query(f"""WITH {_UNITS} SELECT count(*) AS units, count(*) FILTER (given IS NOT NULL) AS ignored, count(*) FILTER (unverified AND e9 IS NOT NULL) AS on_unverified_rows,
count(*) FILTER (loss_e2 IS NULL) AS without_row, count(*) FILTER (pre) AS pre_held, count(*) FILTER (NOT pre) AS pre_failed, count(*) FILTER (pre IS NULL) AS pre_open,
count(*) FILTER (NOT controls) AS control_failed, count(e9) AS with_output FROM z""")
def q_savings_checks(t):
    """Inputs that were ignored, rows of the table that aren't verified, and how preconditions and controls turned out."""
    return _units(t).agg(
        F.count("*").alias("units"),
        F.sum(c("ignored")).alias("ignored"),
        F.count_if(c("unverified") & c("output").isNotNull()).alias("on_unverified_rows"),
        F.count_if(c("loss_e2").isNull()).alias("without_row"),
        F.count_if(c("precondition")).alias("pre_held"),
        F.count_if(~c("precondition")).alias("pre_failed"),
        F.count_if(c("precondition").isNull()).alias("pre_open"),
        F.count_if(~c("controls")).alias("control_failed"),
        F.count("output").alias("with_output"),
    )


@query(f"""WITH {_UNITS} SELECT l_orderkey, l_linenumber, l_partkey, sha256('n2 - n1 = ' || (n2 - n1) || '; net = ' || coalesce(rtrim(rtrim(printf('%d.%02d', (pm * 100 - loss_e2) // 100, (pm * 100 - loss_e2) % 100), '0'), '.'), '?') || '; hours = ' || CASE WHEN known = 1 THEN h::VARCHAR ELSE '?' END) AS trace FROM z""")
def q_savings_trace(t):
    """The parts of each unit's formula as text."""
    net = ((c("pm") * 100 - c("loss_e2")).cast("decimal(12,0)") / lit(100).cast("decimal(3,0)")).cast("decimal(12,2)")
    parts = {"n2 - n1": c("n2") - c("n1"), "net": net, "hours": c("h")}
    return _units(t).select("l_orderkey", "l_linenumber", "l_partkey", F.sha2(S.trace(parts), 256).alias("trace"))


@query("""WITH r AS (SELECT p_size AS k, min(p_partkey) AS v FROM part WHERE p_size > 3 GROUP BY 1), n AS (SELECT k, v, lag(k) OVER (ORDER BY k) AS k0, lag(v) OVER (ORDER BY k) AS v0 FROM r)
SELECT count(*) AS n, count(*) FILTER (k <= k0) AS not_rising, count(*) FILTER (v <= 0) AS not_positive, count(*) FILTER (v < v0) AS not_monotone FROM n""")
def q_table_sanity(t):
    """What a reference table is checked for when it is loaded."""
    table = t("part").where("p_size > 3").groupBy(c("p_size").alias("k")).agg(F.min("p_partkey").alias("v"))
    return U.sanity(table, "k", "v")


@query("""SELECT l_orderkey, bool_or(l_quantity IN (SELECT DISTINCT p_size FROM part WHERE p_size % 5 <> 0)) AS some_exact, count(*) FILTER (l_quantity IN (SELECT DISTINCT p_size FROM part WHERE p_size % 5 <> 0)) AS n FROM lineitem GROUP BY 1""")
def q_table_collection(t):
    """Which cases have a unit whose value is a key of the reference table."""
    keys = t("part").where("p_size % 5 <> 0").select(c("p_size").alias("k")).distinct()
    rows = t("lineitem").join(keys, c("l_quantity") == c("k"), "left").withColumn("found", c("k").isNotNull())
    return rows.groupBy("l_orderkey").agg(F.bool_or("found").alias("some_exact"), F.count_if("found").alias("n"))


@query("""SELECT p_brand, count(*) FILTER (abs(p_retailprice - 1000) <= 50) AS near, sum(-p_size)::BIGINT AS negated, count(*) FILTER (abs(nullif(p_size, 7) - 25) IS NULL) AS open,
sum(p_size * p_size * p_size)::BIGINT AS cubes FROM part GROUP BY 1""")
def q_abs_power(t):
    """Absolute value, sign, whole powers; an open operand leaves them open."""
    size = F.nullif(c("p_size"), lit(7))
    return t("part").groupBy("p_brand").agg(
        F.count_if(F.abs(c("p_retailprice") - 1000) <= 50).alias("near"),
        F.sum((-c("p_size")).cast("long")).alias("negated"),
        F.count_if(F.abs(size - 25).isNull()).alias("open"),
        F.sum(S.power(c("p_size").cast("long"), 3)).alias("cubes"),
    )


@query("""SELECT n_name AS tenant, count(*) AS n, count(*) FILTER (k = 1) AS unique_in_tenant, max(k) AS most, count(*) FILTER (year(d) = 1997 AND d >= DATE '1997-03-01') AS dated, count(*) FILTER (len(list_filter(string_split(code, '-'), lambda x: x NOT IN ('1', '2', 'URGENT', 'HIGH'))) = 0) AS only_within FROM
(SELECT n_name, o_orderdate::DATE AS d, o_orderpriority AS code, count(*) OVER (PARTITION BY n_name, o_orderdate, o_orderpriority) AS k FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1""")
def q_tenant_counts(t):
    """What is unique in a tenant and how often the rest is there, years, dates, and values only within a list."""
    rows = t("orders").join(t("customer"), c("o_custkey") == c("c_custkey")).join(F.broadcast(t("nation")), c("c_nationkey") == c("n_nationkey"))
    counts = rows.groupBy(c("n_name").alias("tenant"), "o_orderdate", "o_orderpriority").agg(F.count("*").alias("k"))
    day = F.to_date("o_orderdate")
    allowed = F.array(*map(lit, ("1", "2", "URGENT", "HIGH")))
    dated = (F.year(day) == 1997) & (day >= F.make_date(lit(1997), lit(3), lit(1)))
    within = F.size(F.array_except(F.split("o_orderpriority", "-"), allowed)) == 0
    of = lambda holds: F.coalesce(F.sum(F.when(holds, c("k"))), lit(0))
    return counts.groupBy("tenant").agg(F.sum("k").alias("n"), F.count_if(c("k") == 1).alias("unique_in_tenant"), F.max("k").alias("most"), of(dated).alias("dated"), of(within).alias("only_within"))


@query("""SELECT o_orderkey, count(*) FILTER (l_quantity * 1000 > limit_) > 0 AS some_over, count(*) FILTER (l_quantity * 1000 > limit_) AS n_over FROM (SELECT o_orderkey, o_totalprice / 10 AS limit_, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1""")
def q_element_scope(t):
    """A condition on a case's units that reads the case as well."""
    units = t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("units"))
    cases = t("orders").select("o_orderkey", (c("o_totalprice") / 10).alias("limit")).join(units, c("o_orderkey") == c("l_orderkey"))
    over = lambda u: u * 1000 > c("limit")
    return cases.select("o_orderkey", F.exists("units", over).alias("some_over"), F.size(F.filter("units", over)).cast("long").alias("n_over"))


@query("""SELECT event_id, json_extract_string(j, '$."a.k"') AS flat, json_extract_string(j, '$.a.k') AS nested, json_extract_string(j, '$.a.l[1]') AS item, coalesce(json_extract_string(j, '$."a.k"'), json_extract_string(j, '$.a.k')) AS chosen, json_extract_string(j, '$.a.none') AS missing
FROM (SELECT event_id, '{' || CASE WHEN event_id % 3 = 0 THEN '"a.k":"f' || event_id || '",' ELSE '' END || '"a":{"k":' || event_id % 7 || ',"l":[1,' || event_id % 5 || ']}}' AS j FROM events)""")
def q_dotted_paths(t):
    """Paths into nested documents: the longest dotted key first, then step by step, whole numbers into lists."""
    e = c("event_id")
    flat = F.when(e % 3 == 0, F.concat(lit('"a.k":"f'), e, lit('",'))).otherwise("")
    rows = t("events").select("event_id", F.concat(lit("{"), flat, lit('"a":{"k":'), e % 7, lit(',"l":[1,'), e % 5, lit("]}}")).alias("j"))
    at = lambda path: F.get_json_object("j", path)
    return rows.select("event_id", at("$['a.k']").alias("flat"), at("$.a.k").alias("nested"), at("$.a.l[1]").alias("item"), T.first_path("j", ["a.k"], ["a", "k"]).alias("chosen"), at("$.a.none").alias("missing"))


# ---- rules

_RULED = """l AS (SELECT l_orderkey, count(*) AS n_lines, sum(l_extendedprice::DECIMAL(12,2)) AS declared, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, min(l_quantity) AS q0, max(l_quantity) AS q1,
bool_or(l_returnflag = 'R') AS has_r, bool_or(l_returnflag = 'A') AS has_a, bool_or(l_linestatus = 'F') AS has_f, min(nullif(l_suppkey % 97, 3)) AS ref FROM lineitem GROUP BY 1),
x AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, o_orderdate, o_totalprice::DECIMAL(12,2) AS price, l.* FROM orders LEFT JOIN l ON o_orderkey = l_orderkey),
a AS (SELECT *, o_orderpriority <> '5-LOW' AS s1, NOT (has_r AND has_a AND has_f) AS s2 FROM x),
b AS (SELECT *, NOT (coalesce(s1, true) AND coalesce(s2, true)) AS stopped FROM a),
d AS (SELECT *, CASE WHEN NOT stopped THEN has_r AND has_f END AS d1, CASE WHEN NOT stopped THEN n_lines >= 2 END AS d2, CASE WHEN NOT stopped THEN first_ship >= o_orderdate END AS d3,
CASE WHEN NOT stopped THEN last_ship - first_ship >= INTERVAL 30 DAY END AS d4, CASE WHEN NOT stopped THEN q1 <= 5 * q0 END AS d5, CASE WHEN NOT stopped THEN ref > 5 END AS d6, CASE WHEN NOT stopped THEN last_ship <= o_orderdate + INTERVAL 36 MONTH END AS d7 FROM b),
e AS (SELECT *, stopped OR coalesce(NOT d5, false) OR coalesce(NOT d6, false) AS skipped FROM d), f AS (SELECT *, CASE WHEN NOT skipped THEN abs(declared - price) <= 100000 END AS k1 FROM e)"""


def _ruled(t):
    lines = t("lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n_lines"),
        F.sum(c("l_extendedprice").cast("decimal(12,2)")).alias("declared"),
        F.min("l_shipdate").alias("first_ship"),
        F.max("l_shipdate").alias("last_ship"),
        F.min("l_quantity").alias("q0"),
        F.max("l_quantity").alias("q1"),
        F.collect_set("l_returnflag").alias("flags"),
        F.collect_set("l_linestatus").alias("statuses"),
        F.min(F.nullif(c("l_suppkey") % 97, lit(3).cast("long"))).alias("ref"),
    )
    cases = t("orders").withColumn("price", c("o_totalprice").cast("decimal(12,2)")).join(lines, c("o_orderkey") == c("l_orderkey"), "left")
    return R.evaluate(cases, _book())


def _book():
    flag, status = (lambda x: F.array_contains("flags", x)), (lambda x: F.array_contains("statuses", x))
    return [
        R.Rule("s1", "SCOPE", c("o_orderpriority") != "5-LOW", "scope", reads=("o_orderpriority",)),
        R.Rule("s2", "SCOPE", ~(flag("R") & flag("A") & status("F")), "scope", reads=("flags", "statuses")),
        R.Rule("d1", "FIXABLE", flag("R") & status("F"), "data", reads=("flags", "statuses"), remedy=("returned unit", "finished unit")),
        R.Rule("d2", "FIXABLE", c("n_lines") >= 2, "data", reads=("n_lines",), remedy=("second unit",)),
        R.Rule("d3", "FIXABLE", c("first_ship") >= c("o_orderdate"), "data", reads=("first_ship", "o_orderdate"), note="INT-05"),
        R.Rule("d4", "FIXABLE", F.datediff("last_ship", "first_ship") >= 30, "data", reads=("last_ship", "first_ship"), note="INT-01"),
        R.Rule("d5", "DATA", c("q1") <= 5 * c("q0"), "data", reads=("q1", "q0")),
        R.Rule("d6", "DATA", c("ref") > 5, "data", reads=("ref",), note="INT-02"),
        R.Rule("d7", "NOTICE", F.to_date("last_ship") <= F.add_months("o_orderdate", 36), "data", reads=("last_ship", "o_orderdate")),
        R.Rule("k1", "FIXABLE", F.abs(c("declared") - c("price")) <= 100000, "calculation", reads=("declared", "price"), note="INT-06"),
    ]


_NAMES = "s1 s2 d1 d2 d3 d4 d5 d6 d7 k1".split()


@query(f"""WITH {_RULED} SELECT o_orderkey, stopped, skipped, CASE WHEN stopped THEN 'NOT_ELIGIBLE' WHEN NOT coalesce(d5, true) OR NOT coalesce(d6, true) THEN 'BLOCKED'
WHEN NOT coalesce(d1, true) OR NOT coalesce(d2, true) OR NOT coalesce(d3, true) OR NOT coalesce(d4, true) OR NOT coalesce(k1, true) THEN 'FIXABLE' ELSE 'PREVALIDATED' END AS verdict,
{" || ".join(f"CASE WHEN {n} THEN '1' WHEN NOT {n} THEN '0' ELSE '-' END" for n in _NAMES)} AS results FROM f""")
def q_rulebook(t):
    """Ten rules in three phases: a failed scope stops all others, a failed blocking rule skips the calculation."""
    said = F.concat(*[F.when(c(n), "1").when(~c(n), "0").otherwise("-") for n in _NAMES])
    return _ruled(t).select("o_orderkey", "stopped", "skipped", R.verdict(_book()).alias("verdict"), said.alias("results"))


@query(f"""WITH {_RULED}, m AS (SELECT o_orderkey, u.rule, u.missing FROM f, unnest([
{{'rule': 's2', 'missing': CASE WHEN s2 IS NULL AND n_lines IS NULL THEN 'flags,statuses' END}}, {{'rule': 'd2', 'missing': CASE WHEN NOT stopped AND d2 IS NULL THEN 'n_lines' END}},
{{'rule': 'd6', 'missing': CASE WHEN NOT stopped AND d6 IS NULL THEN 'ref' END}}]) AS t(u))
SELECT rule, missing, count(*) AS n FROM m WHERE missing IS NOT NULL GROUP BY ALL""")
def q_missing_reasons(t):
    """Why rules could not be evaluated: the inputs that are missing, by name."""
    rows = R.missing(_ruled(t), [r for r in _book() if r.name in ("s2", "d2", "d6")], ["o_orderkey"])
    return rows.groupBy("rule", "missing").agg(F.count("*").alias("n"))


@query(f"""WITH {_RULED} SELECT notes, count(*) AS n, min(o_orderkey) AS first FROM (SELECT o_orderkey, concat_ws(',', CASE WHEN d4 IS NOT NULL THEN 'INT-01' END, CASE WHEN d6 IS NOT NULL THEN 'INT-02' END,
CASE WHEN d3 IS NOT NULL THEN 'INT-05' END, CASE WHEN k1 IS NOT NULL THEN 'INT-06' END) AS notes FROM f) GROUP BY 1""")
def q_interpretations(t):
    """The recorded readings that were applied: those of all rules that were evaluated, sorted."""
    return _ruled(t).select("o_orderkey", R.notes(_book()).alias("notes")).groupBy("notes").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query(f"""WITH {_RULED} SELECT o_orderkey, concat_ws(',', CASE WHEN NOT d1 THEN 'finished unit,returned unit' END, CASE WHEN NOT d2 THEN 'second unit' END) AS remedies FROM f WHERE NOT d1 OR NOT d2""")
def q_remedies(t):
    """What would mend a case's failing rules."""
    return _ruled(t).select("o_orderkey", R.remedies(_book()).alias("remedies")).where("remedies <> ''")


@query("""WITH h AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS has, max(value) > 180 AS large FROM events GROUP BY 1)
SELECT user_id, len(list_filter(CASE WHEN large THEN ['click', 'purchase', 'signup'] ELSE ['click', 'purchase'] END, lambda x: NOT list_contains(has, x)))::INT AS missing, large AS signup_needed FROM h""")
def q_obligations(t):
    """Required kinds of documents, one of them only under a condition."""
    has = t("events").groupBy("user_id").agg(F.collect_set("event_type").alias("has"), F.max("value").alias("top"))
    return R.lacking(has, "has", {"click": lit(True), "purchase": lit(True), "signup": c("top") > 180}).select("user_id", F.size("lacking").alias("missing"), (c("top") > 180).alias("signup_needed"))


@query("""WITH v AS (SELECT l_partkey, l_linenumber % 3 AS src, min(l_tax) AS v FROM lineitem GROUP BY 1, 2) SELECT l_partkey, min(v) = max(v) AS agreed, string_agg(src || '=' || v::DECIMAL(4,2), ',' ORDER BY src) AS by_source FROM v GROUP BY 1""")
def q_unique_by_source(t):
    """A fact's value from each source, and whether they agree."""
    v = t("lineitem").groupBy("l_partkey", (c("l_linenumber") % 3).alias("src")).agg(F.min("l_tax").alias("v"))
    by = F.map_from_entries(F.array_sort(F.collect_list(F.struct(c("src").cast("string"), c("v").cast("decimal(4,2)")))))
    rows = v.groupBy("l_partkey").agg(by.alias("by"))
    text = F.array_join(F.transform(F.map_entries("by"), lambda e: F.concat(e["key"], lit("="), e["value"].cast("string"))), ",")
    return rows.select("l_partkey", K.unique(F.map_values("by")).alias("agreed"), text.alias("by_source"))


@query("""WITH p AS (SELECT p_partkey, nullif(p_size, 10) AS a, nullif(p_size % 7, 2) AS b, p_size % 4 = 0 AS fixable FROM part)
SELECT p_partkey, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) WHEN fixable AND (a IS NULL) <> (b IS NULL) THEN coalesce(a, b) END AS h,
fixable AND (a IS NULL) <> (b IS NULL) AS provisional FROM p""")
def q_provisional_pass(t):
    """A derivation of two inputs: where just one is missing and that can be mended, the other one stands in, provisionally."""
    rows = t("part").select("p_partkey", F.nullif(c("p_size"), lit(10)).alias("a"), F.nullif(c("p_size") % 7, lit(2)).alias("b"), (c("p_size") % 4 == 0).alias("fixable"))
    value, provisional = R.provisional(c("a"), c("b"), c("fixable"))
    return rows.select("p_partkey", value.alias("h"), provisional.alias("provisional"))


# ---- consolidation

_FACTS = """f AS (SELECT l_partkey AS unit, CASE l_linenumber % 4 WHEN 0 THEN 'plate' WHEN 1 THEN 'invoice' WHEN 2 THEN 'log' ELSE 'sheet' END AS source, CASE l_linenumber % 4 WHEN 2 THEN 'derived' WHEN 1 THEN 'shown' ELSE 'declared' END AS kind,
l_linenumber % 4 = 0 AND l_suppkey % 2 = 0 AS ocr, round(l_extendedprice / l_quantity / 100)::BIGINT AS v, l_orderkey * 100 + l_linenumber AS seq, l_quantity AS q FROM lineitem),
g AS (SELECT *, CASE kind WHEN 'derived' THEN 0 WHEN 'shown' THEN 1 ELSE 2 END AS prio, bool_or(NOT ocr) OVER (PARTITION BY unit) AS some_reliable FROM f)"""


def _facts(t):
    k = c("l_linenumber") % 4
    return t("lineitem").select(
        c("l_partkey").alias("unit"),
        F.when(k == 0, "plate").when(k == 1, "invoice").when(k == 2, "log").otherwise("sheet").alias("source"),
        F.when(k == 2, "derived").when(k == 1, "shown").otherwise("declared").alias("kind"),
        ((k == 0) & (c("l_suppkey") % 2 == 0)).alias("ocr"),
        F.round(c("l_extendedprice") / c("l_quantity") / 100).cast("long").alias("v"),
        (c("l_orderkey") * 100 + c("l_linenumber")).alias("seq"),
        c("l_quantity").alias("q"),
    )


@query(f"""WITH {_FACTS}, h AS (SELECT *, NOT ocr OR NOT some_reliable AS used FROM g), r AS (SELECT unit, min(v) FILTER (used) AS lo, max(v) FILTER (used) AS hi, count(*) FILTER (used) AS n_used, min([prio, seq, v]) FILTER (used) AS best FROM h GROUP BY 1)
SELECT r.unit, n_used, lo < hi AS conflict, CASE WHEN lo = hi THEN lo END AS value, ['derived', 'shown', 'declared'][best[1] + 1] AS kind, best[3] AS raw, count(*) FILTER (NOT used AND v <> coalesce(CASE WHEN lo = hi THEN lo END, best[3])) AS suspects FROM h JOIN r ON h.unit = r.unit GROUP BY ALL""")
def q_ocr_partition(t):
    """Reliable facts decide; what was read by machine counts only where there is nothing else, and is kept as a suspect where it disagrees."""
    rows = E.consolidate(_facts(t), ["unit"], "v", c("ocr"), c("kind"), ["derived", "shown", "declared"], "seq")
    return rows.select("unit", "n_used", "conflict", "value", "kind", "raw", "suspects")


@query(f"""WITH {_FACTS} SELECT unit, max(CASE WHEN lo < hi THEN 1 ELSE 0 END) = 1 AS conflict_within_kind, count(*) AS kinds FROM (SELECT unit, kind, min(v) AS lo, max(v) AS hi FROM g GROUP BY ALL) GROUP BY 1""")
def q_conflict_within_kind(t):
    """Sources that are compared with each other only within a kind of evidence."""
    return E.conflict_within(_facts(t), ["unit"], "kind", "v")


@query(f"""WITH {_FACTS}, d AS (SELECT unit, v, min(seq) AS seq FROM f GROUP BY ALL) SELECT unit, string_agg(v::VARCHAR, ',' ORDER BY seq, v) AS items, count(*) AS n FROM d GROUP BY 1""")
def q_collections(t):
    """Facts that are lists: distinct values in the order of their first sight, never in conflict."""
    return E.collection(_facts(t), ["unit"], "v", "seq").select("unit", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), F.size("items").cast("long").alias("n"))


@query(f"""WITH {_FACTS} SELECT source, count(*) FILTER (v < 9.5) AS below, count(*) FILTER (v > 17) AS above, count(*) AS n FROM f GROUP BY 1""")
def q_plausible_range(t):
    """Values out of the plausible range: told, not refused."""
    told = E.out_of_range(c("v"), 9.5, 17)
    return _facts(t).groupBy("source").agg(F.count_if(told == "below").alias("below"), F.count_if(told == "above").alias("above"), F.count("*").alias("n"))


@query("""WITH e AS (SELECT l_orderkey AS case_id, CASE WHEN l_linenumber % 3 = 0 THEN 'unit.serial' WHEN l_linenumber % 3 = 1 THEN 'unit.power' ELSE 'case.owner' END AS variable, CASE WHEN l_suppkey % 4 > 0 THEN l_suppkey END AS key_, l_partkey AS v FROM lineitem)
SELECT CASE WHEN coalesce(key_, CASE WHEN variable = 'unit.serial' THEN v END) IS NOT NULL THEN 'unit' WHEN variable LIKE 'unit.%' THEN 'unassigned' ELSE 'case' END AS level, variable, count(*) AS n,
count(coalesce(key_, CASE WHEN variable = 'unit.serial' THEN v END)) AS keyed FROM e GROUP BY ALL""")
def q_key_levels(t):
    """Which unit a fact is of: its own key, or its value where it is the key; and whether it is a unit's, a case's or nobody's."""
    k = c("l_linenumber") % 3
    rows = t("lineitem").select(F.when(k == 0, "unit.serial").when(k == 1, "unit.power").otherwise("case.owner").alias("variable"), F.when(c("l_suppkey") % 4 > 0, c("l_suppkey")).alias("key"), c("l_partkey").alias("v"))
    rows = E.with_keys(rows, "variable", "key", "v", key_variable="unit.serial", unit_prefix="unit.")
    return rows.groupBy("level", "variable").agg(F.count("*").alias("n"), F.count("unit_key").alias("keyed"))


@query("""SELECT source, string_agg(lang || ':' || n, ',' ORDER BY lang) AS by_lang, sum(n)::BIGINT AS n FROM (SELECT coalesce(source, '?') AS source, coalesce(lang, '?') AS lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY 1""")
def q_documents_by_type(t):
    """Documents by source and kind, one entry a kind."""
    n = t("documents").groupBy(F.coalesce("source", lit("?")).alias("source"), F.coalesce("lang", lit("?")).alias("lang")).agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lang", "n"))), lambda x: F.concat(x["lang"], lit(":"), x["n"])), ",")
    return n.groupBy("source").agg(text.alias("by_lang"), F.sum("n").alias("n"))


_RAW = """r AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE l_partkey % 8 WHEN 0 THEN 'true' WHEN 1 THEN '["a","b"]' WHEN 2 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 3 THEN strftime(l_shipdate, '%d/%m/%Y') WHEN 4 THEN (l_partkey % 1000)::VARCHAR || ',5'
WHEN 5 THEN (l_partkey % 1000)::VARCHAR || '.25' WHEN 6 THEN '-' || l_suppkey ELSE 'MTR-' || l_suppkey END AS s FROM lineitem)"""


def _raw(t):
    k, p, s = c("l_partkey") % 8, c("l_partkey"), c("l_suppkey")
    texts = [lit("true"), lit('["a","b"]'), F.date_format("l_shipdate", "yyyy-MM-dd"), F.date_format("l_shipdate", "dd/MM/yyyy"), F.concat(p % 1000, lit(",5")), F.concat(p % 1000, lit(".25")), F.concat(lit("-"), s), F.concat(lit("MTR-"), s)]
    out = F.when(k == 0, texts[0])
    for i, x in enumerate(texts[1:], 1):
        out = out.when(k == i, x)
    return t("lineitem").select(out.alias("s"))


@query(f"""WITH {_RAW} SELECT CASE WHEN s IN ('true', 'false') THEN 'boolean' WHEN s LIKE '[%' THEN 'list' WHEN regexp_full_match(s, '\\d{{4}}-\\d\\d-\\d\\d') THEN 'date' WHEN regexp_full_match(s, '-?\\d+([.,]\\d+)?') THEN 'number' ELSE 'text' END AS kind,
count(*) AS n, sum(CASE WHEN regexp_full_match(s, '-?\\d+([.,]\\d+)?') THEN replace(s, ',', '.')::DECIMAL(18,4) END)::DOUBLE AS numbers FROM r GROUP BY 1""")
def q_inferred_types(t):
    """The type of an undeclared fact, from its text alone."""
    return _raw(t).groupBy(T.inferred_type(c("s")).alias("kind")).agg(F.count("*").alias("n"), F.sum(T.decimal_of(c("s"))).cast("double").alias("numbers"))


@query(f"""WITH {_RAW} SELECT count(*) FILTER (regexp_full_match(s, '-?\\d+([.,]\\d+)?')) AS as_decimal, count(*) FILTER (regexp_full_match(s, '\\d{{4}}-\\d\\d-\\d\\d') OR regexp_full_match(s, '\\d\\d/\\d\\d/\\d{{4}}')) AS as_date,
count(*) FILTER (NOT regexp_full_match(s, '-?\\d+([.,]\\d+)?')) AS not_decimal, min(CASE WHEN s LIKE '__/__/____' THEN strptime(s, '%d/%m/%Y')::DATE WHEN s LIKE '____-__-__' THEN s::DATE END)::VARCHAR AS first_date FROM r""")
def q_declared_types(t):
    """Facts typed as they are declared; what doesn't fit is told."""
    decimal, date = T.typed(c("s"), "decimal"), T.typed(c("s"), "date")
    return _raw(t).agg(F.count(decimal).alias("as_decimal"), F.count(date).alias("as_date"), F.count_if(decimal.isNull()).alias("not_decimal"), F.min(date).cast("string").alias("first_date"))
