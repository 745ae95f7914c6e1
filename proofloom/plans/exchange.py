"""Queries of what leaves the library: nested documents against their schema, views by policy, refused requests, most frequent failures by cell."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofloom.operators import topk as K
from proofloom.operators import validate as V
from proofloom.operators import views as W
from proofloom.plans.registry import query

c, lit = F.col, F.lit

# ---- nested documents

_SCHEMA = {
    "owner": V.Node(required=True, fields={"name": V.Node(required=True, pattern="^Customer#[0-9]{9}$"), "segment": V.Node(one_of=("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"))}),
    "status": V.Node(one_of=("F", "O")),
    "units": V.Node(least_size=1, most_size=6, distinct="part", items=V.Node(fields={"price": V.Node(most=60000.0), "discount": V.Node(least=0.01), "flag": V.Node(one_of=("A", "N"), checks={"shipped": lambda x: x != "N"})})),
}


def _documents(t):
    """(o_orderkey, owner, status, units): an order as a nested document, its units in order."""
    body = F.struct(c("l_partkey").alias("part"), c("l_extendedprice").alias("price"), F.nullif(c("l_discount"), lit(0.05)).alias("discount"), c("l_returnflag").alias("flag"))
    units = t("lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag", "l_discount", body.alias("b")))), lambda x: x["b"]).alias("units"))
    owner = F.when(c("o_orderkey") % 50 != 0, F.struct(F.when(c("o_orderkey") % 77 == 0, "nobody").otherwise(c("c_name")).alias("name"), c("c_mktsegment").alias("segment"))).alias("owner")
    rows = t("orders").join(t("customer"), c("o_custkey") == c("c_custkey")).join(units, c("l_orderkey") == c("o_orderkey"), "left")
    return rows.select("o_orderkey", owner, c("o_orderstatus").alias("status"), "units")


@query("""WITH l AS (SELECT l_orderkey, l_partkey, l_extendedprice AS price, nullif(l_discount, 0.05) AS discount, l_returnflag AS flag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_returnflag, l_discount) - 1 AS i FROM lineitem),
n AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_partkey) AS d FROM l GROUP BY 1), o AS (SELECT o_orderkey, o_orderstatus, o_orderkey % 50 <> 0 AS has, CASE WHEN o_orderkey % 77 = 0 THEN 'nobody' ELSE c_name END AS name, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, 'owner' AS path, 'required' AS "check" FROM o WHERE NOT has UNION ALL SELECT o_orderkey, 'owner.name', 'required' FROM o WHERE NOT has UNION ALL SELECT o_orderkey, 'owner.name', 'pattern' FROM o WHERE has AND NOT regexp_matches(name, '^Customer#[0-9]{9}$')
UNION ALL SELECT o_orderkey, 'owner.segment', 'one of' FROM o WHERE has AND segment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY') UNION ALL SELECT o_orderkey, 'status', 'one of' FROM o WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT l_orderkey, 'units', 'most size' FROM n WHERE n > 6 UNION ALL SELECT l_orderkey, 'units', 'distinct' FROM n WHERE d < n UNION ALL SELECT l_orderkey, 'units[' || i || '].price', 'most' FROM l WHERE price > 60000
UNION ALL SELECT l_orderkey, 'units[' || i || '].discount', 'least' FROM l WHERE discount < 0.01 UNION ALL SELECT l_orderkey, 'units[' || i || '].flag', 'one of' FROM l WHERE flag NOT IN ('A', 'N') UNION ALL SELECT l_orderkey, 'units[' || i || '].flag', 'shipped' FROM l WHERE flag = 'N'""")
def q_nested_violations(t):
    """What the nested document of each order breaks of its schema, with the path of each place."""
    return V.report(_documents(t), ["o_orderkey"], _SCHEMA)


# ---- views

_POLICY = W.Policy(
    admitted={
        "owner": ("identification", "state", "shortfalls", "documents", "history"),
        "checker": ("identification", "state", "shortfalls", "documents", "evidence", "conflicts", "calculation", "verdict", "history", "activity"),
        "auditor": ("identification", "platform", "activity", "audit", "aggregates"),
        "outsider": (),
    },
    shown={
        "read case": ("identification", "state", "shortfalls", "documents", "evidence", "conflicts", "calculation", "verdict", "platform", "aggregates"),
        "read log": ("history", "activity", "audit"),
    },
)


def _content():
    return {
        "identification": {"number": c("o_orderkey"), "owner": c("c_name")},
        "state": {"status": c("o_orderstatus")},
        "shortfalls": {"missing": F.when(c("parts") < 3, "third unit")},
        "documents": {"n": c("lines")},
        "evidence": {"parts": c("parts")},
        "conflicts": {"taxes": F.when(c("lo") < c("hi"), F.concat_ws("-", F.format_string("%.2f", c("lo")), F.format_string("%.2f", c("hi"))))},
        "calculation": {"total": F.round("o_totalprice", 2)},
        "verdict": {"verdict": F.when(c("lo") == c("hi"), "PREVALIDATED").otherwise("BLOCKED")},
        "platform": {"priority": c("o_orderpriority")},
        "aggregates": {"lines": c("lines"), "parts": c("parts")},
    }


@query("""WITH l AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_partkey) AS p, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY 1), r AS (SELECT *, ['owner', 'checker', 'auditor', 'outsider'][o_custkey % 4 + 1] AS r FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN l ON l_orderkey = o_orderkey)
SELECT o_orderkey, r AS role, CASE WHEN r <> 'outsider' THEN c_name END AS owner, CASE WHEN r IN ('owner', 'checker') THEN o_orderstatus END AS status, CASE WHEN r IN ('owner', 'checker') AND p < 3 THEN 'third unit' END AS missing, CASE WHEN r IN ('owner', 'checker') THEN n END AS documents,
CASE WHEN r = 'checker' THEN p END AS parts, CASE WHEN r = 'checker' AND lo < hi THEN printf('%.2f', lo) || '-' || printf('%.2f', hi) END AS taxes, CASE WHEN r = 'checker' THEN round(o_totalprice, 2) END AS total,
CASE WHEN r = 'checker' THEN CASE WHEN lo = hi THEN 'PREVALIDATED' ELSE 'BLOCKED' END END AS verdict, CASE WHEN r = 'auditor' THEN o_orderpriority END AS priority, CASE WHEN r = 'auditor' THEN n END AS lines FROM r""")
def q_policy_view(t):
    """The ten blocks of a case that are not of its log, each for the roles that may see it; the role differs from row to row."""
    lines = t("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"), F.min("l_tax").alias("lo"), F.max("l_tax").alias("hi"))
    lines = lines.groupBy("l_orderkey").agg(F.sum("n").alias("lines"), F.count("*").alias("parts"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    rows = t("orders").join(t("customer"), c("o_custkey") == c("c_custkey")).join(lines, c("l_orderkey") == c("o_orderkey"), "left")
    rows = rows.withColumn("role", F.element_at(F.array(*map(lit, ("owner", "checker", "auditor", "outsider"))), (c("o_custkey") % 4 + 1).cast("int")))
    v = W.view(rows, ["o_orderkey", "role"], _POLICY, "read case", c("role"), _content())
    return v.select("o_orderkey", "role", "identification.owner", "state.status", "shortfalls.missing", c("documents.n").alias("documents"), "evidence.parts", "conflicts.taxes", "calculation.total", "verdict.verdict", "platform.priority", "aggregates.lines")


@query("""SELECT 'history' AS block, user_id, event_id, event_type, sha256(props) AS payload FROM events UNION ALL SELECT 'activity', user_id, event_id, event_type, NULL FROM events UNION ALL SELECT 'audit', user_id, event_id, event_type, NULL FROM events""")
def q_log_views(t):
    """The three blocks of a case's log, as rows: history with payloads for its owner, activity for the checker and audit for the auditor without; nothing for who may not see one."""
    events = t("events").select("user_id", "event_id", "event_type", "props")
    out = None
    for block, role in (("history", "owner"), ("activity", "checker"), ("audit", "auditor"), ("history", "auditor"), ("audit", "owner")):
        rows = W.log_view(events, ["user_id"], _POLICY, "read log", role, block, "props")
        payload = F.sha2("props", 256) if "props" in rows.columns else lit(None).cast("string")
        rows = rows.select(lit(block).alias("block"), "user_id", "event_id", "event_type", payload.alias("payload"))
        out = rows if out is None else out.union(rows)
    return out


_CAPABILITIES = [
    W.Capability("C-0", "read", ("owner", "checker", "auditor")), W.Capability("C-1", "command", ("checker",)), W.Capability("C-2", "read", ("auditor", "checker"), implemented=False),
    W.Capability("C-3", "read", ("owner", "partner"), justified=True), W.Capability("C-4", "read", ("owner", "checker", "auditor", "partner")),
]


@query("""WITH r AS (SELECT o_orderkey, 'C-' || o_orderkey % 6 AS cap, ['owner', 'checker', 'auditor', 'partner'][o_custkey % 4 + 1] AS role, o_custkey % 7 <> 0 AS own, o_custkey % 3 = 0 AS party, CASE WHEN o_orderkey % 5 > 1 THEN 'why' WHEN o_orderkey % 5 = 1 THEN ' ' END AS reason, CASE WHEN o_orderkey % 11 = 0 THEN '1e5' ELSE o_totalprice::VARCHAR END AS x FROM orders)
SELECT o_orderkey, CASE WHEN cap = 'C-5' THEN 'unknown capability' WHEN cap = 'C-1' THEN 'not a read' WHEN NOT CASE cap WHEN 'C-0' THEN role <> 'partner' WHEN 'C-2' THEN role IN ('auditor', 'checker') WHEN 'C-3' THEN role IN ('owner', 'partner') ELSE true END THEN 'not granted'
WHEN role <> 'auditor' AND NOT own THEN 'other tenant' WHEN role = 'partner' AND NOT party THEN 'not a party' WHEN cap = 'C-2' THEN 'not implemented' WHEN x = '1e5' THEN 'binary fraction' WHEN cap = 'C-3' AND trim(coalesce(reason, '')) = '' THEN 'no reason' END AS refused FROM r""")
def q_prepared(t):
    """Why a request is refused before anything is done: the first of eight checks that fails."""
    o, k = c("o_orderkey"), c("o_custkey")
    price = F.when(o % 11 == 0, "1e5").otherwise(c("o_totalprice").cast("decimal(18,2)").cast("string"))
    rows = t("orders").select("o_orderkey", "o_custkey", F.concat(lit("C-"), o % 6).alias("capability"), F.element_at(F.array(*map(lit, ("owner", "checker", "auditor", "partner"))), (k % 4 + 1).cast("int")).alias("role"), F.when(o % 5 > 1, "why").when(o % 5 == 1, " ").alias("reason"), price.alias("number_text"))
    return W.prepared(rows, _CAPABILITIES, "read", k % 7 != 0, ("auditor",), ("partner",), k % 3 == 0).select("o_orderkey", "refused")


# ---- most frequent failures


@query("""WITH f AS (SELECT r_name, n_name, u.item FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey,
unnest([{'item': CASE WHEN l_discount > 0.06 THEN 'rule ' || l_suppkey % 13 END}, {'item': CASE WHEN l_tax > 0.07 THEN 'conflict ' || l_linenumber END}, {'item': CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'discard' END}]) AS t(u) WHERE u.item IS NOT NULL),
n AS (SELECT 'tenant' AS cut, n_name AS cell, item, count(*) AS n FROM f GROUP BY ALL UNION ALL SELECT 'region', r_name, item, count(*) FROM f GROUP BY ALL)
SELECT cut, cell, row_number() OVER (PARTITION BY cut, cell ORDER BY n DESC, item)::INT AS place, item, n FROM n QUALIFY place <= 5""")
def q_top_by_tenant(t):
    """The most frequent failing rules, conflicts and discards by tenant, and by region from the same summaries."""
    rows = t("lineitem").join(t("orders"), c("l_orderkey") == c("o_orderkey")).join(t("customer"), c("o_custkey") == c("c_custkey"))
    rows = rows.join(t("nation"), c("c_nationkey") == c("n_nationkey")).join(t("region"), c("n_regionkey") == c("r_regionkey"))
    rule = F.when(c("l_discount") > 0.06, F.concat(lit("rule "), c("l_suppkey") % 13))
    conflict = F.when(c("l_tax") > 0.07, F.concat(lit("conflict "), "l_linenumber"))
    discard = F.when((c("l_returnflag") == "R") & (c("l_linestatus") == "F"), "discard")
    items = rows.select("r_name", "n_name", F.explode(F.array_compact(F.array(rule, conflict, discard))).alias("item"))
    fine = K.summaries(items, ["r_name", "n_name"], "item", most=64)
    out = None
    for cut, cell in (("tenant", "n_name"), ("region", "r_name")):
        best = K.top(K.merged(fine, [cell], "item", 64), [cell], "item", 5).select(lit(cut).alias("cut"), c(cell).alias("cell"), "place", "item", c("low").alias("n"))
        out = best if out is None else out.union(best)
    return out
