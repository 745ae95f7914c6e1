"""Queries of the event log, the life of a case, tracking, interpretation, access, export, metrics and the benchmark. A user of events is a case."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofloom.functions import text as T
from proofloom.operators import access as A
from proofloom.operators import benchmark as B
from proofloom.operators import export as X
from proofloom.operators import fold
from proofloom.operators import journal as J
from proofloom.operators import log as L
from proofloom.operators import metrics as M
from proofloom.plans.registry import query

c, lit = F.col, F.lit
_FOLD = "trim(regexp_replace(lower(translate({}, '" + T.ACCENTED + "', '" + T.FOLDED + r"')), '[\t\n\x0B\f\r ]+', ' ', 'g'))"

# ---- the log

_ACTORS = """e AS (SELECT event_id, user_id, ts, value, CASE WHEN event_id % 17 = 0 THEN 'bogus' ELSE event_type END AS kind, CASE event_id % 3 WHEN 0 THEN 'human' WHEN 1 THEN 'agent' ELSE 'system' END AS actor,
CASE event_id % 4 WHEN 0 THEN 'owner' WHEN 1 THEN 'checker' ELSE 'engine' END AS role FROM events),
k(kind, human_only) AS (VALUES ('view', false), ('click', false), ('purchase', true), ('signup', true), ('error', false)), m(role, kind) AS (VALUES ('owner', 'view'), ('owner', 'purchase'), ('owner', 'signup'), ('checker', 'signup'), ('checker', 'error'), ('engine', 'view'), ('engine', 'click'), ('engine', 'error'), ('engine', 'purchase')),
r AS (SELECT e.*, CASE WHEN k.kind IS NULL THEN 'unknown kind' WHEN human_only AND actor <> 'human' THEN 'human only' WHEN m.role IS NULL THEN 'role may not' END AS refused FROM e LEFT JOIN k ON e.kind = k.kind LEFT JOIN m ON m.role = e.role AND m.kind = e.kind)"""


def _guarded(t):
    e, events = c("event_id"), t("events")
    spark = events.sparkSession
    kinds = spark.createDataFrame([("view", False), ("click", False), ("purchase", True), ("signup", True), ("error", False)], "kind string, human_only boolean")
    may = {"owner": ("view", "purchase", "signup"), "checker": ("signup", "error"), "engine": ("view", "click", "error", "purchase")}
    roles = spark.createDataFrame([(r, k) for r, ks in may.items() for k in ks], "role string, kind string")
    rows = events.select(
        "event_id",
        "user_id",
        "ts",
        "value",
        F.when(e % 17 == 0, "bogus").otherwise(c("event_type")).alias("kind"),
        F.when(e % 3 == 0, "human").when(e % 3 == 1, "agent").otherwise("system").alias("actor"),
        F.when(e % 4 == 0, "owner").when(e % 4 == 1, "checker").otherwise("engine").alias("role"),
    )
    return J.guarded(rows, kinds, roles, "kind", "actor", "role")


@query(f"WITH {_ACTORS} SELECT event_id, coalesce(refused, 'enters') AS verdict FROM r")
def q_log_guards(t):
    """What may enter the log: the closed list of kinds, kinds for humans only, and what a role may produce."""
    return _guarded(t).select("event_id", F.coalesce("refused", lit("enters")).alias("verdict"))


@query(f"""WITH {_ACTORS} SELECT user_id, count(*) AS entered, sum(value::DECIMAL(12,2))::DOUBLE AS value, arg_max(kind, (ts, event_id)) AS last_kind FROM r WHERE refused IS NULL GROUP BY 1""")
def q_trial_append(t):
    """The log after a trial: refused events leave no trace in it."""
    kept = _guarded(t).where("refused is null")
    return kept.groupBy("user_id").agg(F.count("*").alias("entered"), F.sum(c("value").cast("decimal(12,2)")).cast("double").alias("value"), F.max_by("kind", F.struct("ts", "event_id")).alias("last_kind"))


@query("""WITH f AS (SELECT o_orderkey AS case_id, 0 AS rank, 'case opened' AS kind, o_orderstatus AS body, 0::BIGINT AS k FROM orders UNION ALL SELECT l_orderkey, 1, 'unit registered', l_returnflag || l_linestatus, l_linenumber * 100000 + l_partkey FROM lineitem
UNION ALL SELECT o_orderkey, 2, 'verdict given', o_orderpriority, 0 FROM orders), g AS (SELECT case_id, kind || ':' || body AS x, row_number() OVER (PARTITION BY case_id ORDER BY rank, k, body) AS i FROM f)
SELECT case_id, count(*) AS n, sha256(string_agg(x, chr(10) ORDER BY i)) AS sequence FROM g GROUP BY 1""")
def q_recorded_case(t):
    """A run of the engine as a sequence of events in their fixed order."""
    none = lit(0).cast("long")
    orders = lambda rank, kind, body: t("orders").select(c("o_orderkey").alias("case_id"), lit(rank).alias("rank"), lit(kind).alias("kind"), c(body).alias("body"), none.alias("k"))
    units = t("lineitem").select("l_orderkey", lit(1), lit("unit registered"), F.concat("l_returnflag", "l_linestatus"), c("l_linenumber") * 100_000 + c("l_partkey"))
    rows = orders(0, "case opened", "o_orderstatus").union(units).union(orders(2, "verdict given", "o_orderpriority"))
    return fold.digests(rows, "case_id", ["rank", "k", "body"], F.concat_ws(":", "kind", "body")).withColumnRenamed("sha256", "sequence")


@query("""WITH e AS (SELECT user_id, event_id, '{"variable":"v' || json_extract_string(props, '$.k')::INT % 4 || '","value":"' || json_extract_string(props, '$.k') || '"}' AS payload, event_type FROM events),
p AS (SELECT user_id, event_id, json_extract_string(payload, '$.variable') AS variable, json_extract_string(payload, '$.value')::INT AS value FROM e WHERE event_type <> 'error')
SELECT user_id, max(CASE WHEN variable = 'v0' THEN v END) AS v0, max(CASE WHEN variable = 'v1' THEN v END) AS v1, max(CASE WHEN variable = 'v2' THEN v END) AS v2, max(CASE WHEN variable = 'v3' THEN v END) AS v3 FROM (SELECT user_id, variable, arg_max(value, event_id) AS v FROM p GROUP BY ALL) GROUP BY 1""")
def q_rebuilt_state(t):
    """The consolidated facts of each case, from the payloads of its events alone."""
    k = F.get_json_object("props", "$.k")
    payload = F.to_json(F.struct(F.concat(lit("v"), k.cast("int") % 4).alias("variable"), k.alias("value")))
    return L.rebuilt(t("events").where("event_type <> 'error'").withColumn("payload", payload), "user_id", "event_id", "payload", ["v0", "v1", "v2", "v3"])


@query("""WITH e AS (SELECT user_id AS doc, event_type, event_id, value FROM events) SELECT doc, count(*) FILTER (event_type = 'view') AS registered, arg_max(event_id % 5, event_id) FILTER (event_type = 'click') AS class FROM e WHERE doc NOT IN (SELECT doc FROM e WHERE event_type = 'purchase' AND value > 99) GROUP BY 1 HAVING count(*) FILTER (event_type = 'view') > 0""")
def q_documents_from_log(t):
    """The documents that a log registers, without those that were split, with their last class."""
    e = t("events").withColumnRenamed("user_id", "doc").withColumn("class", c("event_id") % 5)
    return L.documents(e, "doc", "event_id", c("event_type") == "view", (c("event_type") == "purchase") & (c("value") > 99), c("event_type") == "click", "class")


# States of a case and how events move it; * is any state that isn't closed.
_GUARDED = [("DRAFT", "view", None, "EVALUATED"), ("EVALUATED", "click", None, "PASSED"), ("PASSED", "signup", "human", "REVIEWED"), ("REVIEWED", "purchase", None, "PACKED"), ("PACKED", "signup", "human", "SIGNED"), ("SIGNED", "error", None, "OBJECTED"), ("OBJECTED", "click", None, "SIGNED"), ("*", "error", "withdraws", "CLOSED")]
_STATES = ["DRAFT", "EVALUATED", "PASSED", "REVIEWED", "PACKED", "SIGNED", "OBJECTED", "CLOSED"]


@query(f"""WITH RECURSIVE o AS (SELECT user_id, event_type AS e, event_id % 2 = 0 AS human, event_id % 19 = 0 AS withdraws, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 'DRAFT' AS state, 0 AS rejected, NULL::VARCHAR AS error FROM events UNION ALL
SELECT user_id, i, coalesce(dest, state), rejected + (dest IS NULL)::INT, coalesce(error, CASE WHEN dest IS NULL THEN state || ' -> ' || e END) FROM (SELECT o.user_id, o.i, s.state, s.rejected, s.error, o.e,
CASE WHEN e = 'error' AND withdraws AND state <> 'CLOSED' THEN 'CLOSED' {" ".join(f"WHEN state = '{a}' AND e = '{e}'{' AND human' if g else ''} THEN '{b}'" for a, e, g, b in _GUARDED[:-1])} END AS dest FROM s JOIN o ON o.user_id = s.user_id AND o.i = s.i + 1))
SELECT user_id, arg_max(state, i) AS state, max(rejected) AS rejected, max(error) AS error FROM s GROUP BY 1""")
def q_guarded_states(t):
    """The life of a case with guards: humans sign and review, packaging needs a review, a withdrawal closes; what isn't declared is refused, and the first refusal is told."""

    def step(state, e):
        to = F.lit(None).cast("string")
        for a, kind, guard, b in _GUARDED:
            fits = (state != "CLOSED") if a == "*" else (state == a)
            fits = fits & (e["kind"] == kind)
            to = F.when(fits & e[guard], b).otherwise(to) if guard else F.when(fits, b).otherwise(to)
        return to

    fields = [c("event_type").alias("kind"), (c("event_id") % 2 == 0).alias("human"), (c("event_id") % 19 == 0).alias("withdraws")]
    return fold.replay_spans(t("events"), "user_id", ["ts", "event_id"], _STATES, "DRAFT", step, fields)


@query("""WITH p AS (SELECT 'L' || n_nationkey AS literal, 'STATE_' || n_regionkey AS state FROM nation WHERE n_nationkey < 20) SELECT coalesce(p.state, e.literal) AS state, p.state IS NULL AS escalate, count(*) AS n FROM (SELECT 'L' || event_id % 25 AS literal FROM events) e LEFT JOIN p ON e.literal = p.literal GROUP BY ALL""")
def q_platform_states(t):
    """A platform's literals as states; unknown ones are reflected and escalated."""
    table = t("nation").where("n_nationkey < 20").select(F.concat(lit("L"), "n_nationkey").alias("literal"), F.concat(lit("STATE_"), "n_regionkey").alias("state"))
    rows = J.mapped_literals(t("events").select(F.concat(lit("L"), c("event_id") % 25).alias("literal")), "literal", table)
    return rows.groupBy("state", "escalate").agg(F.count("*").alias("n"))


@query("""SELECT r.mark, coalesce(n, 0) AS n FROM (VALUES ('0'), ('3'), ('9')) r(mark) LEFT JOIN (SELECT (n_nationkey % 4 * n_nationkey)::VARCHAR AS mark, count(*) AS n FROM nation GROUP BY 1) x ON x.mark = r.mark WHERE coalesce(n, 0) <> 1""")
def q_table_marks(t):
    """Special marks that a table must have exactly once, and doesn't."""
    table = t("nation").select((c("n_nationkey") % 4 * c("n_nationkey")).cast("string").alias("mark"))
    return J.one_of_each(table, "mark", ["0", "3", "9"])


# ---- tracking

_CODES = """k AS (SELECT 'C' || (c_custkey % 700) || CASE WHEN c_custkey % 3 = 0 THEN '-B' ELSE '' END AS code, c_custkey AS case_id FROM customer), i AS (SELECT code, min(case_id) AS case_id FROM k GROUP BY 1 HAVING count(*) = 1)"""


def _codes(t):
    code = F.concat(lit("C"), c("c_custkey") % 700, F.when(c("c_custkey") % 3 == 0, "-B").otherwise(""))
    return t("customer").select(code.alias("code"), c("c_custkey").alias("case_id"))


@query(f"WITH {_CODES} SELECT code, count(*) AS n FROM k GROUP BY 1 HAVING count(*) > 1")
def q_ambiguous_codes(t):
    """Codes that more than one case has."""
    return J.index_codes(_codes(t), "code", "case_id")[1]


@query(f"""WITH {_CODES}, r AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'C' || o_custkey % 700 WHEN 1 THEN 'EX-C' || (o_custkey % 700) || '-B-2024' WHEN 2 THEN 'EX-C' || (o_custkey % 700) || '-' || o_orderkey WHEN 3 THEN 'XC' || o_custkey ELSE 'C' || (o_custkey % 700) || '-C' || (o_orderkey % 700) END AS ref FROM orders),
x AS (SELECT o_orderkey, max(CASE WHEN ref = code THEN case_id END) AS exact, min(case_id) AS lo, count(*) AS n FROM r JOIN i ON contains('-' || ref || '-', '-' || code || '-') GROUP BY 1)
SELECT r.o_orderkey, coalesce(exact, CASE WHEN n = 1 THEN lo END) AS case_id FROM r LEFT JOIN x ON x.o_orderkey = r.o_orderkey""")
def q_resolved_references(t):
    """The case that a foreign reference means: its code, else the only one that it holds; by equality of its parts, not by trying every code."""
    k, cust = c("o_orderkey") % 5, c("o_custkey") % 700
    ref = F.when(k == 0, F.concat(lit("C"), cust)).when(k == 1, F.concat(lit("EX-C"), cust, lit("-B-2024"))).when(k == 2, F.concat(lit("EX-C"), cust, lit("-"), c("o_orderkey")))
    ref = ref.when(k == 3, F.concat(lit("XC"), c("o_custkey"))).otherwise(F.concat(lit("C"), cust, lit("-C"), c("o_orderkey") % 700))
    index, _ = J.index_codes(_codes(t), "code", "case_id")
    return J.resolved(t("orders").select("o_orderkey", ref.alias("ref")), "ref", index, "code", "case_id").select("o_orderkey", "case_id")


@query("""WITH r AS (SELECT user_id, date_trunc('hour', ts) AS moment, event_type AS kind, event_id AS arrival FROM events UNION ALL SELECT user_id, date_trunc('hour', ts), event_type, event_id + 1000000 FROM events WHERE event_id % 3 = 0),
o AS (SELECT user_id, moment, kind, min(arrival) AS arrival FROM r GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY moment, CASE WHEN kind IN ('view', 'error') THEN 0 ELSE 1 END, arrival) AS seq FROM o)
SELECT user_id, seq::INT AS seq, kind, arrival FROM s""")
def q_synchronised(t):
    """Reports that come twice enter once, in the order of instant, states before tasks, arrival."""
    e = t("events").select("user_id", F.date_trunc("hour", "ts").alias("at"), c("event_type").alias("kind"), c("event_id").alias("arrival"))
    again = e.where("arrival % 3 = 0").withColumn("arrival", c("arrival") + 1_000_000)
    rank = F.when(c("kind").isin("view", "error"), 0).otherwise(1)
    return J.synchronised(e.union(again), "user_id", "at", rank, "arrival", ["user_id", "at", "kind"]).select("user_id", "seq", "kind", "arrival")


@query("""WITH m AS (SELECT DISTINCT user_id % 10 AS bundle, user_id FROM events), x AS (SELECT user_id, event_id FROM events WHERE event_type = 'error' AND value > 190), has AS (SELECT DISTINCT user_id, event_id FROM events WHERE value < 195),
p AS (SELECT m.user_id, x.event_id, false AS direct FROM x JOIN m ON m.bundle = x.user_id % 10 AND m.user_id <> x.user_id UNION ALL SELECT user_id, event_id, true FROM x) SELECT user_id, event_id, direct FROM p WHERE (user_id, event_id) NOT IN (SELECT user_id, event_id FROM has)""")
def q_contagion_events(t):
    """The events that an objection writes into the logs of all members of its bundle, but for those that are there already."""
    e = t("events")
    members = e.select((c("user_id") % 10).alias("bundle"), "user_id").distinct()
    marked = e.where("event_type = 'error' and value > 190").select((c("user_id") % 10).alias("bundle"), c("user_id").alias("named"), "event_id")
    known = e.where("value < 195").select("user_id", "event_id")
    return L.peer_events(marked, members, "bundle", "user_id", "named", "event_id", known).select("user_id", "event_id", "direct")


# ---- interpretation

_TERMS = "list_distinct(list_filter(string_split_regex({}, '[^a-z0-9]+'), lambda x: length(x) >= 4))"
_SCORES = f"""i AS (SELECT item_id, unnest({_TERMS.format(_FOLD.format("coalesce(text, '')"))}) AS term FROM benchmark), d AS (SELECT term, 1000000 // count(*) AS w FROM i GROUP BY 1), w AS (SELECT item_id, i.term, w FROM i JOIN d ON d.term = i.term),
t AS (SELECT item_id, sum(w) AS whole FROM w GROUP BY 1), r AS (SELECT doc_id, unnest({_TERMS.format(_FOLD.format("coalesce(text, '')"))}) AS term FROM documents),
p AS (SELECT doc_id, w.item_id, sum(w) AS shared FROM r JOIN w ON w.term = r.term GROUP BY ALL), q AS (SELECT p.*, whole FROM p JOIN t ON t.item_id = p.item_id WHERE shared >= 1000000 AND 5 * shared >= whole),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, item_id) AS k, max(shared) OVER (PARTITION BY doc_id) AS best FROM q)"""


def _scored(t):
    weights = J.term_weights(t("benchmark"), "item_id", T.significant_terms(F.coalesce("text", lit(""))))
    return J.scored(t("documents"), ["doc_id"], T.significant_terms(F.coalesce("text", lit(""))), weights, "item_id")


@query(f"""WITH {_SCORES} SELECT doc_id, item_id, least(90, 100 * shared // whole)::INT AS confidence FROM k WHERE k <= 3 AND 10 * shared >= 6 * best""")
def q_scored_items(t):
    """What an objection may be about: candidates by the weights of the terms that they share with it."""
    return _scored(t)


@query(f"""WITH {_SCORES}, h AS (SELECT DISTINCT doc_id FROM k) SELECT count(*) AS reasons, count(h.doc_id) AS with_items, count(*) - count(h.doc_id) AS escalated FROM documents u LEFT JOIN h ON h.doc_id = u.doc_id""")
def q_interpreted(t):
    """Objections with items, and those without any, which go to a human."""
    found = _scored(t).select("doc_id").distinct().withColumn("found", lit(1))
    return t("documents").select("doc_id").join(found, "doc_id", "left").agg(F.count("*").alias("reasons"), F.count("found").alias("with_items"), F.count_if(c("found").isNull()).alias("escalated"))


@query("""WITH r AS (SELECT conv_id, turn, coalesce(text, '') || CASE turn % 3 WHEN 0 THEN ' see r-' || conv_id % 5 WHEN 1 THEN ' xr-' || conv_id % 5 ELSE '' END AS x, split_part(coalesce(text, ''), ' ', 2) AS item FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'r-' || conv_id % 5 END AS cited, contains(x, item) AS verbatim FROM r""")
def q_citations(t):
    """Rules that an objection cites by name, and whether an item's words stand in it as they are."""
    text = F.coalesce("text", lit(""))
    extra = F.when(c("turn") % 3 == 0, F.concat(lit(" see r-"), c("conv_id") % 5)).when(c("turn") % 3 == 1, F.concat(lit(" xr-"), c("conv_id") % 5)).otherwise("")
    rows = t("conversations").select("conv_id", "turn", F.concat(text, extra).alias("x"), F.split_part(text, lit(" "), lit(2)).alias("item"))
    cited = F.lit(None).cast("string")
    for i in range(5):
        cited = F.when(T.cites(F.lower("x"), lit(f"r-{i}")), f"r-{i}").otherwise(cited)
    return rows.select("conv_id", "turn", cited.alias("cited"), c("x").contains(c("item")).alias("verbatim"))


@query("""WITH s AS (SELECT user_id, max(event_type = 'signup' AND value > 95)::INT AS signed, count(*) FILTER (event_type = 'error' AND value > 95) AS open, max(value) FILTER (event_type = 'click') AS top, min(event_id) AS first FROM events GROUP BY 1)
SELECT user_id, CASE WHEN signed = 0 THEN 'not signed' WHEN open = 0 THEN 'no open objection' WHEN NOT top > 97 THEN 'no item' WHEN first % 2 = 1 THEN 'not a human' END AS refused, CASE WHEN signed = 1 AND open > 0 AND top > 97 AND first % 2 = 0 THEN 2 ELSE 0 END AS events FROM s""")
def q_reopened(t):
    """Cases that may be opened again, by four checks in order, and the two events that this writes."""
    s = t("events").groupBy("user_id").agg(F.bool_or((c("event_type") == "signup") & (c("value") > 95)).alias("signed"), F.count_if((c("event_type") == "error") & (c("value") > 95)).alias("open"), F.max(F.when(c("event_type") == "click", c("value"))).alias("top"), F.min("event_id").alias("first"))
    checks = {"not signed": c("signed"), "no open objection": c("open") > 0, "no item": c("top") > 97, "not a human": c("first") % 2 == 0}
    return J.reopened(s, checks).select("user_id", "refused", F.size("events").alias("events"))


# ---- access

_MATRIX = """cap AS (SELECT 'cap' || n_nationkey % 20 AS capability, CASE n_nationkey % 6 WHEN 5 THEN 'never' WHEN 4 THEN 'view' WHEN 3 THEN 'click' WHEN 2 THEN 'purchase' WHEN 1 THEN 'signup' ELSE 'error' END AS event FROM nation),
gr AS (SELECT DISTINCT 'p' || s_nationkey % 4 AS profile, 'cap' || s_suppkey % 23 AS capability FROM supplier WHERE s_suppkey % 3 = 0), pe AS (SELECT DISTINCT 'p' || s_nationkey % 4 AS profile, 'cap' || s_suppkey % 23 AS capability FROM supplier WHERE s_suppkey % 31 = 0)"""


def _matrix(t):
    k = c("n_nationkey") % 6
    event = F.when(k == 5, "never").when(k == 4, "view").when(k == 3, "click").when(k == 2, "purchase").when(k == 1, "signup").otherwise("error")
    caps = t("nation").select(F.concat(lit("cap"), c("n_nationkey") % 20).alias("capability"), event.alias("event"))
    pairs = lambda n: t("supplier").where(c("s_suppkey") % n == 0).select(F.concat(lit("p"), c("s_nationkey") % 4).alias("profile"), F.concat(lit("cap"), c("s_suppkey") % 23).alias("capability")).distinct()
    return caps, pairs(3), pairs(31)


@query(f"""WITH {_MATRIX} SELECT 'repeated' AS fault, capability AS id FROM cap GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'unknown event', event FROM cap WHERE event NOT IN (SELECT event_type FROM events)
UNION ALL SELECT 'granted and pending', profile || '/' || capability FROM gr WHERE (profile, capability) IN (SELECT profile, capability FROM pe) UNION ALL SELECT 'grant of nothing', profile || '/' || capability FROM gr WHERE capability NOT IN (SELECT capability FROM cap)""")
def q_matrix_faults(t):
    """What is wrong with a matrix of capabilities."""
    caps, grants, pending = _matrix(t)
    return A.matrix_faults(caps, t("events").select(c("event_type").alias("event")).distinct(), grants, pending)


@query(f"""WITH {_MATRIX} SELECT event, string_agg(DISTINCT profile, ',' ORDER BY profile) AS profiles FROM cap JOIN gr ON gr.capability = cap.capability GROUP BY 1""")
def q_profiles_by_event(t):
    """Who may cause which event."""
    caps, grants, _ = _matrix(t)
    return A.profiles_by_event(caps, grants).groupBy("event").agg(F.array_join(F.array_sort(F.collect_set("profile")), ",").alias("profiles"))


@query(f"""WITH {_MATRIX} SELECT c_mktsegment, count(*) AS n FROM customer WHERE ('p' || c_nationkey % 4, 'cap' || c_custkey % 23) IN (SELECT profile, capability FROM gr) GROUP BY 1""")
def q_conceded(t):
    """What principals are allowed to do."""
    _, grants, _ = _matrix(t)
    rows = t("customer").select("c_mktsegment", F.concat(lit("p"), c("c_nationkey") % 4).alias("pr"), F.concat(lit("cap"), c("c_custkey") % 23).alias("ca"))
    return A.conceded(rows, "pr", "ca", grants).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'owner' WHEN 1 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'owner' WHEN c_nationkey % 3 = 0 THEN 'checker' END WHEN 2 THEN CASE WHEN c_nationkey % 3 = 0 THEN 'checker' END END AS role FROM customer""")
def q_role_resolution(t):
    """The role somebody acts in: the only candidate, else the screen's, else the surface's."""
    k = c("c_custkey") % 4
    none = F.array().cast("array<string>")
    candidates = F.when(k == 0, F.array(lit("owner"))).when(k == 1, F.array(lit("owner"), lit("checker"))).when(k == 2, F.array(lit("checker"), lit("reader"))).otherwise(none)
    screen = F.when(c("c_nationkey") % 2 == 0, "owner").otherwise("elsewhere")
    surface = F.when(c("c_nationkey") % 3 == 0, "checker")
    return t("customer").select("c_custkey", A.role_of(candidates, screen, surface).alias("role"))


@query("""SELECT o_orderkey, 'status,total' AS blocks, o_orderstatus AS status, CASE WHEN o_custkey % 3 = 0 THEN o_totalprice END AS total, NULL::VARCHAR AS audit FROM orders WHERE o_custkey % 3 = 0 UNION ALL SELECT o_orderkey, 'status', o_orderstatus, NULL, NULL FROM orders WHERE o_custkey % 3 <> 0""")
def q_case_view(t):
    """The blocks of a case that somebody may see."""
    admitted = F.when(c("o_custkey") % 3 == 0, F.array(lit("total"), lit("status"))).otherwise(F.array(lit("status")))
    seen = A.blocks(F.array(*map(lit, ("status", "total", "audit"))), admitted)
    rows = t("orders").withColumn("seen", seen)
    blocks = {"status": c("o_orderstatus"), "total": c("o_totalprice"), "audit": c("o_orderpriority")}
    return A.view(rows, ["o_orderkey", F.array_join("seen", ",").alias("blocks")], blocks, c("seen"))


@query("""SELECT user_id, count(*) AS n, string_agg(event_type, ',' ORDER BY ts, event_id) AS activity, count(*) FILTER (event_type = 'error') AS errors FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1""")
def q_activity(t):
    """What happened in a case, without payloads, of some kinds only."""
    rows = t("events").where("event_type in ('error', 'purchase')").drop("props", "value")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]), ",").alias("activity"), F.count_if(c("event_type") == "error").alias("errors"))


@query("""WITH v AS (SELECT l_partkey, l_tax, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_partkey, count(*) AS values, NULL::DOUBLE AS consumed, string_agg(printf('%.2f', l_tax) || 'x' || n, ',' ORDER BY l_tax) AS opposing FROM v GROUP BY 1 HAVING count(*) > 1""")
def q_conflict_block(t):
    """Facts in conflict with what opposes what; no value is consumed."""
    v = t("lineitem").groupBy("l_partkey", "l_tax").agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_tax", "n"))), lambda x: F.concat(F.format_string("%.2f", x["l_tax"]), lit("x"), x["n"])), ",")
    return v.groupBy("l_partkey").agg(F.count("*").alias("values"), text.alias("opposing")).where("values > 1").withColumn("consumed", lit(None).cast("double"))


# ---- export

_DOC = """'{"key":"' || o_orderkey || '","status":"' || o_orderstatus || '"' || coalesce(',"units":[' || u || ']', '') || '}'"""


@query(f"""WITH l AS (SELECT l_orderkey, string_agg('{{"flag":"' || l_returnflag || '","price":"' || printf('%.2f', l_extendedprice) || '"}}', ',' ORDER BY l_linenumber, l_partkey, l_extendedprice, l_returnflag) AS u FROM lineitem GROUP BY 1)
SELECT o_orderkey, sha256({_DOC}) AS seal FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def q_canonical_case(t):
    """A case as canonical nested JSON, sealed by its fingerprint."""
    cases = t("orders").withColumn("k", c("o_orderkey"))
    units = t("lineitem").withColumn("k", c("l_orderkey"))
    price = c("l_extendedprice").cast("decimal(12,2)")
    doc = X.nested(cases, units, "k", {"key": c("o_orderkey"), "status": c("o_orderstatus")}, {"flag": c("l_returnflag"), "price": price}, ["l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag"])
    return doc.select(c("k").alias("o_orderkey"), F.sha2("document", 256).alias("seal"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(',', CASE WHEN l_shipdate < TIMESTAMP '1995-01-01' THEN 'date' END, CASE WHEN NOT l_discount <= 0.08 THEN 'discount' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'flag' END) AS broken FROM lineitem""")
def q_constraints(t):
    """The constraints that a row breaks."""
    checks = {"discount": c("l_discount") <= 0.08, "flag": c("l_returnflag").isin("A", "N"), "date": c("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")}
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.violations(checks).alias("broken"))


@query("""SELECT coalesce(p_partkey, l_partkey) AS p_partkey, n, CASE WHEN l_partkey IS NULL THEN 'no result' WHEN p_partkey IS NULL THEN 'no unit' ELSE 'both' END AS side FROM (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0) FULL JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY 1) ON p_partkey = l_partkey""")
def q_paired_units(t):
    """Units and their results by identity, and which of both is missing."""
    results = t("lineitem").where("l_partkey % 5 <> 0").groupBy(c("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return X.paired(t("part").where("p_partkey % 7 <> 0").select("p_partkey"), results, "p_partkey")


@query("""WITH d AS (SELECT doc_id, 'f' || doc_id AS path, sha256(coalesce(text, '')) AS sha FROM documents), m AS (SELECT * FROM d WHERE doc_id % 10 <> 3), f AS (SELECT path, CASE WHEN doc_id % 10 = 4 THEN sha256(sha) ELSE sha END AS sha FROM d WHERE doc_id % 10 <> 5),
s AS (SELECT coalesce(m.path, f.path) AS path, CASE WHEN f.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'extra' WHEN m.sha <> f.sha THEN 'altered' ELSE 'ok' END AS status FROM m FULL JOIN f ON m.path = f.path)
SELECT path, status FROM s UNION ALL SELECT m.path || '#2', status FROM m JOIN s ON s.path = m.path WHERE doc_id % 6 = 0""")
def q_manifest_verified(t):
    """Files against their manifest: altered, missing, extra; parts are as their whole is."""
    d = t("documents").select("doc_id", F.concat(lit("f"), "doc_id").alias("path"), F.sha2(F.coalesce("text", lit("")), 256).alias("sha"))
    manifest = d.where("doc_id % 10 <> 3")
    parts = manifest.where("doc_id % 6 = 0").select(F.concat("path", lit("#2")).alias("path"), lit(None).cast("string").alias("sha"), c("path").alias("parent"))
    found = d.where("doc_id % 10 <> 5").select("path", F.when(c("doc_id") % 10 == 4, F.sha2("sha", 256)).otherwise(c("sha")).alias("sha"))
    return X.verify_manifest(manifest.select("path", "sha", lit(None).cast("string").alias("parent")).union(parts), found)


# ---- metrics

@query("""WITH p AS (SELECT user_id, min(ts) FILTER (event_type = 'purchase' AND value > 90) AS done, min(ts) FILTER (event_type = 'error' AND value > 90) AS objected FROM events GROUP BY 1)
SELECT (user_id % 12)::INT AS tenant, count(done) AS finished, count(done) > 0 AS has_data, CASE WHEN count(done) > 0 THEN round(count(*) FILTER (done IS NOT NULL AND (objected IS NULL OR objected >= done))::DOUBLE / count(done), 6) END AS rate FROM p GROUP BY 1""")
def q_clean_rate(t):
    """The share of finished cases that met no objection before; no data is no rate, never zero."""
    e = t("events").withColumn("tenant", (c("user_id") % 12).cast("int"))
    return M.clean_rate(e, "tenant", "user_id", "ts", (c("event_type") == "purchase") & (c("value") > 90), (c("event_type") == "error") & (c("value") > 90))


@query("""SELECT n_name AS tenant, (sum(o_totalprice::DECIMAL(12,2)) FILTER (o_orderstatus = 'F'))::DOUBLE AS savings, count(*) FILTER (o_orderstatus = 'F') AS n, count(*) FILTER (o_orderstatus = 'F') > 0 AS has_data FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def q_savings_by_tenant(t):
    """The savings of all cases that passed, by tenant."""
    rows = t("orders").join(t("customer"), c("o_custkey") == c("c_custkey")).join(F.broadcast(t("nation")), c("c_nationkey") == c("n_nationkey"))
    return M.conditional_sum(rows, c("n_name").alias("tenant"), c("o_totalprice").cast("decimal(12,2)"), c("o_orderstatus") == "F").withColumn("savings", c("savings").cast("double"))


@query("""SELECT json_extract_string(props, '$.k')::INT % 6 AS origin, count(*) AS n, count(DISTINCT user_id) AS cases, count(*) FILTER (value > 90) AS spread FROM events WHERE event_type = 'error' GROUP BY 1""")
def q_objections_by_origin(t):
    """Objections by where they come from, and how many of them spread."""
    rows = t("events").where("event_type = 'error'").withColumn("origin", F.get_json_object("props", "$.k").cast("int") % 6)
    return M.by_origin(rows, "origin", "user_id", c("value") > 90)


@query("""WITH d AS (SELECT l_suppkey, date_trunc('month', l_shipdate) AS month, count(*) AS demand FROM lineitem GROUP BY ALL) SELECT l_suppkey, month::DATE::VARCHAR AS month, demand, 5 + l_suppkey % 7 AS capacity, demand - (5 + l_suppkey % 7) AS short FROM d WHERE demand > 5 + l_suppkey % 7""")
def q_capacity(t):
    """Verifiers with more to do in a month than they can."""
    demand = t("lineitem").groupBy("l_suppkey", F.to_date(F.date_trunc("month", "l_shipdate")).cast("string").alias("month")).agg(F.count("*").alias("demand"))
    capacity = t("supplier").select(c("s_suppkey").alias("l_suppkey"), (5 + c("s_suppkey") % 7).alias("capacity"))
    return M.shortage(demand, capacity, ["l_suppkey"])


@query("""SELECT (user_id % 9)::INT AS actor, count(DISTINCT user_id) AS cases, count(*) AS actions, count(*) FILTER (event_type IN ('signup', 'error')) AS admin, count(*) FILTER (value > 50) AS reassigned FROM events GROUP BY 1""")
def q_team_load(t):
    """What each of a team has to do, and what was given to others."""
    e = t("events").withColumn("actor", (c("user_id") % 9).cast("int"))
    return M.team_load(e, "actor", "user_id", c("event_type").isin("signup", "error"), c("value") > 50)


@query("""SELECT event_type AS method, count(*) AS n, round(count(*) FILTER (value < 10)::DOUBLE / count(*), 6) AS low_share, round(count(*) FILTER (value IS NULL OR value = 50)::DOUBLE / count(DISTINCT user_id), 6) AS open_a_case FROM events GROUP BY 1""")
def q_extraction_mix(t):
    """How facts were read, how many with little confidence, and how many stayed open a case."""
    e = t("events")
    cases = e.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.count_if(c("value") < 10).alias("low"), F.count_if(c("value").isNull() | (c("value") == 50)).alias("open"))
    return M.mix(cases, "event_type", "method")


@query("""SELECT user_id % 10 AS step, count(*) AS runs, count(*) FILTER (event_type = 'error') AS errors, max(value) AS slowest, round(avg(value), 6) AS mean, count(*) FILTER (value > 80) AS over_budget FROM events GROUP BY 1""")
def q_run_health(t):
    """Errors, times and budgets of the steps of runs."""
    return M.run_health(t("events").withColumn("step", c("user_id") % 10), "step", c("event_type") == "error", c("value"), 80)


@query("""WITH d AS (SELECT doc_id % 20 AS user_id, n_chars AS ms FROM documents) SELECT user_id, quantile_disc(ms, 0.5)::BIGINT AS p50, quantile_disc(ms, 0.95)::BIGINT AS p95, count(ms) AS n FROM d GROUP BY 1""")
def q_exact_quantiles(t):
    """Exact quantiles from counts of values: no group is sorted whole in one task."""
    return M.quantiles(t("documents").select((c("doc_id") % 20).alias("user_id"), c("n_chars").alias("ms")), "user_id", "ms", {"p50": 0.5, "p95": 0.95})


# ---- the benchmark

_EXPECTED = """got AS (SELECT l_orderkey AS case_id, CASE WHEN max(l_discount) > 0.09 THEN 'BLOCKED' WHEN count(*) < 3 THEN 'FIXABLE' ELSE 'PREVALIDATED' END AS verdict, sum(l_quantity)::BIGINT AS total, list_sort(list_distinct(list(l_returnflag))) AS notes FROM lineitem GROUP BY 1),
want AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderstatus = 'F' THEN 'BLOCKED' WHEN o_orderstatus = 'O' THEN 'FIXABLE' ELSE 'PREVALIDATED' END AS verdict, (o_custkey % 200)::BIGINT AS total, CASE WHEN o_orderkey % 2 = 0 THEN ['A'] ELSE ['A', 'R'] END AS notes FROM orders),
j AS (SELECT want.case_id, want.verdict IS NOT DISTINCT FROM got.verdict AS verdict_ok, want.total IS NOT DISTINCT FROM got.total AS total_ok, len(list_filter(want.notes, lambda x: NOT list_contains(coalesce(got.notes, []), x))) = 0 AS notes_ok FROM want LEFT JOIN got ON got.case_id = want.case_id)"""


def _compared(t):
    got = t("lineitem").groupBy(c("l_orderkey").alias("case_id")).agg(
        F.when(F.max("l_discount") > 0.09, "BLOCKED").when(F.count("*") < 3, "FIXABLE").otherwise("PREVALIDATED").alias("verdict"), F.sum("l_quantity").cast("long").alias("total"), F.collect_set("l_returnflag").alias("notes")
    )
    status = c("o_orderstatus")
    want = t("orders").select(
        c("o_orderkey").alias("case_id"),
        F.when(status == "F", "BLOCKED").when(status == "O", "FIXABLE").otherwise("PREVALIDATED").alias("verdict"),
        (c("o_custkey") % 200).alias("total"),
        F.when(c("o_orderkey") % 2 == 0, F.array(lit("A"))).otherwise(F.array(lit("A"), lit("R"))).alias("notes"),
    )
    return B.compared(want, got, "case_id", equal=["verdict", "total"], subset=["notes"])


@query(f"WITH {_EXPECTED} SELECT case_id, verdict_ok, total_ok, notes_ok, verdict_ok AND total_ok AND notes_ok AS passed FROM j")
def q_compared_cases(t):
    """Expected and obtained results case by case: verdicts and totals by equality, notes by inclusion."""
    return _compared(t)


@query(f"WITH {_EXPECTED} SELECT count(*) AS cases, count(*) FILTER (verdict_ok AND total_ok AND notes_ok) AS passed, count(*) FILTER (verdict_ok) AS verdicts, count(*) FILTER (total_ok) AS totals, count(*) FILTER (notes_ok) AS notes FROM j")
def q_benchmark_summary(t):
    """The totals of a benchmark."""
    return B.summary(_compared(t), {"verdicts": "verdict_ok", "totals": "total_ok", "notes": "notes_ok"})


@query("""SELECT l_orderkey, count(*) AS facts, count(nullif(l_suppkey % 5, 0)) AS with_evidence, count(DISTINCT l_returnflag) AS extracted, 3 AS expected, round(count(nullif(l_suppkey % 5, 0))::DOUBLE / count(*), 6) AS coverage FROM lineitem GROUP BY 1""")
def q_evidence_coverage(t):
    """How many facts have evidence, and how many of the expected inputs were extracted."""
    return B.coverage(t("lineitem"), "l_orderkey", F.nullif(c("l_suppkey") % 5, lit(0).cast("long")).isNotNull(), "l_returnflag", 3)
