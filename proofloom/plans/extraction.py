"""Queries of reading, classifying and extracting: documents, conversations and pages as documents, their lines as rows of tables or labelled text."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofloom.functions import text as T
from proofloom.operators import evidence as E
from proofloom.operators import extract as X
from proofloom.plans.registry import query

c, lit = F.col, F.lit
_FOLD = "trim(regexp_replace(lower(translate({}, '" + T.ACCENTED + "', '" + T.FOLDED + r"')), '[\t\n\x0B\f\r ]+', ' ', 'g'))"

# ---- classification

_TITLE = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
_LEXICON = {"list": (("the", "and"), ("der", "die")), "note": (("que",), ("que", "de")), "mark": (("%%%",),), "spaced": (("&amp;",),)}
_NOT = {"note": ("###",)}


@query(f"""WITH t AS (SELECT page_id, {_FOLD.format(_TITLE)} AS title FROM pages), m AS (SELECT page_id, u.kind, u.terms, u.pos FROM t, unnest([
{{'kind': CASE WHEN contains(title, 'the') AND contains(title, 'and') THEN 'list' END, 'terms': 2, 'pos': 0}}, {{'kind': CASE WHEN contains(title, 'der') AND contains(title, 'die') THEN 'list' END, 'terms': 2, 'pos': 1}},
{{'kind': CASE WHEN contains(title, 'que') AND NOT contains(title, '###') THEN 'note' END, 'terms': 1, 'pos': 2}}, {{'kind': CASE WHEN contains(title, 'que') AND contains(title, 'de') AND NOT contains(title, '###') THEN 'note' END, 'terms': 2, 'pos': 3}},
{{'kind': CASE WHEN contains(title, '%%%') THEN 'mark' END, 'terms': 1, 'pos': 4}}, {{'kind': CASE WHEN contains(title, '&amp;') THEN 'spaced' END, 'terms': 1, 'pos': 5}}]) AS x(u))
SELECT t.page_id, arg_min(kind, pos - 100 * terms) FILTER (kind IS NOT NULL) AS kind FROM t LEFT JOIN m ON t.page_id = m.page_id GROUP BY 1""")
def q_title_class(t):
    """The kind that a title says: all terms of a group, none that excludes it, the group with most terms first."""
    title = T.fold(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    return t("pages").select("page_id", X.title_kind(title, _LEXICON, _NOT).alias("kind"))


@query(f"""WITH t AS (SELECT page_id, {_FOLD.format(_TITLE)} AS title, html FROM pages), s AS (SELECT page_id, u.kind, u.score FROM t, unnest([
{{'kind': 'news', 'score': 6 * (contains(title, 'a'))::INT + 2 * (contains(html, '<article>'))::INT + 2 * (contains(html, '<h1>'))::INT}},
{{'kind': 'shop', 'score': 6 * (contains(title, 'zz'))::INT + 2 * (contains(html, '<table>'))::INT + 2 * (contains(html, 'price'))::INT}},
{{'kind': 'blog', 'score': 6 * (contains(title, 'que'))::INT + 2 * (contains(html, '<br>'))::INT + 2 * (contains(html, '<ul>'))::INT}}]) AS x(u))
SELECT page_id, CASE WHEN max(score) >= 3 THEN arg_max(kind, score * 10 - CASE kind WHEN 'blog' THEN 0 WHEN 'news' THEN 1 ELSE 2 END) ELSE 'unclassified' END AS kind, max(score)::INT AS score FROM s GROUP BY 1""")
def q_scored_class(t):
    """The best kind by title (six tenths) and typical fields (four tenths); ties by name, under three tenths none."""
    title = T.fold(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    kinds = {"news": ("a", ("<article>", "<h1>")), "shop": ("zz", ("<table>", "price")), "blog": ("que", ("<br>", "<ul>"))}
    kind, score = X.scored_kind(title, c("html"), kinds, least=3)
    return t("pages").select("page_id", kind.alias("kind"), score.alias("score"))


@query("""SELECT CASE WHEN contains(head, 'ring') OR contains(head, 'bolt') THEN 'fastener' WHEN contains(head, 'a') THEN 'other a' ELSE 'rest' END AS category, count(*) AS n FROM (SELECT lower(string_split_regex(p_name || ' (' || p_type || '), x', '[(,;]')[1]) AS head FROM part) GROUP BY 1""")
def q_line_category(t):
    """The category of an invoice line: the first list of signals that its head names."""
    line = F.concat("p_name", lit(" ("), "p_type", lit("), x"))
    return t("part").groupBy(X.line_category(line, {"fastener": ("ring", "bolt"), "other a": ("a",)}, "rest").alias("category")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents), s AS (SELECT doc_id, line, i, length(line) AS size FROM l WHERE length(line) > 0),
m AS (SELECT doc_id, list_sort(list(size)) AS sizes, max(size) AS top FROM s GROUP BY 1), k AS (SELECT doc_id, top, sizes[(len(sizes) + 1) // 2] AS median FROM m)
SELECT k.doc_id, median::INT AS median, CASE WHEN top >= 11 AND 4 * top >= 5 * median THEN sha256((SELECT arg_min(line, i) FROM s WHERE s.doc_id = k.doc_id AND size = top)) END AS title FROM k""")
def q_page_title(t):
    """The most prominent line of a page, if it stands out from the median and is large enough. A line's length stands for its size."""
    lines = F.split(F.coalesce("text", lit("")), "\n")
    rows = t("documents").select("doc_id", F.filter(lines, lambda x: x != "").alias("lines")).where(F.size("lines") > 0)
    title, median = X.prominent_line("lines", F.length, least=11)
    return rows.select("doc_id", median.alias("median"), F.sha2(title, 256).alias("title"))


_PARTS = """p AS (SELECT conv_id, turn, text, role = 'user' AND turn % 4 = 0 AS cut FROM conversations), n AS (SELECT conv_id, count(*) FILTER (cut) AS cuts FROM p GROUP BY 1),
c AS (SELECT conv_id, turn AS first, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, 1000000) AS last, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM p WHERE cut AND conv_id IN (SELECT conv_id FROM n WHERE cuts >= 2))"""


@query(f"""WITH {_PARTS} SELECT c.conv_id, i, first, count(*) AS pages, max(p.turn) AS last_page, sha256(sha256(c.conv_id::VARCHAR) || ':p' || i || '-' || first) AS part_id FROM c JOIN p ON p.conv_id = c.conv_id AND p.turn BETWEEN first AND last GROUP BY ALL""")
def q_split_parts(t):
    """Combined documents split where two or more titles stand; parts with ids of their own and their pages."""
    pages = t("conversations").withColumn("cut", (c("role") == "user") & (c("turn") % 4 == 0))
    return X.split_combined(pages, "conv_id", "turn", "cut")


@query(f"""WITH {_PARTS}, r AS (SELECT conv_id::VARCHAR AS id FROM n WHERE cuts < 2 UNION ALL SELECT conv_id || ':p' || i FROM c) SELECT count(*) AS readable, count(*) FILTER (contains(id, ':p')) AS parts FROM r""")
def q_readable_documents(t):
    """What is read: parts instead of the combined documents that they were cut from."""
    pages = t("conversations").withColumn("cut", (c("role") == "user") & (c("turn") % 4 == 0))
    return X.readable(pages, "conv_id", "turn", "cut").agg(F.count("*").alias("readable"), F.count_if(c("part") > 0).alias("parts"))


@query("""WITH w AS (SELECT user_id, event_type || '/' || (value > 50)::VARCHAR AS w, min(event_id) AS seq FROM events GROUP BY ALL) SELECT user_id, string_agg(w, ';' ORDER BY seq) AS warnings FROM w GROUP BY 1""")
def q_warnings_union(t):
    """A case's distinct warnings in the order of their first sight."""
    rows = t("events").select("user_id", "event_id", F.concat("event_type", lit("/"), (c("value") > 50).cast("string")).alias("w"))
    return E.collection(rows, ["user_id"], "w", "event_id").select("user_id", F.array_join("items", ";").alias("warnings"))


# ---- extraction

_CELLS = """l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE contains(text, ' | ')), r AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM l),
p AS (SELECT doc_id, i::INT AS row, trim(regexp_replace(string_split(line, ' | ')[1], '[\t ]+', ' ', 'g')) AS label, trim(regexp_replace(string_split(line, ' | ')[2], '[\t ]+', ' ', 'g')) AS value FROM r WHERE contains(line, ' | '))"""


@query(f"""WITH {_CELLS} SELECT doc_id, row, sha256(label) AS label, sha256(value) AS value FROM p""")
def q_table_pairs(t):
    """Labels and values: the first two cells of each row of a table."""
    return X.table_pairs(t("documents"), "doc_id", "text").select("doc_id", "row", F.sha2("label", 256).alias("label"), F.sha2("value", 256).alias("value"))


@query(f"""WITH {_CELLS}, k AS (SELECT *, last_value(CASE WHEN label[1:1] BETWEEN 'A' AND 'E' THEN value END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY row ROWS UNBOUNDED PRECEDING) AS key FROM p) SELECT doc_id, row, sha256(key) AS key FROM k""")
def q_inherited_keys(t):
    """Each row of a table with the key that stands last above it."""
    rows = X.table_pairs(t("documents"), "doc_id", "text")
    is_key = F.substring("label", 1, 1).between("A", "E")
    return X.inherit_key(rows, "doc_id", "row", is_key, c("value"), "key").select("doc_id", "row", F.sha2("key", 256).alias("key"))


@query(f"""WITH {_CELLS}, f AS (SELECT DISTINCT doc_id FROM p WHERE contains(lower(label), 'e')), x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f)),
y AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM x), z AS (SELECT doc_id, i, ls[i] AS line, ls[i + 1] AS after FROM y WHERE contains(lower(ls[i]), 'que') AND contains(lower(ls[i]), 'la'))
SELECT doc_id, min(i)::INT AS line, arg_min(sha256(CASE WHEN contains(line, ':') AND trim(regexp_extract(line, ':(.*)$', 1)) <> '' THEN trim(regexp_extract(line, ':(.*)$', 1)) ELSE coalesce(trim(after), '') END), i) AS value FROM z GROUP BY 1""")
def q_text_fallback(t):
    """Where no table names a field, the first line of the text with all words of its label: the rest of the line, else the next one."""
    docs = t("documents").select("doc_id", F.coalesce("text", lit("")).alias("text"))
    found = X.table_pairs(t("documents"), "doc_id", "text").where(F.lower("label").contains("e")).select("doc_id")
    rows = X.label_in_text(docs.join(found, "doc_id", "left_anti"), "doc_id", "text", ["que", "la"])
    return rows.select("doc_id", "line", F.sha2("value", 256).alias("value"))


@query(r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+ \d+')) AS m FROM documents) SELECT m, count(*) AS n, count(DISTINCT doc_id) AS docs FROM m GROUP BY 1""")
def q_mentions(t):
    """Everything that a pattern finds in the texts."""
    found = X.mentions(t("documents"), "doc_id", c("text"), r"[A-Z][a-z]+ \d+")
    per = found.groupBy("m", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("m").agg(F.sum("n").alias("n"), F.count("doc_id").alias("docs"))


@query(f"""SELECT doc_id, len(list_filter(['le la', 'under the', 'que une'], lambda r: contains(x, r) OR len(list_filter(string_split(r, ' '), lambda w: length(w) >= 4 AND NOT contains(x, w))) = 0 AND len(list_filter(string_split(r, ' '), lambda w: length(w) >= 4)) > 0))::INT AS present,
contains(x, 'signed by') OR contains(x, 'die der') AS signed, len(list_filter(['.', ',', ':'], lambda f: contains(x, f))) = 3 AS complete FROM (SELECT doc_id, {_FOLD.format("coalesce(text, '')")} AS x FROM documents)""")
def q_fuzzy_presence(t):
    """Requirements that a text names, by the whole phrase or all its longer words; a signature's phrases; all fields that must be there."""
    x = T.fold(F.coalesce("text", lit("")))
    rows = t("documents").select("doc_id", x.alias("x"))
    present = X.requirements_named(c("x"), ["le la", "under the", "que une"])
    return rows.select("doc_id", F.size(present).alias("present"), X.says_any(c("x"), ["signed by", "die der"]).alias("signed"), X.says_all(c("x"), [".", ",", ":"]).alias("complete"))


@query("""WITH told AS (SELECT o_orderkey AS l_orderkey, (o_custkey % 5)::BIGINT AS n FROM orders WHERE o_custkey % 10 = 0), c AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM told) GROUP BY 1)
SELECT l_orderkey, n, true AS explicit FROM told UNION ALL SELECT l_orderkey, n, false FROM c""")
def q_unit_counts(t):
    """How many units a source names: what it says, else the distinct serial numbers found in it."""
    told = t("orders").where("o_custkey % 10 = 0").select(c("o_orderkey").alias("l_orderkey"), (c("o_custkey") % 5).alias("n"))
    return E.counts_where_not_told(t("lineitem"), told, ["l_orderkey"], "l_partkey")


@query("""WITH d AS (SELECT DISTINCT n_nationkey % 5 AS v, n_regionkey AS s FROM nation WHERE n_nationkey % 2 = 0) SELECT count(*) AS n, count(*) FILTER (c_nationkey % 7 NOT IN (SELECT v FROM d)) AS undeclared FROM customer
WHERE c_nationkey % 7 NOT IN (SELECT v FROM d) OR EXISTS (SELECT 1 FROM d WHERE v = c_nationkey % 7 AND s = c_custkey % 5)""")
def q_source_admits(t):
    """Facts whose source may speak of their variable; undeclared variables always may."""
    declared = t("nation").where("n_nationkey % 2 = 0").select((c("n_nationkey") % 5).alias("variable"), c("n_regionkey").alias("source"))
    facts = t("customer").select((c("c_nationkey") % 7).alias("variable"), (c("c_custkey") % 5).alias("source"))
    known = declared.select(c("variable").alias("k")).distinct()
    rows = E.admitted(facts, "variable", "source", declared).join(known, c("variable") == c("k"), "left")
    return rows.agg(F.count("*").alias("n"), F.count_if(c("k").isNull()).alias("undeclared"))


_SERIES = """s AS (SELECT user_id, ts, nullif(value, 50.0) AS v, event_type FROM events), k AS (SELECT user_id, count(*) AS n_rows, count(v) AS n_used, min(ts) FILTER (v IS NOT NULL) AS t0, max(ts) FILTER (v IS NOT NULL) AS t1, count(*) FILTER (v IS NOT NULL AND event_type <> 'error') AS running FROM s GROUP BY 1)"""


@query(f"""WITH {_SERIES} SELECT user_id, u.variable, u.value FROM k, unnest([{{'variable': 'discarded', 'value': (n_rows - n_used)::VARCHAR}}, {{'variable': 'days', 'value': ((epoch_us(t1) - epoch_us(t0)) // 86400000000)::VARCHAR}},
{{'variable': 'start', 'value': strftime(t0, '%Y-%m-%dT%H:%M:%SZ')}}, {{'variable': 'end', 'value': strftime(t1, '%Y-%m-%dT%H:%M:%SZ')}}, {{'variable': 'running', 'value': running::VARCHAR}}]) AS x(u)""")
def q_series_evidence(t):
    """What a time series says of a unit, a row a fact: discarded rows, days, start, end, running rows."""
    rows = t("events").withColumn("v", F.nullif(c("value"), lit(50.0)))
    return X.series_facts(rows, "user_id", c("ts"), c("v"), c("event_type") != "error")


# ---- values

@query(r"""WITH v AS (SELECT doc_id, rtrim(regexp_extract(text, '[-+]?\d[\d.,]*'), '.,') AS num, regexp_extract(text, '[-+]?\d[\d.,]*\s*([A-Za-z%/][A-Za-z%/°º]*)', 1) AS unit, regexp_extract(upper(text), '\b[A-Z]{2,4}(?:-[A-Z0-9]{2,6}){1,4}\b') AS serial,
lower(regexp_extract(text, '(?i)\b[0-9a-f]{64}\b')) AS hash, regexp_extract(text, '\b(\d{1,2})/(\d{1,2})/(\d{4})\b', ['d', 'm', 'y']) AS day, regexp_extract(text, '\b\d{4}-\d{2}-\d{2}\b') AS iso FROM documents)
SELECT doc_id, CASE WHEN length(num) - length(replace(num, ',', '')) <= 1 THEN nullif(replace(replace(num, '.', ''), ',', '.'), '') END AS number, nullif(unit, '') AS unit, sha256(nullif(serial, '')) AS serial, nullif(hash, '') AS hash,
CASE WHEN day.y <> '' THEN day.y || '-' || lpad(day.m, 2, '0') || '-' || lpad(day.d, 2, '0') ELSE nullif(iso, '') END AS day FROM v""")
def q_field_values(t):
    """What converters find in the texts: a number, its unit, a serial number, a fingerprint, a day."""
    x = c("text")
    return t("documents").select("doc_id", T.canonical_number(x).alias("number"), T.unit_of(x).alias("unit"), F.sha2(T.serial_of(x), 256).alias("serial"), T.hash_of(x).alias("hash"), T.iso_date(x).alias("day"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, strftime(l_shipdate, '%Y-%m-%d') AS iso, CASE WHEN l_partkey % 3 = 0 THEN 'ring' WHEN l_partkey % 3 = 1 THEN 'large ring' END AS admitted FROM lineitem""")
def q_dates_and_enums(t):
    """Days in the order day, month, year as ISO dates, and the longest admitted value that a text holds."""
    said = F.when(c("l_partkey") % 3 == 0, "a ring of steel").when(c("l_partkey") % 3 == 1, "one Large  Ring, new").otherwise("none")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.iso_date(F.date_format("l_shipdate", "d/M/yyyy")).alias("iso"), T.admitted_value(said, ["ring", "large ring", "bolt"]).alias("admitted"))


@query("""WITH s AS (SELECT event_id, ts, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%d/%m/%Y %H:%M') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 3 THEN strftime(ts, '%d/%m/%Y %H:%M:%S') ELSE 'not a time' END AS s FROM events)
SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL WHEN 1 THEN strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS instant FROM s""")
def q_tolerant_instants(t):
    """Instants in several notations, tried in order, and written one way."""
    k, day, clock = c("event_id") % 5, "yyyy-MM-dd", "HH:mm:ss"
    f = lambda p: F.date_format("ts", p)
    said = F.when(k == 0, f(f"{day} {clock}")).when(k == 1, f("dd/MM/yyyy HH:mm")).when(k == 2, F.concat(f(day), lit("T"), f(clock))).when(k == 3, f(f"dd/MM/yyyy {clock}")).otherwise("not a time")
    return t("events").select("event_id", T.instant_text(T.tolerant_instant(said)).alias("instant"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN round(o_totalprice, 2) WHEN 1 THEN round(o_totalprice, 2) WHEN 2 THEN (trunc(o_totalprice))::DOUBLE ELSE (o_custkey % 1000) + 0.5 END AS number FROM orders""")
def q_tolerant_decimals(t):
    """Numbers with a decimal point or a comma, with thousands set apart by either or not at all."""
    k, price = c("o_orderkey") % 4, c("o_totalprice").cast("decimal(18,2)")
    english = F.format_number(price, 2)
    said = F.when(k == 0, english).when(k == 1, F.translate(english, ",.", ".,")).when(k == 2, F.floor("o_totalprice").cast("string")).otherwise(F.concat(c("o_custkey") % 1000, lit(",5")))
    return t("orders").select("o_orderkey", T.tolerant_decimal(said).cast("double").alias("number"))


@query(f"""WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(regexp_replace({_FOLD.format("coalesce(text, '')")}, '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ('de', 'la', 'el', 'le', 'the', 'of', 'und'))) AS ws FROM documents) SELECT doc_id, len(ws)::INT AS n, list_aggregate(ws, 'max') AS last FROM w""")
def q_keywords(t):
    """The significant words of a label or text: none in brackets, no stop words."""
    words = T.keywords(F.coalesce("text", lit("")), ["de", "la", "el", "le", "the", "of", "und"])
    return t("documents").select("doc_id", F.size(words).alias("n"), F.array_max(words).alias("last"))


@query(r"""SELECT o_orderkey, regexp_matches(s, '(^|[^0-9a-z-])r-' || (o_orderkey % 10) || '($|[^0-9a-z-])') AS cited, contains(s, 'r-' || (o_orderkey % 10)) AS contained FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'see r-' || (o_orderkey % 10) || ', please' WHEN 1 THEN 'see r-' || (o_orderkey % 10) || '2' WHEN 2 THEN 'pr-' || (o_orderkey % 10) ELSE 'r-' || (o_orderkey % 10) END AS s FROM orders)""")
def q_cited_ids(t):
    """Identifiers that a text cites as such, not as a part of another."""
    k, code = c("o_orderkey") % 4, F.concat(lit("r-"), c("o_orderkey") % 10)
    text = F.when(k == 0, F.concat(lit("see "), code, lit(", please"))).when(k == 1, F.concat(lit("see "), code, lit("2"))).when(k == 2, F.concat(lit("p"), code)).otherwise(code)
    return t("orders").select("o_orderkey", T.cites(text, code).alias("cited"), text.contains(code).alias("contained"))


@query("""SELECT event_id, sha256('{"at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","kind":"' || event_type || '","value":"' || CASE WHEN value = trunc(value) THEN value::BIGINT::VARCHAR ELSE rtrim(printf('%.2f', value), '0') END || '"}') AS block FROM events""")
def q_canonical_json(t):
    """Fingerprints of canonical JSON: keys in order, no blanks, numbers and instants as text."""
    value = T.plain_decimal(c("value").cast("decimal(12,2)"))
    return t("events").select("event_id", F.sha2(T.canonical_json({"value": value, "kind": c("event_type"), "at": T.instant_text(c("ts"))}), 256).alias("block"))


@query("""SELECT event_id, event_type || '|' || printf('%.2f', value) || '|' || strftime(ts, '%Y-%m-%d') AS back FROM events""")
def q_tagged_round_trip(t):
    """Decimals and dates in JSON under tags, and read again as what they were."""
    said = F.to_json(F.struct(c("event_type").alias("kind"), T.tagged(c("value").cast("decimal(12,2)"), "decimal").alias("value"), T.tagged(F.to_date("ts"), "date").alias("day")))
    rows = t("events").select("event_id", F.from_json(said, "kind string, value struct<`$decimal`:string>, day struct<`$date`:string>").alias("j"))
    value, day = c("j.value.$decimal").cast("decimal(12,2)"), c("j.day.$date").cast("date")
    return rows.select("event_id", F.concat_ws("|", "j.kind", value.cast("string"), day.cast("string")).alias("back"))


@query("""WITH h AS (SELECT event_id, sha1(chr(107) || 'proofloom|' || event_id || '|' || event_type) AS h FROM events) SELECT event_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][1 + (instr('0123456789abcdef', h[17:17]) - 1) % 4] || h[18:20] || '-' || h[21:32] AS id FROM h""")
def q_deterministic_ids(t):
    """Name-based ids: the same envelope, the same id."""
    return t("events").select("event_id", T.name_id("kproofloom", F.concat_ws("|", lit(""), c("event_id"), c("event_type"))).alias("id"))


@query("""WITH v AS (SELECT p_brand, (p_size % 3) || '.' || (p_size % 12) || '.' || (p_partkey % 11) AS version, p_size % 3 * 10000 + p_size % 12 * 100 + p_partkey % 11 AS k FROM part) SELECT p_brand, arg_max(version, k) AS highest, arg_min(version, k) AS lowest FROM v GROUP BY 1""")
def q_version_order(t):
    """The highest and lowest version, by numbers and not by text."""
    version = F.concat_ws(".", c("p_size") % 3, c("p_size") % 12, c("p_partkey") % 11)
    return t("part").groupBy("p_brand").agg(F.max_by(version, T.version_key(version)).alias("highest"), F.min_by(version, T.version_key(version)).alias("lowest"))


@query("""WITH s AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 > 0 THEN DATE '1995-01-01' + n_nationkey * 30 END AS f, CASE WHEN n_nationkey % 4 > 0 THEN DATE '1997-06-30' + n_nationkey * 10 END AS u FROM nation)
SELECT id, count(*) AS n FROM s JOIN (SELECT o_orderkey, o_orderdate::DATE AS d, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey) ON c_nationkey = id WHERE (f IS NULL OR d >= f) AND (u IS NULL OR d <= u) GROUP BY 1""")
def q_validity(t):
    """What is in force on a day: closed intervals, open ends."""
    n = c("n_nationkey")
    specs = t("nation").select(n.alias("id"), F.when(n % 3 > 0, F.date_add(lit("1995-01-01").cast("date"), n * 30)).alias("f"), F.when(n % 4 > 0, F.date_add(lit("1997-06-30").cast("date"), n * 10)).alias("u"))
    rows = t("orders").join(t("customer"), c("o_custkey") == c("c_custkey")).join(F.broadcast(specs), c("c_nationkey") == c("id"))
    return rows.where(T.in_force(F.to_date("o_orderdate"), c("f"), c("u"))).groupBy("id").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, replace(replace(replace(format('{:,.2f}', o_totalprice), ',', '_'), '.', ','), '_', '.') AS spanish, replace(replace(o_orderpriority || '|' || o_orderstatus, '|', '\\|'), chr(10), ' ') AS cell FROM orders""")
def q_report_formats(t):
    """Numbers with thousands set apart as in Spanish, and cells of a markdown table."""
    return t("orders").select("o_orderkey", T.spanish_text(c("o_totalprice").cast("decimal(18,2)"), 2).alias("spanish"), T.markdown_cell(F.concat_ws("|", "o_orderpriority", "o_orderstatus")).alias("cell"))


@query("""SELECT s_suppkey, regexp_replace(upper(s_name), '[^A-Z0-9]', '', 'g') AS plain, CASE WHEN s_suppkey % 2 = 0 THEN 'truncate' ELSE 'round' END AS criterion FROM supplier""")
def q_normal_forms(t):
    """Values to compare by (letters and digits only, upper case), and the name of a rounding criterion."""
    said = F.when(c("s_suppkey") % 2 == 0, "  Truncate. ").otherwise("ROUND")
    return t("supplier").select("s_suppkey", T.comparable(c("s_name")).alias("plain"), T.criterion(said).alias("criterion"))
