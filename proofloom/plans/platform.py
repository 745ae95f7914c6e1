"""What a platform's literals mean: the table of states, and queries over it and over other declared data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.functions import text as T
from proofloom.operators import evidence as E
from proofloom.operators import phrases as P
from proofloom.plans import reading
from proofloom.plans.registry import query

c, lit = F.col, F.lit

# Literal; level; phase; official; state of the case (-: none); result; reach; marks.
STATES = """
BORRADOR; case; 1A; yes; ENTREGADA; -; case; modifiable initial
COMPLETA; case; 1A; yes; ENTREGADA; -; case; modifiable checked
ENVIADA_A_VERIFICACION; case; 1A; yes; EN_PLATAFORMA; -; case; signed
PDTE_RECTIFICACION_VER; case; 1B; yes; PENDIENTE_SUBSANACION; verificador; group; -
VERIFICACION_EN_PROCESO; case; 1B; yes; -; -; case; -
VERIFICADA_FAVORABLE; case; 1B; yes; -; -; case; candidate
VERIFICADA_DESFAVORABLE; case; 1B; yes; CERRADA; verificada_desfavorable; case; -
NO_PUEDE_EMITIR_DICTAMEN; case; 1B; yes; CERRADA; sin_dictamen; case; -
BORRADOR_SOLICITUD; bundle; 2; no; -; -; bundle; -
PRESENTADO; bundle; 2; no; -; -; bundle; -
EN_VALIDACION_TECNICA; bundle; 3A; no; -; -; bundle; -
REQUERIDO_GA; bundle; 3A; no; PENDIENTE_SUBSANACION; GA; bundle; -
VALIDADO_GA; bundle; 3A; no; -; -; bundle; -
EN_REVISION_FORMAL; bundle; 3B; no; -; -; bundle; -
REQUERIDO_CN; bundle; 3B; no; PENDIENTE_SUBSANACION; CN; bundle; -
RESUELTO_FAVORABLE; bundle; 4; no; -; -; bundle; -
RESUELTO_DESFAVORABLE; bundle; 4; no; -; -; bundle; -
INSCRITO; bundle; 4; no; CERRADA; inscrita; bundle; -
DESISTIDO; bundle; 3A; no; CERRADA; desistida; bundle; withdrawn
"""

_COLUMNS = "literal string, level string, phase string, official boolean, state string, result string, reach string, marks array<string>"


def state_rows() -> list[tuple]:
    rows = [[x.strip() for x in line.split(";")] for line in STATES.strip().splitlines()]
    none = lambda x: None if x == "-" else x
    return [(a, b, p, o == "yes", none(s), none(r), reach, [] if m == "-" else m.split()) for a, b, p, o, s, r, reach, m in rows]


def states(spark: SparkSession) -> DataFrame:
    """The table of platform states: 19 rows."""
    return spark.createDataFrame(state_rows(), _COLUMNS)


_LITERALS = [r[0] for r in state_rows()]
_SQL_STATES = ", ".join(f"('{r[0]}', {'NULL' if r[4] is None else repr(r[4])}, {'NULL' if r[5] is None else repr(r[5])}, {str(r[6] != 'case').lower()})" for r in state_rows())


@query(f"""WITH p(literal, state, result, spreads) AS (VALUES {_SQL_STATES}), e AS (SELECT event_id, [{", ".join(f"'{x}'" for x in _LITERALS)}, 'NUEVO_ESTADO'][event_id % 20 + 1] AS literal FROM events)
SELECT e.literal, p.state, p.result, coalesce(p.state = 'PENDIENTE_SUBSANACION' AND p.spreads, false) AS spreads, p.literal IS NULL AS escalate, count(*) AS n FROM e LEFT JOIN p ON p.literal = e.literal GROUP BY ALL""")
def q_platform_table(t):
    """What each literal that a platform reports does to a case: its state and result, whether it reaches all of a bundle, and whether nobody knows it."""
    literal = F.element_at(F.array(*map(lit, [*_LITERALS, "NUEVO_ESTADO"])), (c("event_id") % 20 + 1).cast("int"))
    events = t("events").select(literal.alias("literal"))
    table = states(events.sparkSession).select(c("literal").alias("l"), "state", "result", "reach")
    rows = events.join(F.broadcast(table), c("literal") == c("l"), "left")  # 19 rows
    spreads = F.coalesce((c("state") == "PENDIENTE_SUBSANACION") & (c("reach") != "case"), lit(False))
    return rows.groupBy("literal", "state", "result", spreads.alias("spreads"), c("l").isNull().alias("escalate")).agg(F.count("*").alias("n"))


@query(f"""WITH {reading._LEXICON}, k AS (SELECT kind, count(*) AS n FROM x GROUP BY 1), s AS (SELECT doc_id, kind, count(*) AS said FROM h JOIN x USING (phrase) GROUP BY ALL), ti AS (SELECT doc_id, doc_id % 5 AS kind FROM documents WHERE doc_id % 3 = 0),
a AS (SELECT doc_id, kind, max(said) AS said FROM (SELECT * FROM s UNION ALL SELECT doc_id, kind, 0 FROM ti) GROUP BY ALL), z AS (SELECT a.doc_id, a.kind, CASE WHEN ti.kind IS NOT NULL THEN 60 + 40 * said / n WHEN a.doc_id % 4 = 1 AND a.kind = 2 THEN NULL ELSE 50 * said / n END / 100 AS score
FROM a JOIN k ON k.kind = a.kind LEFT JOIN ti ON ti.doc_id = a.doc_id AND ti.kind = a.kind) SELECT doc_id, kind, round(score, 9) AS score FROM z WHERE score > 0""")
def q_weighed_kinds(t):
    """The score of every kind for every document: six tenths for its title and four for its share of phrases, half of the share without a title, nothing where something excludes it."""
    lexicon = reading._lexicon(t)
    scored = P.scores(P.found(t("documents"), "doc_id", "text", lexicon, "phrase"), "doc_id", lexicon, "phrase", "kind")
    whole = lexicon.groupBy("kind").agg(F.count("*").alias("n"))
    titles = t("documents").where("doc_id % 3 = 0").select("doc_id", (c("doc_id") % 5).alias("kind"))
    excluded = t("documents").where("doc_id % 4 = 1").select("doc_id", lit(2).cast("long").alias("kind"))
    return P.weighed(scored, "doc_id", "kind", whole, titles, excluded).select("doc_id", "kind", F.round("score", 9).alias("score"))


@query("""SELECT doc_id, sha256(trim(regexp_replace(lower(x), '[\t\n\x0B\f\r ]+', ' ', 'g'))) AS header, sha256(replace(replace(y, 'º', 'o'), '°', 'o')) AS label FROM (SELECT doc_id, 'Nº ' || coalesce(text, '') || ' 5°' AS x, {} AS y FROM documents)""".format(reading._FOLD.format("'Nº ' || coalesce(text, '') || ' 5°'")))
def q_folds(t):
    """Texts as headers of tables are compared (accents kept), and as labels are (ordinal signs as letters)."""
    x = F.concat(lit("Nº "), F.coalesce("text", lit("")), lit(" 5°"))
    return t("documents").select("doc_id", F.sha2(T.header_fold(x), 256).alias("header"), F.sha2(T.label_fold(x), 256).alias("label"))


@query("""WITH f AS (SELECT ['unit.power', 'case.owner', 'log.hours', 'unit', 'other.x'][l_linenumber % 5 + 1] AS variable, CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey END AS key FROM lineitem)
SELECT variable, CASE WHEN variable = 'unit.power' THEN 'case' WHEN variable = 'log.hours' THEN 'unit' WHEN key IS NOT NULL OR variable = 'unit' THEN 'unit' ELSE 'case' END AS level, count(*) AS n FROM f GROUP BY ALL""")
def q_declared_levels(t):
    """Whether a fact is a unit's: as its variable is declared, else by a key, else by the root of its name."""
    names = F.element_at(F.array(*map(lit, ("unit.power", "case.owner", "log.hours", "unit", "other.x"))), (c("l_linenumber") % 5 + 1).cast("int"))
    rows = t("lineitem").select(names.alias("variable"), F.when(c("l_suppkey") % 3 == 0, c("l_suppkey")).alias("key"))
    return E.levels(rows, "variable", c("key"), {"unit.power": "case", "log.hours": "unit"}, ["unit"]).groupBy("variable", "level").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT doc_id, 'File ' || doc_id AS name, sha256(coalesce(text, '')) AS sha FROM documents), s AS (SELECT DISTINCT upper(sha) AS sha, CASE WHEN doc_id % 4 = 0 THEN 'FILE  ' || doc_id WHEN doc_id % 4 = 1 THEN 'Sheet ' || doc_id END AS name FROM d WHERE doc_id % 3 = 0)
SELECT doc_id, s.name AS declared_name FROM d JOIN s ON lower(s.sha) = d.sha WHERE s.name IS NOT NULL AND lower(regexp_replace(s.name, ' +', ' ', 'g')) <> lower(d.name)""")
def q_renamed_links(t):
    """Documents that are known by a declared fingerprint and not by their name."""
    d = t("documents").select("doc_id", F.concat(lit("File "), "doc_id").alias("name"), F.sha2(F.coalesce("text", lit("")), 256).alias("sha"))
    k = c("doc_id") % 4
    declared = d.where("doc_id % 3 = 0").select(F.upper("sha").alias("sha"), F.when(k == 0, F.concat(lit("FILE  "), "doc_id")).when(k == 1, F.concat(lit("Sheet "), "doc_id")).alias("name"))
    return E.renamed(d, "name", "sha", declared).select("doc_id", "declared_name")
