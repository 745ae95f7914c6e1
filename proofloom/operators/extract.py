"""Documents to facts: kinds, parts, labelled values, mentions. Column functions where a row is enough; windows stay within a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofloom.functions import text as T


def title_kind(title: Column, lexicon: dict[str, tuple[tuple[str, ...], ...]], excluded: dict[str, tuple[str, ...]]) -> Column:
    """The kind whose group of terms a folded title names whole, without a term that excludes it; the largest group, then the lexicon's order."""
    groups = [(len(g), i, kind, g) for i, (kind, g) in enumerate((k, g) for k, gs in lexicon.items() for g in gs)]
    out = F.lit(None).cast("string")
    for _, _, kind, group in sorted(groups, key=lambda x: (x[0], -x[1])):
        fits = says_all(title, list(group))
        for x in excluded.get(kind, ()):
            fits = fits & ~title.contains(x)
        out = F.when(fits, kind).otherwise(out)
    return out


def scored_kind(title: Column, body: Column, kinds: dict[str, tuple[str, tuple[str, ...]]], least: int) -> tuple[Column, Column]:
    """Kind and score in tenths: six for the title's term, four for the share of typical fields; under least none, ties by name."""
    scores = {}
    for kind, (term, fields) in sorted(kinds.items()):
        found = sum((body.contains(f).cast("int") for f in fields), F.lit(0))
        scores[kind] = title.contains(term).cast("int") * 6 + F.floor(found * 4 / len(fields)).cast("int")
    best = F.greatest(*scores.values())
    out = F.when(best < least, "unclassified")
    for kind, score in scores.items():
        out = out.when(score == best, kind)
    return out, best


def line_category(line: Column, signals: dict[str, tuple[str, ...]], rest: str) -> Column:
    """The first category of which a line's head (up to a bracket, comma or semicolon) has a signal."""
    head = F.lower(F.get(F.split(line, "[(,;]"), F.lit(0)))
    out = None
    for name, words in signals.items():
        out = (F if out is None else out).when(says_any(head, list(words)), name)
    return out.otherwise(rest)


def prominent_line(lines: str, size: Callable[[Column], Column], least: int) -> tuple[Column, Column]:
    """The first largest line if it is at least ``least`` and a quarter above the (lower) median size; and that median."""
    sizes = F.sort_array(F.transform(lines, size))
    median = F.get(sizes, F.floor((F.size(sizes) - 1) / 2).cast("int"))
    top = F.array_max(sizes)
    first = F.get(F.filter(lines, lambda x: size(x) == top), F.lit(0))
    return F.when((top >= least) & (4 * top >= 5 * median), first), median


def _marked(pages: DataFrame, doc: str, page: str, cut: str) -> DataFrame:
    """pages with part (0: before any cut) and cuts, the number of cuts of the document."""
    order = Window.partitionBy(doc).orderBy(page)
    rows = pages.withColumn("part", F.count_if(F.col(cut)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("cuts", F.count_if(F.col(cut)).over(Window.partitionBy(doc)))


def split_combined(pages: DataFrame, doc: str, page: str, cut: str) -> DataFrame:
    """(doc, i, first, pages, last_page, part_id): parts of documents with two cuts or more, each from its cut to before the next."""
    rows = _marked(pages, doc, page, cut).where("cuts >= 2 and part > 0")
    parts = rows.groupBy(doc, F.col("part").alias("i")).agg(F.min(page).alias("first"), F.count("*").alias("pages"), F.max(page).alias("last_page"))
    own = F.sha2(F.concat(F.sha2(F.col(doc).cast("string"), 256), F.lit(":p"), "i", F.lit("-"), "first"), 256)
    return parts.withColumn("part_id", own)


def readable(pages: DataFrame, doc: str, page: str, cut: str) -> DataFrame:
    """(doc, part): documents that aren't combined (part 0), and the parts of those that are."""
    rows = _marked(pages, doc, page, cut)
    return rows.where("cuts < 2 or part > 0").select(doc, F.when(F.col("cuts") < 2, 0).otherwise(F.col("part")).alias("part")).distinct()


def table_pairs(docs: DataFrame, doc: str, text: str, mark: str = " | ") -> DataFrame:
    """(doc, row, label, value): the first two cells of each line that is a row of a table, blanks collapsed."""
    rows = docs.where(F.col(text).contains(mark)).select(doc, F.posexplode(F.split(text, "\n")).alias("row", "line")).where(F.col("line").contains(mark))
    cells = F.split("line", mark.replace("|", r"\|"))
    tidy = lambda k: F.trim(F.regexp_replace(F.get(cells, F.lit(k)), "[\t ]+", " "))
    return rows.select(doc, "row", tidy(0).alias("label"), tidy(1).alias("value"))


def inherit_key(rows: DataFrame, doc: str, order: str, is_key: Column, value: Column, out: str) -> DataFrame:
    """rows with the last key at or above each of them in its document."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(F.when(is_key, value), ignorenulls=True).over(w))


def label_in_text(docs: DataFrame, doc: str, text: str, words: list[str]) -> DataFrame:
    """(doc, line, value): the first line with all words of a label; its value is what follows a colon, else the next line."""
    lines = F.split(text, "\n")
    at = F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(says_all(F.lower(x), words), i)), lambda i: i.isNotNull()))
    rows = docs.select(doc, lines.alias("lines"), at.alias("at")).where("at is not null")
    after = F.trim(F.regexp_extract(F.get("lines", "at"), ":(.*)$", 1))
    return rows.select(doc, (F.col("at") + 1).alias("line"), F.when(after != "", after).otherwise(F.coalesce(F.trim(F.get("lines", F.col("at") + 1)), F.lit(""))).alias("value"))


def mentions(docs: DataFrame, doc: str, text: Column, pattern: str) -> DataFrame:
    """(doc, m): everything that the pattern finds."""
    return docs.select(doc, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("m"))


def says_any(x: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | x.contains(p)
    return out


def says_all(x: Column, phrases: list[str]) -> Column:
    out = F.lit(True)
    for p in phrases:
        out = out & x.contains(p)
    return out


def requirements_named(x: Column, requirements: list[str]) -> Column:
    """The requirements that a folded text names: the whole phrase, or all its words of four letters or more."""
    named = []
    for r in requirements:
        long = [w for w in r.split() if len(w) >= 4]
        named.append(F.when(x.contains(r) | (says_all(x, long) if long else F.lit(False)), r))
    return F.array_compact(F.array(*named))


def series_facts(rows: DataFrame, key: str, ts: Column, value: Column, running: Column) -> DataFrame:
    """(key, variable, value as text): what is said by a series whose incomplete rows are counted and dropped."""
    used = value.isNotNull()
    s = rows.groupBy(key).agg(
        (F.count("*") - F.count(value)).alias("discarded"), F.min(F.when(used, ts)).alias("t0"), F.max(F.when(used, ts)).alias("t1"), F.count_if(used & running).alias("running")
    )
    seconds = F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))
    facts = {"discarded": F.col("discarded"), "days": F.floor(seconds / 86_400_000_000), "start": T.instant_text(F.col("t0")), "end": T.instant_text(F.col("t1")), "running": F.col("running")}
    each = F.array(*[F.struct(F.lit(k).alias("variable"), v.cast("string").alias("value")) for k, v in facts.items()])
    return s.select(key, F.explode(each).alias("f")).select(key, "f.*")
