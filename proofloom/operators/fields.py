"""Fields of documents by a lexicon table: labelled cells first, then labelled lines of text; the first candidate that converts counts. One plan.

The lexicon has a row for each label: (kind, label, variable, type, evidence, place, in_text, is_key). Only what no table gave counts in the text.
``facts`` reads each document in its own row, next to the labels of its kind, and shuffles nothing. Where a kind has too many labels for that, lines are
rows (``extracted``): labels of table rows meet the lexicon by equality, lines of text by the longest word of a label.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofloom.functions import text as T

CELLS = " | "
#: Anchors of labels that go into the plan, so that lines are told by no other words; with more of them, all words of a line are.
MOST_ANCHORS = 500
#: Labels of a lexicon that is sent to all tasks.
MOST_LABELS = 10_000
#: Labels of a kind that are compared with the lines of a document one by one.
MOST_OF_KIND = 200
STOP = ["de", "del", "la", "el", "los", "las", "y", "en", "con", "the", "of"]
_MARKS = r"[ :\-–—.]+"


def converted(raw: Column, kind: Column) -> Column:
    """raw as its type says (number, integer, date, text, serial, hash, code), as text; null if it doesn't convert."""
    number = T.canonical_number(raw)
    whole = T.once(number, lambda n: F.when(n.rlike(r"^[-+]?\d+$"), n))
    text = T.unless_empty(F.trim(T.blanks_collapsed(raw)))
    code = T.unless_empty(F.regexp_extract(F.upper(raw), r"\b([A-Z]\d{1,9}[A-Z]?)\b", 1))
    out = F.when(kind == "number", number).when(kind == "integer", whole).when(kind == "date", T.iso_date(raw))
    return out.when(kind == "serial", T.serial_of(raw)).when(kind == "hash", T.hash_of(raw)).when(kind == "code", code).when(kind == "text", text)


def lines_of(docs: DataFrame, doc: str, text: str, *more: str) -> DataFrame:
    """(doc, more, row, line, after): the lines of each document, and the one after each."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    each = F.transform(lines, lambda x, i: F.struct(x.alias("line"), F.get(lines, i + 1).alias("after")))
    return docs.select(doc, *more, F.posexplode(each).alias("row", "l")).select(doc, *more, "row", "l.line", "l.after")


def with_islands(lines: DataFrame, doc: str, opens: Column, closes: Column) -> DataFrame:
    """lines with ``island``: the number of the last opening line above, on lines after it and before the next closing one; null elsewhere and on those lines themselves."""
    above = Window.partitionBy(doc).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)  # a document's lines
    mark = F.when(opens, F.lit(True)).when(closes, F.lit(False))
    rows = lines.withColumn("__n", F.count_if(opens).over(above)).withColumn("__in", F.last(mark, ignorenulls=True).over(above))
    inside = F.coalesce(F.col("__in"), F.lit(False)) & ~F.coalesce(opens, F.lit(False)) & ~F.coalesce(closes, F.lit(False))
    return rows.withColumn("island", F.when(inside, F.col("__n"))).drop("__n", "__in")


def lines_and_islands(docs: DataFrame, doc: str, text: str, opens: Callable[[Column], Column], closes: Callable[[Column], Column], *more: str) -> DataFrame:
    """``with_islands`` of ``lines_of``, for rules that read a line alone: islands are told in each document's own row, so that no line is shuffled or sorted.

    A document's lines are cut at those that open or close; the work is that of its lines, whatever the number of islands.
    """
    rows = docs.select(doc, *more, F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("__l"))
    mark = F.transform("__l", lambda x, i: F.struct(i.alias("at"), F.when(opens(x), 1).when(closes(x), 0).alias("open")))
    rows = rows.withColumn("__m", F.filter(mark, lambda m: m["open"].isNotNull()))
    upto = lambda i: F.coalesce(F.get("__m", i)["at"], F.size("__l"))
    cuts = F.transform("__m", lambda m, i: F.struct(m["at"].alias("at"), upto(i + 1).alias("end"), m["open"].alias("open")))
    rows = rows.withColumn("__c", cuts).withColumn("__head", upto(F.lit(0)))
    span = lambda at, end, island: F.struct(at.alias("at"), end.alias("end"), island.cast("long").alias("island"))
    inside = F.transform(F.filter("__c", lambda m: m["open"] == 1), lambda m, j: span(m["at"], m["end"], j + 1))
    outside = F.transform(F.filter("__c", lambda m: m["open"] == 0), lambda m: span(m["at"], m["end"], F.lit(None)))
    rows = rows.select(doc, *more, "__l", F.explode(F.concat(F.array(span(F.lit(0), F.col("__head"), F.lit(None))), outside, inside)).alias("__s"))
    at = F.col("__s.at")
    each = F.transform(F.slice("__l", at + 1, F.col("__s.end") - at), lambda x, i: F.struct(x.alias("line"), F.get("__l", at + i + 1).alias("after")))
    rows = rows.select(doc, *more, "__s", F.posexplode(each).alias("__i", "l"))
    return rows.select(doc, *more, (at + F.col("__i")).alias("row"), "l.line", "l.after", F.when(F.col("__i") > 0, F.col("__s.island")).alias("island"))


def cells(x: Column) -> Column:
    return F.transform(F.split(x, r" \| "), lambda v: F.trim(v))


def line_items(lines: DataFrame, doc: str, kinds: Column) -> DataFrame:
    """(doc, island, items): the rows of each table of lines as an array of (row, text, quantity, amount, kind); a row without a readable amount has none.

    kinds: the kind of a line from its first cell, as a column of ``text``.
    """
    rows = lines.where(F.col("island").isNotNull() & F.col("line").contains(CELLS)).withColumn("__c", cells(F.col("line")))
    rows = rows.withColumn("text", F.get("__c", F.lit(0)))
    number = lambda i: T.spanish_number(F.get("__c", F.lit(i)))
    item = F.struct("row", "text", number(1).alias("quantity"), number(2).alias("amount"), kinds.alias("kind"))
    return rows.groupBy(doc, "island").agg(F.array_sort(F.collect_list(item)).alias("items"))  # lines of one document


def from_tables(lines: DataFrame, doc: str, kind: str, lexicon: DataFrame) -> DataFrame:
    """(doc, variable, value, evidence, key, row): every labelled cell that converts, with the key that stands last at or above it in its document."""
    pairs = lines.where(F.col("line").contains(CELLS) & F.col("island").isNull()).withColumn("__c", cells(F.col("line")))
    pairs = pairs.select(doc, kind, "row", T.label_fold(F.get("__c", F.lit(0))).alias("label"), F.get("__c", F.lit(1)).alias("raw"))
    own = lexicon.select(F.col("kind").alias("__k"), F.col("label").alias("__l"), "variable", "type", "evidence", "is_key")
    hits = pairs.join(own, (F.col(kind) == F.col("__k")) & (F.col("label") == F.col("__l"))).withColumn("value", converted(F.col("raw"), F.col("type"))).where("value is not null")
    above = Window.partitionBy(doc).orderBy("row", "variable").rowsBetween(Window.unboundedPreceding, 0)
    key = F.last(F.when(F.col("is_key"), F.col("value")), ignorenulls=True).over(above)
    return hits.select(doc, "variable", "value", "evidence", key.alias("key"), "row")


def from_text(lines: DataFrame, doc: str, kind: str, lexicon: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(doc, variable, value, evidence, row): for each variable that isn't in found yet, its first label that a line has all words of, with what stands after
    them in the line or else in the next one, if that converts."""
    words = T.keywords(F.col("label"), STOP)
    own = lexicon.where("in_text").select(F.col("kind").alias("__k"), "variable", "type", "evidence", "place", words.alias("words"))
    longest = F.array_sort(F.transform("words", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))[0]["w"]
    own = own.where(F.size("words") > 0).withColumn("anchor", longest)
    anchors = sorted(r.anchor for r in own.select("anchor").distinct().limit(MOST_ANCHORS + 1).collect())
    plain = T.label_plain(F.col("line"))
    few = 0 < len(anchors) <= MOST_ANCHORS
    said = lines.where(plain.rlike("|".join(anchors)) if few else F.trim("line") != "")  # anchors are letters and digits
    said = said.withColumn("tokens", T.keywords(F.translate("line", "()º°", "  oo"), []))
    some = F.array_intersect("tokens", F.array(*map(F.lit, anchors))) if few else F.col("tokens")
    told = said.select(doc, kind, "row", "line", "after", "tokens", F.explode(some).alias("token"))
    hits = told.join(own, (F.col(kind) == F.col("__k")) & (F.col("token") == F.col("anchor"))).where(F.size(F.array_except("words", "tokens")) == 0)
    if found is not None:
        hits = hits.join(found.select(F.col(doc).alias("__d"), F.col("variable").alias("__v")).distinct(), (F.col(doc) == F.col("__d")) & (F.col("variable") == F.col("__v")), "left_anti")
    end = F.array_max(F.transform("words", lambda w: F.length(plain) - F.instr(F.reverse(plain), F.reverse(w)) + 1))
    rest = F.regexp_replace(F.expr("substring(line, __end + 1)"), f"^{_MARKS}|{_MARKS}$", "")
    hits = hits.withColumn("__end", end).withColumn("value", F.coalesce(converted(rest, F.col("type")), converted(F.col("after"), F.col("type"))))
    first = hits.groupBy(doc, "variable", "place").agg(F.min(F.struct("row", "value", "evidence")).alias("f")).where("f.value is not null")
    best = first.groupBy(doc, "variable").agg(F.min(F.struct("place", "f")).alias("b"))
    return best.select(doc, "variable", "b.f.value", "b.f.evidence", "b.f.row")


def extracted(lines: DataFrame, doc: str, kind: str, lexicon: DataFrame) -> DataFrame:
    """(doc, variable, value, evidence, method, key, row): facts of all documents, from tables before text. lines as ``with_islands`` gives them.

    What a table gave is told from what the text did in one window over both, so that tables are read once. A lexicon of a checked size is broadcast.
    """
    lexicon = F.broadcast(lexicon) if lexicon.limit(MOST_LABELS + 1).count() <= MOST_LABELS else lexicon
    tables = from_tables(lines, doc, kind, lexicon)
    text = from_text(lines, doc, kind, lexicon)
    both = tables.select(doc, "variable", "value", "evidence", F.lit("table").alias("method"), "key", "row").unionByName(
        text.select(doc, "variable", "value", "evidence", F.lit("text").alias("method"), F.lit(None).cast("string").alias("key"), "row")
    )
    first = F.min("method").over(Window.partitionBy(doc, "variable"))  # a document's facts of one variable
    return both.withColumn("__first", first).where(F.col("method") == F.col("__first")).drop("__first")


def by_kind(lexicon: DataFrame) -> DataFrame:
    """(__k, __labels, __own): the labels of each kind in one array, by variable and place, with their words, long ones first; and those of each label as a map."""
    words = F.transform(F.array_sort(F.transform(T.keywords(F.col("label"), STOP), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)).alias(name)
    label = F.struct("variable", "place", "label", "type", "evidence", flag("is_key"), flag("in_text"), words.alias("words"))
    of_label = lexicon.groupBy(F.col("kind").alias("__k"), "label").agg(F.sort_array(F.collect_list(label)).alias("x"))
    known = F.when(F.col("label").isNotNull(), F.struct("label", "x"))
    return of_label.groupBy("__k").agg(F.sort_array(F.flatten(F.collect_list("x"))).alias("__labels"), F.map_from_entries(F.collect_list(known)).alias("__own"))


def _spans(lines: Column, marks: Column) -> Column:
    """(at, n): the stretches of lines that are in no island; marks: the numbers of lines that open, and -1 less those of lines that close, in order."""
    row = lambda m: F.when(m < 0, -1 - m).otherwise(m)
    upto = lambda i: F.coalesce(row(F.get(marks, i)), F.size(lines))
    head = F.struct(F.lit(0).alias("at"), upto(F.lit(0)).alias("n"))
    return F.concat(F.array(head), F.transform(marks, lambda m, j: F.struct(row(m).alias("at"), F.when(m < 0, upto(j + 1) - row(m)).otherwise(1).alias("n"))))


def _table_hits(lines: Column, spans: Column, own: Column) -> Column:
    """(row, variable, value, evidence, is_key) of the labelled cells that convert, by row and variable."""

    def read(line: Column, row: Column) -> Column:
        first = F.substring_index(line, CELLS, 1)
        raw = F.trim(F.substring_index(F.substr(line, F.char_length(first) + len(CELLS) + 1), CELLS, 1))
        said = F.try_element_at(own, T.once(F.trim(first), T.label_fold))
        return F.transform(said, lambda x: F.struct(row.alias("row"), x["variable"].alias("variable"), converted(raw, x["type"]).alias("value"), x["evidence"].alias("evidence"), x["is_key"].alias("is_key")))

    def of(s: Column) -> Column:
        return F.flatten(F.array_compact(F.transform(F.slice(lines, s["at"] + 1, s["n"]), lambda x, j: F.when(x.contains(CELLS), read(x, s["at"] + j)))))

    return F.filter(F.flatten(F.transform(spans, of)), lambda h: h["value"].isNotNull())


def _fact(variable: Column, value: Column, evidence: Column, method: str, key: Column, row: Column) -> Column:
    return F.struct(variable.alias("variable"), value.alias("value"), evidence.alias("evidence"), F.lit(method).alias("method"), key.alias("key"), row.alias("row"))


def _keyed(hits: Column, keys: Column) -> Column:
    """Facts of the hits, each with the key that stands last at or above it; keys: (at, key), where in hits they stand."""
    upto = lambda i: F.coalesce(F.get(keys, i)["at"], F.size(hits))
    fact = lambda h, key: _fact(h["variable"], h["value"], h["evidence"], "table", key, h["row"])
    head = F.transform(F.slice(hits, F.lit(1), upto(F.lit(0))), lambda h: fact(h, F.lit(None).cast("string")))
    below = F.transform(keys, lambda k, j: F.transform(F.slice(hits, k["at"] + 1, upto(j + 1) - k["at"]), lambda h: fact(h, k["key"])))
    return F.concat(head, F.flatten(below))


def _text_hits(wanted: Column, lines: Column) -> Column:
    """(variable, place, f: (row, value, evidence)) of the first line that has all words of a wanted label, by variable and place."""

    def has(plain: Column, words: Column) -> Column:
        said = F.concat(F.lit(" "), F.regexp_replace(plain, "[^a-z0-9]+", " "), F.lit(" "))
        return plain.contains(F.get(words, F.lit(0))) & F.forall(words, lambda w: said.contains(F.concat(F.lit(" "), w, F.lit(" "))))

    def value(line: Column, after: Column, words: Column, type_: Column) -> Column:
        end = T.once(T.label_plain(line), lambda x: F.array_max(F.transform(words, lambda w: F.length(x) - F.instr(F.reverse(x), F.reverse(w)) + 1)))
        rest = F.regexp_replace(F.substr(line, end + 1), f"^{_MARKS}|{_MARKS}$", "")
        return F.coalesce(T.once(rest, lambda x: converted(x, type_)), converted(after, type_))

    def read(x: Column, row: Column) -> Column:
        said = value(F.get(lines, row), F.get(lines, row + 1), x["words"], x["type"])
        return F.struct(x["variable"].alias("variable"), x["place"].alias("place"), F.struct(row.alias("row"), said.alias("value"), x["evidence"].alias("evidence")).alias("f"))

    def first(plain: Column, x: Column) -> Column:
        row = F.array_position(F.transform(plain, lambda p: has(p, x["words"])), True).cast("int") - 1
        return T.once(row, lambda i: F.when(i >= 0, read(x, i)))

    return F.sort_array(F.array_compact(T.once(F.transform(lines, T.label_plain), lambda plain: F.transform(wanted, lambda x: first(plain, x)))))


def _new(hits: Column, *names: str) -> Column:
    """Of sorted hits the first of each group that has the same names."""

    def same(a: Column, b: Column) -> Column:
        alike = a[names[0]].eqNullSafe(b[names[0]])
        for n in names[1:]:
            alike = alike & a[n].eqNullSafe(b[n])
        return alike

    return F.filter(hits, lambda h, i: (i == 0) | ~same(F.get(hits, i - 1), h))


def _from_rows(docs: DataFrame, doc: str, lines: str, wanted: str) -> DataFrame:
    """docs with ``__x``, the facts of text."""
    none = F.lit(None).cast("string")
    rows = docs.withColumn("__x", F.when(F.size(wanted) > 0, _text_hits(F.col(wanted), F.col(lines)))).drop(lines, wanted)
    rows = rows.withColumn("__x", F.when(F.size("__x") > 0, F.filter(_new(F.col("__x"), "variable", "place"), lambda h: h["f"]["value"].isNotNull())))
    return rows.withColumn("__x", F.transform(_new(F.col("__x"), "variable"), lambda h: _fact(h["variable"], h["f"]["value"], h["f"]["evidence"], "text", none, h["f"]["row"])))


def facts(docs: DataFrame, doc: str, kind: str, text: str, opens: Callable[[Column], Column], closes: Callable[[Column], Column], lexicon: DataFrame, most: int = MOST_OF_KIND) -> DataFrame:
    """What ``extracted`` gives of ``lines_and_islands``, told in each document's own row: no line and no fact is shuffled, and text is read only for what no table gave.

    A document's work is that of its lines times the labels of its kind; with more than ``most`` of a kind, lines become rows that meet labels by equality.
    """
    if lexicon.groupBy("kind").count().where(F.col("count") > most).limit(1).count():
        return extracted(lines_and_islands(docs, doc, text, opens, closes, kind), doc, kind, lexicon)
    rows = docs.join(F.broadcast(by_kind(lexicon)), F.col(kind) == F.col("__k"))
    rows = rows.select(doc, "__labels", "__own", F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("__l"))
    rows = rows.withColumn("__m", F.array_compact(F.transform("__l", lambda x, i: F.when(opens(x), i).when(closes(x), -1 - i))))
    rows = rows.select(doc, "__labels", "__l", _table_hits(F.col("__l"), _spans(F.col("__l"), F.col("__m")), F.col("__own")).alias("__h"))
    place = F.transform("__h", lambda h, i: F.when(h["is_key"], F.struct(i.alias("at"), h["value"].alias("key"))))
    missing = lambda x: x["in_text"] & (F.size(x["words"]) > 0) & ~F.exists("__h", lambda h: h["variable"].eqNullSafe(x["variable"]))
    rows = rows.select(doc, "__l", "__h", F.array_compact(place).alias("__k"), F.filter("__labels", missing).alias("__w"))
    rows = _from_rows(rows.select(doc, "__l", "__w", _keyed(F.col("__h"), F.col("__k")).alias("__t")), doc, "__l", "__w")
    return rows.select(doc, F.inline(F.concat("__t", F.coalesce("__x", F.slice("__t", 1, 0)))))
