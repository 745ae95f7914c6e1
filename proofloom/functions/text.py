"""Text normalisers and tolerant parsers, as column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and what they fold to.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ"
FOLDED = "aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC"


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is worked out once, whatever the number of places where f has it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def unless_empty(x: Column) -> Column:
    """x, null if it is empty; worked out once."""
    return F.get(F.filter(F.array(x), lambda v: v != ""), F.lit(0))


def blanks_collapsed(x: Column) -> Column:
    """x with one space for each run of blanks; single spaces are passed over."""
    return F.regexp_replace(x, r"\s{2,}|[\t\n\x0B\f\r]", " ")


def fold(x: Column) -> Column:
    """Without accents, lower case, blanks collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.translate(x, ACCENTED, FOLDED)), r"\s+", " "))


def label_fold(x: Column) -> Column:
    """fold, with ordinal and degree signs as letters: how labels and titles are compared."""
    return F.trim(blanks_collapsed(label_plain(x)))


def label_plain(x: Column) -> Column:
    """Small letters without accents, ordinal and degree signs as letters, as long as x. Only texts that aren't all ASCII are searched for them."""
    return F.lower(F.when(F.octet_length(x) == F.char_length(x), x).otherwise(F.translate(x, ACCENTED + "º°", FOLDED + "oo")))


def header_fold(x: Column) -> Column:
    """Lower case, blanks collapsed, accents kept: how the header of a table is compared."""
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


# How numbers, units, serial numbers, fingerprints and days are written.
_NUMERAL = r"[-+]?\d[\d.,]*"
_UNIT = _NUMERAL + r"\s*([A-Za-z%/][A-Za-z%/°º]*)"
_SERIAL = r"\b[A-Z]{2,4}(?:-[A-Z0-9]{2,6}){1,4}\b"
_FINGERPRINT = r"(?i)\b[0-9a-f]{64}\b"
_DAY, _ISO_DAY = r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", r"\b\d{4}-\d{2}-\d{2}\b"


def canonical_number(x: Column) -> Column:
    """The first number of a text, as text with a decimal point: points set thousands apart, a comma is the decimal sign. Null without one, or with several commas."""
    raw = F.regexp_replace(F.regexp_extract(x, f"({_NUMERAL})", 1), "[.,]+$", "")
    plain = lambda n: F.replace(F.replace(n, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    commas = lambda n: F.length(n) - F.length(F.replace(n, F.lit(","), F.lit("")))
    return once(raw, lambda n: F.when((n != "") & (commas(n) <= 1), plain(n)))


def spanish_number(x: Column) -> Column:
    """canonical_number as a decimal."""
    return canonical_number(x).try_cast("decimal(18,4)")


def plain_decimal(x: Column) -> Column:
    """A decimal as text without zeros at its end."""
    return F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def names_code(reference: Column, code: Column) -> Column:
    """Whether code stands in reference as a segment of its own."""
    return F.concat(F.lit("-"), reference, F.lit("-")).contains(F.concat(F.lit("-"), code, F.lit("-")))


def significant_terms(x: Column) -> Column:
    """Distinct folded terms of four letters or more. Only texts that aren't all ASCII are searched for accents, and short words never become values."""
    plain = F.when(F.octet_length(x) == F.char_length(x), x).otherwise(F.translate(x, ACCENTED, FOLDED))
    return F.array_distinct(F.regexp_extract_all(F.lower(plain), F.lit("[a-z0-9]{4,}"), F.lit(0)))


def first_path(document: str, *paths: list[str]) -> Column:
    """The first value that one of the paths (lists of keys) finds in a JSON text column."""
    return F.coalesce(*[F.get_json_object(document, "$" + "".join(f"['{k}']" for k in keys)) for keys in paths])


_ISO_DATE, _DAY_FIRST, _NUMBER = r"^\d{4}-\d\d-\d\d$", r"^\d\d/\d\d/\d{4}$", r"^-?\d+([.,]\d+)?$"


def inferred_type(x: Column) -> Column:
    """boolean, list, date, number or text: what an undeclared value's text looks like."""
    kind = F.when(x.isin("true", "false"), "boolean").when(x.startswith("["), "list")
    return kind.when(x.rlike(_ISO_DATE), "date").when(x.rlike(_NUMBER), "number").otherwise("text")


def decimal_of(x: Column) -> Column:
    """A number with a decimal point or comma, else null."""
    return F.when(x.rlike(_NUMBER), F.replace(x, F.lit(","), F.lit(".")).try_cast("decimal(18,4)"))


def typed(x: Column, kind: str) -> Column:
    """x as its declared kind (decimal, date or text); null if it doesn't fit."""
    if kind == "decimal":
        return decimal_of(x)
    if kind == "date":
        return F.coalesce(F.when(x.rlike(_ISO_DATE), x.try_cast("date")), F.to_date(F.when(x.rlike(_DAY_FIRST), F.try_to_timestamp(x, F.lit("dd/MM/yyyy")))))
    return x


def unit_of(x: Column) -> Column:
    """The unit after the first number that has one; null if there is none."""
    return F.nullif(F.regexp_extract(x, _UNIT, 1), F.lit(""))


def serial_of(x: Column) -> Column:
    """The first serial number, in capitals: two to four letters, then up to four parts of two to six letters or digits, between hyphens."""
    return unless_empty(F.regexp_extract(F.upper(x), f"({_SERIAL})", 1))


def hash_of(x: Column) -> Column:
    """The first 64 hexadecimal digits that stand alone, in small letters."""
    return unless_empty(F.lower(F.regexp_extract(x, f"({_FINGERPRINT})", 1)))


def iso_date(x: Column) -> Column:
    """A day written day/month/year as an ISO date, else one that is written so already, else null."""
    part = lambda d, k: F.lpad(F.get(d, F.lit(k)), 2, "0")
    written = lambda d: F.concat_ws("-", F.get(d, F.lit(2)), part(d, 1), part(d, 0))
    iso = unless_empty(F.regexp_extract(x, f"({_ISO_DAY})", 1))
    return once(F.regexp_extract(x, _DAY, 0), lambda day: F.when(day != "", once(F.split(day, "/"), written)).otherwise(iso))


def admitted_value(x: Column, admitted: list[str]) -> Column:
    """The longest admitted value that the folded text holds."""
    said, out = fold(x), F.lit(None).cast("string")
    for value in sorted(admitted, key=len):
        out = F.when(said.contains(value), value).otherwise(out)
    return out


#: Notations of an instant, in the order in which they are tried.
INSTANTS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd-MM-yyyy HH:mm", "yyyy-MM-dd")


def tolerant_instant(x: Column) -> Column:
    """An instant in the first notation that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in INSTANTS])


def instant_text(x: Column) -> Column:
    """ISO 8601 with a Z, to the second."""
    return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def tolerant_decimal(x: Column) -> Column:
    """A number whose decimal sign is the point or comma that stands last, unless it only sets thousands apart."""
    comma, point = F.instr(F.reverse(x), ","), F.instr(F.reverse(x), ".")
    comma_last = (comma > 0) & ((point == 0) | (comma < point))
    plain = F.when(comma_last, F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(x, F.lit(","), F.lit("")))
    return plain.try_cast("decimal(18,4)")


def keywords(x: Column, stop: list[str]) -> Column:
    """Distinct folded words outside of brackets that aren't stop words."""
    words = F.split(F.regexp_replace(fold(x), r"\([^)]*\)", " "), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(stop)))


def cites(x: Column, code: Column) -> Column:
    """Whether a text holds code as an identifier of its own: nothing of ``0-9a-z-`` touches it."""
    quoted = F.concat(F.lit(r"(^|[^0-9a-z-])\Q"), code, F.lit(r"\E($|[^0-9a-z-])"))
    return F.regexp_like(x, quoted)


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON with keys in order and no blanks; null fields are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def tagged(x: Column, kind: str) -> Column:
    """A value that JSON has no type for, as text under a tag."""
    return F.struct(x.cast("string").alias(f"${kind}"))


def name_id(namespace: str, name: Column) -> Column:
    """A name-based id (version 5): the same name in the same namespace always has the same one."""
    h = F.sha1(F.concat(F.lit(namespace), name))
    part = lambda i, n: F.substring(h, i, n)
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(part(17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def version_key(version: Column) -> Column:
    """What versions are ordered by: their numbers."""
    return F.transform(F.split(version, r"\."), lambda p: p.try_cast("int"))


def in_force(day: Column, since: Column, until: Column) -> Column:
    """Whether a day is in a closed interval; an open end is null."""
    return (since.isNull() | (day >= since)) & (until.isNull() | (day <= until))


def spanish_text(x: Column, places: int) -> Column:
    """A number with points for thousands and a decimal comma."""
    return F.translate(F.format_number(x, places), ",.", ".,")


def markdown_cell(x: Column) -> Column:
    """A text for a cell of a markdown table."""
    return F.replace(F.replace(x, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def comparable(x: Column) -> Column:
    """What texts are compared by: capitals without accents, letters and digits only."""
    return F.regexp_replace(F.upper(F.translate(F.trim(x), ACCENTED, FOLDED)), r"[^\p{L}\p{N}]", "")


def criterion(x: Column) -> Column:
    """The name of a criterion: folded, without signs."""
    return F.trim(F.regexp_replace(fold(x), "[^a-z0-9 ]", ""))
