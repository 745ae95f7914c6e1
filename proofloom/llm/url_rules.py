"""URL filter: listed rules first, association rules mined by FP-growth for the rest. DataFrame functions and Spark ML only.

``host_path`` splits urls, ``listed_rule`` finds the longest listed rule, ``mined_rules`` learns which combinations of url tokens go
with rejected pages, ``judge`` puts both together. Urls are read once, with no shuffle: the mined rules travel inside the plan
as an inverted index from a rule's rarest token to the rule. Their number does not grow with the input: every rule holds in at least
``min_support`` of the labelled pages. All frequent tokens of a page are mined. Tokens that are on the same labelled pages are one item, which loses
no rule: FP-growth would otherwise list all subsets of a path that many pages share.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlFilter:
    #: (verdict, host, path); a rule fits the host and its subdomains and paths that begin with its path.
    listed: tuple[tuple[str, str, str], ...] = (
        ("allow", "org", "/"),
        ("block", "example.org", "/es/"),
        ("block", "example.org", "/en/1"),
        ("allow", "com", "/fr/"),
        ("block", "com", "/de/"),
    )
    #: A mined rule holds, with the rejecting label, in this share of the labelled pages at least and in so many of them, ...
    min_support: float = 0.004
    min_pages: int = 5
    #: ... and the rejecting label's share of the pages it fits is so many times that of all pages, as the lower end of
    #: Wilson's interval of so many standard errors says, so that few of many rules are there by chance.
    min_lift: float = 1.5
    errors: float = 3.0
    #: Where a labelled page has more frequent tokens than this, tokens that are on the same pages are one item before they are mined.
    basket: int = 8
    rejecting_item: str = field(default="label=0", init=False)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url. A null url, or one without ``://``, has both empty."""
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.lit(""))
    return host, F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def listed_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest listed rule that fits, as text (else null), and its verdict (else null). Equal lengths: the first listed."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)).otherwise(text)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: labels of the host, words of the path (not pure numbers), names in its query, its scheme and ending."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)

    def tagged(tag: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: (x != "") & ~x.rlike(r"^\d+$")), lambda x: F.concat(F.lit(tag), x))

    return F.array_distinct(
        F.concat(
            tagged("host:", F.split(host, r"\.")),
            tagged("path:", F.split(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", ""), "/")),
            tagged("query:", F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1))),
            tagged("ending:", F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))),
            tagged("scheme:", F.array(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:(.*?))://", 1))),
        )
    )


def lower_end(share: Column, n: Column, errors: float) -> Column:
    """The lower end of Wilson's interval of a share that n pages have, so many standard errors wide to each side."""
    z = errors * errors
    return (share + z / (2 * n) - errors * F.sqrt(share * (1 - share) / n + z / (4 * n * n))) / (1 + z / n)


def alike(known: DataFrame, tokens: list[str]) -> dict[str, str]:
    """Each token -> the first of those that are on the same rows of known (id, items): equal counts and equal sums of two hashes of their ids."""
    listed = F.array(*map(F.lit, tokens))
    own = known.select("id", F.explode(F.array_intersect("items", listed)).alias("t"))
    part = lambda seed: F.sum(F.xxhash64("id", F.lit(seed)).cast("decimal(38,0)"))
    rows = own.groupBy("t").agg(F.count("*").alias("n"), part(1).alias("a"), part(2).alias("b")).collect()  # a row for a frequent token
    first: dict[tuple, str] = {}
    for r in sorted(rows, key=lambda r: r.t):
        first.setdefault((r.n, r.a, r.b), r.t)
    return {r.t: first[r.n, r.a, r.b] for r in rows}


def mined_rules(pages: DataFrame, labels: DataFrame, cfg: UrlFilter) -> tuple[list[list[str]], dict[str, int], dict[str, str]]:
    """Token combinations that go with quality 0, none containing another whole; on how many labelled pages each of their tokens is; and for each frequent
    token the one that stands for it in them (``alike``): a rule fits a page that has for each of its tokens one of those that it stands for.

    A page's label is that of the document with its id; of several labels the lowest counts. Unlabelled pages are not used. All labelled
    pages are counted and mined with all their frequent tokens. Tokens of all labelled pages tell nothing and are in no rule.
    """
    host, path = host_path(F.col("url"))
    label = labels.where("quality is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.min("quality").alias("q"))
    known = pages.select("page_id", "url", url_tokens(F.col("url"), host, path).alias("items")).join(label, "page_id").select(F.struct("page_id", "url").alias("id"), "items", "q")
    n, rejected = known.agg(F.count("*"), F.count_if(F.col("q") == 0)).first()
    if not rejected:
        return [], {}, {}
    least = max(cfg.min_pages, cfg.min_support * n)
    counts = known.select(F.explode("items").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    frequent = {r.t: r.n for r in counts.where((F.col("n") >= least) & (F.col("n") < n)).collect()}  # on average a page has min_support times their number at most
    if not frequent:
        return [], {}, {}
    longest = known.agg(F.max(F.size(F.array_intersect("items", F.array(*map(F.lit, sorted(frequent))))))).first()[0]
    stands = alike(known, sorted(frequent)) if longest > cfg.basket else {t: t for t in frequent}
    one = F.from_json(F.lit(json.dumps(stands)), "map<string,string>")
    items = F.array_distinct(F.array_compact(F.transform("items", lambda t: F.try_element_at(one, t))))
    baskets = known.select(F.when(F.col("q") == 0, F.concat(items, F.array(F.lit(cfg.rejecting_item)))).otherwise(items).alias("items"))
    wanted = cfg.min_lift * rejected / n
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n), minConfidence=min(1.0, wanted)).fit(baskets)
    fits = F.round(F.col("support") * n / F.col("confidence"))
    rules = model.associationRules.where((F.col("consequent")[0] == cfg.rejecting_item) & (lower_end(F.col("confidence"), fits, cfg.errors) >= wanted))
    found = sorted((sorted(r.antecedent) for r in rules.select("antecedent").collect()), key=lambda r: (len(r), r))
    kept: list[frozenset[str]] = []
    holds: dict[str, list[frozenset[str]]] = {}
    for r in map(frozenset, found):  # a rule that has all tokens of another cannot add a match
        if not any(k <= r for t in r for k in holds.get(t, ())):
            kept.append(r)
            holds.setdefault(min(r), []).append(r)
    return sorted(sorted(r) for r in kept), {t: frequent[t] for r in kept for t in r}, stands


def mine(pages: DataFrame, labels: DataFrame, cfg: UrlFilter) -> tuple[list[list[str]], dict[str, int]]:
    """The rules of ``mined_rules``, and on how many labelled pages each of their tokens is."""
    return mined_rules(pages, labels, cfg)[:2]


def inverted_index(rules: list[list[str]], pages: dict[str, int]) -> dict[str, list[list[str]]]:
    """The token of each rule that is on the fewest pages -> the rules it stands for."""
    index: dict[str, list[list[str]]] = {}
    for r in rules:
        index.setdefault(min(r, key=lambda t: (pages.get(t, 0), t)), []).append(r)
    return index


def judge(pages: DataFrame, labels: DataFrame, cfg: UrlFilter | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined): the listed rule's verdict, else block where a mined rule fits, else allow.

    Null urls and urls without ``://`` have empty host and path and are judged by the mined rules alone. Repeated rows are each
    judged; further columns of ``pages`` are ignored. No labelled page means no mined rule.
    """
    cfg = cfg or UrlFilter()
    mined, on_pages, stands = mined_rules(pages, labels, cfg)
    index = F.from_json(F.lit(json.dumps(inverted_index(mined, on_pages))), "map<string,array<array<string>>>")
    host, path = host_path(F.col("url"))
    cols = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), cfg.listed)
    cols = cols.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("__v"), url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("__t"))
    if mined:
        used = {t: s for t, s in stands.items() if s in on_pages}
        one = F.from_json(F.lit(json.dumps(used)), "map<string,string>")
        cols = cols.withColumn("__t", F.array_distinct(F.array_compact(F.transform("__t", lambda t: F.try_element_at(one, t)))))
        fits = F.exists(
            "__t",
            lambda t: F.coalesce(F.exists(F.try_element_at(index, t), lambda r: F.size(F.array_except(r, F.col("__t"))) == 0), F.lit(False)),
        )
    else:
        fits = F.lit(False)
    cols = cols.withColumn("mined", fits)
    return cols.select(
        "page_id", "host", "path", "rule", F.coalesce("__v", F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"), "mined"
    )
