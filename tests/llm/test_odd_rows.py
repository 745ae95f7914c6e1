"""Operators on rows that repeat or lack a doc_id, on columns named like their own, on empty tables; packing and scores against plain loops."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import as_dict, brute_components, ids_of, words

ROWS = [(1, "eins zwei drei"), (1, "eins zwei drei"), (1, "anders"), (None, "ohne Nummer"), (None, None), (2, None), (3, ""), (3, " \n"), (4, "x" * 5000), (5, "wort " * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    for c in ("row", "digest", "start", "n_tokens", "shard", "score", "held_out", "size", "bin", "regs", "of"):
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


def test_token_files(odd):
    from proofloom.llm.tokens import TokenFiles, read_documents, token_files

    found = read_documents(token_files(odd, TokenFiles(length=32, batch=2, file_bytes=9000))).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for (d, _), ids in zip(order, ids_of([t for _, t in order]), strict=True):
        ids = np.array([*ids, 0], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == want


def test_media_columns(odd):
    from proofloom.llm.media import Media, media_columns

    for cfg in (Media(), Media(most_broadcast=0)):
        found = media_columns(odd, cfg).collect()
        padded = lambda t: (t or "").encode() + b" " * (-len((t or "").encode()) % 192 or 192 * (not t))
        assert sorted((str(r.doc_id), r.n_bytes, r.payload_sha256) for r in found) == sorted((str(d), len((t or "").encode()), hashlib.sha256(padded(t)).hexdigest()) for d, t in ROWS)
        places = {}
        for r in found:
            places.setdefault(r.payload_sha256, set()).add((r.shard, r.offset, r.length))
        assert all(len(p) == 1 for p in places.values())


def test_near_duplicates(odd, spark):
    from proofloom.llm.near_dup import near_duplicates

    found = near_duplicates(odd)
    counted = {1: "eins zwei drei", 2: None, 3: "", 4: "x" * 5000, 5: "wort " * 3000}
    want = brute_components(list(counted.items()))
    assert {k: v for k, v in as_dict(found, "n_shingles", "component_id", "kept").items() if k != 1} == {k: v for k, v in want.items() if k != 1}
    assert found.count() == 5


def test_near_duplicates_find_pairs_just_above_the_limit(spark):
    """Recall where it is hardest: 400 pairs of a similarity of 0.85 to 0.9, and as many of 0.8 to 0.85 that must stay apart."""
    from proofloom.llm.near_dup import near_duplicates

    rnd, rows, linked = random.Random(12), [], {}
    for p in range(800):
        n = rnd.randint(60, 400)
        a = [f"p{p}w{i}" for i in range(n)]
        b, share = list(a), 0.0
        while True:  # a changed word takes five shingles from either
            b[rnd.randrange(n)] = f"n{rnd.random()}"
            x, y = ({tuple(t[i : i + 5]) for i in range(n - 4)} for t in (a, b))
            share = len(x & y) / len(x | y)
            if share < (0.9 if p % 2 else 0.85):
                break
        rows += [(2 * p, " ".join(a)), (2 * p + 1, " ".join(b))]
        linked[p] = 100 * len(x & y) >= 85 * len(x | y)
    found = as_dict(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "component_id")
    assert sum(linked.values()) > 250
    assert {p: found[2 * p + 1] == (2 * p,) for p in range(800)} == linked


def plain_packing(pieces, capacity):
    """Best fit by looking at every bin: the tightest that has room and neither the source nor the copies; the earliest of equals."""
    bins, out = [], []
    for size, source, cluster in pieces:
        fits = [(b["room"], i) for i, b in enumerate(bins) if b["room"] >= size and source not in b["sources"] and cluster not in b["clusters"]]
        if fits:
            i = min(fits)[1]
        else:
            bins.append({"room": capacity, "sources": set(), "clusters": set()})
            i = len(bins) - 1
        b = bins[i]
        out.append((i, capacity - b["room"]))
        b["room"] -= size
        b["sources"].add(source)
        b["clusters"].add(cluster)
    return out


def test_best_fit_equals_a_plain_loop():
    from proofloom.llm.packing import best_fit

    rnd = random.Random(9)
    for _ in range(60):
        capacity = rnd.randint(5, 60)
        pieces = sorted(((rnd.randint(1, capacity), rnd.randrange(6), rnd.randrange(9)) for _ in range(rnd.randint(0, 80))), key=lambda p: -p[0])
        sizes, sources, clusters = (list(x) for x in zip(*pieces, strict=True)) if pieces else ([], [], [])
        assert best_fit(sizes, sources, clusters, capacity) == plain_packing(pieces, capacity)


def test_packing_of_a_block_equals_a_plain_loop(spark):
    from proofloom.llm.packing import Packing, pack

    rnd = random.Random(10)
    rows = [(i % 50 if i % 7 else None, "w " * rnd.randint(0, 130), "abc"[i % 3] if i % 5 else None, i % 20) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, cluster long")
    for apart in (True, False):
        found = pack(df, Packing(capacity=50, block=1 << 20, sources_apart=apart)).collect()
        assert sorted((str(d), len(words(t))) for d, t, *_ in rows if not words(t)) == sorted((str(r.doc_id), 0) for r in found if r.bin is None)
        assert sum(r.n_words for r in found) == sum(len(words(t)) for _, t, *_ in rows)
        by_bin = {}
        for r in found:
            if r.bin is not None:
                by_bin.setdefault(r.bin, []).append(r)
        for own in by_bin.values():
            own.sort(key=lambda r: r.offset)
            assert sum(r.n_words for r in own) <= 50 and [r.offset for r in own] == [sum(x.n_words for x in own[:i]) for i in range(len(own))]
        full = sum(r.n_words for r in found) / (50 * len(by_bin))
        assert full > (0.3 if apart else 0.8)


def test_quality_scores(odd, spark):
    from proofloom.llm.quality_model import QualityModel, score_quality

    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (5, 1, 0), (None, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    found = score_quality(odd, labels, QualityModel(steps=20)).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(d) for d, _ in ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    same = {r.score for r in found if r.doc_id == 3}
    assert len(same) == 1


def test_samples_of_very_large_tables_are_not_empty(spark):
    from proofloom.llm.quality_model import _bounded

    class Huge:
        """A table that says to have 10^11 rows."""

        def __init__(self, df):
            self.df = df

        def count(self):
            return 10**11

        def where(self, c):
            return self.df.where(c)

    share = 8_000_000_000 / 10**11
    found = _bounded(Huge(spark.range(20_000).withColumnRenamed("id", "doc_id")), 8_000_000_000, "doc_id").count()
    assert 0.8 * share * 20_000 < found < 1.2 * share * 20_000
    tiny = _bounded(Huge(spark.range(10).withColumnRenamed("id", "doc_id")), 8000, "doc_id")  # a share of 8e-8: below a millionth, above nothing
    assert "0 > " not in tiny._jdf.queryExecution().optimizedPlan().toString() and tiny.count() <= 10


def test_points_stay_exact_for_very_many_slots(spark):
    from fractions import Fraction
    from math import isqrt

    from proofloom.llm.mixing import points_at

    n = 10**40
    golden = Fraction(isqrt(5 * n * n) - n, 2 * n)
    ids = [0, 1, 2, 10**6, 2**33 + 7, 10**11 + 3]
    found = {r.id: r.x for r in spark.createDataFrame([(i,) for i in ids], "id long").select("id", points_at(F.col("id")).alias("x")).collect()}
    for i in ids:
        want = float((i * golden + golden / 2) % 1)
        assert min(abs(found[i] - want), 1 - abs(found[i] - want)) < 1e-9


def test_quality_rules_keep_columns_of_their_own_names(spark):
    from proofloom.llm.quality_rules import keep_good, quality

    rnd = random.Random(1)
    good = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(200))
    df = spark.createDataFrame([(1, good), (1, good), (None, good), (2, None)], "doc_id long, text string")
    for c in ("__words", "__text", "__n_words", "row", "my-f"):
        df = df.withColumn(c, F.lit("mine"))
    kept = keep_good(df)
    assert kept.columns == df.columns and kept.count() == 3 and {r["__words"] for r in kept.collect()} == {"mine"}
    assert quality(df).where("kept").count() == 3 and "__text" in quality(df).columns


def test_packing_deals_rows_alike_to_all_blocks(spark):
    from proofloom.llm.packing import Packing, pack

    df = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("a b c").alias("text"))
    found = pack(df, Packing(block=100)).groupBy(F.shiftright("bin", 20).alias("block")).count().collect()
    assert len(found) == 30 and max(r["count"] for r in found) < 200


def test_quality_model_of_rows_alike(spark):
    from proofloom.llm.quality_model import QualityModel, _bounded, score_quality

    cfg = QualityModel(sample_rows=500, steps=50)
    few = spark.range(6000).selectExpr("id % 3 as doc_id", "'all the same text' as text")
    labels = spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, quality int")
    for df in (few, few.withColumn("doc_id", F.lit(2).cast("long"))):
        rows = score_quality(df, labels, cfg).collect()
        assert len(rows) == 6000 and len({r.score for r in rows}) == 1
    drawn = _bounded(few.withColumn("k", F.monotonically_increasing_id()), 500, "k").count()
    assert 300 < drawn <= 1000


def test_token_files_split_rows_of_one_id(spark):
    from proofloom.llm.tokens import TokenFiles, read_documents, token_files

    rows = [(None, f"text {i % 7} " + "w " * 60) for i in range(300)] + [(5, "same " * 30)] * 300 + [(6, "end")]
    files = token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), TokenFiles(length=32, batch=2, file_bytes=4000))
    assert files.agg(F.max("docs")).first()[0] < 120 and files.count() > 10
    found = sorted(read_documents(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None] * 300 + [5] * 300 + [6]
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    crc = {t: zlib.crc32(np.array([*ids, 0], "<u4").tobytes()) for t, ids in zip({t for _, t in rows}, ids_of([t for t in {t for _, t in rows}]), strict=True)}
    assert sorted(r.ids_crc32 for r in found) == sorted(crc[t] for _, t in rows)
