"""Queries over documents of which some have no doc_id and some repeat one."""

import hashlib
import random

import pytest

from tests.llm.test_operators import SCHEMA, words


def saved(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_mixed_sources(spark, tmp_path):
    from proofloom.llm.queries import op3_mixed_sources

    rnd = random.Random(2)
    ids = [None, None, None, 1, 1, 1, 2, 2, *range(3, 12), None, 1]
    rows = [(d, "w " * rnd.randint(0, 60), "en", "ab"[i % 2], None) for i, d in enumerate(ids)]
    found = op3_mixed_sources(spark, saved(spark, rows, tmp_path)).collect()
    sized = [(d, len(words(t)), s) for d, t, _, s, _ in rows]
    source = {s: sum(n for _, n, x in sized if x == s) for s in "ab"}
    total = 1.5 * sum(source.values())
    target, free, left = {}, {"a": 3, "b": 1}, total
    while over := [s for s in free if left / sum(free.values()) * free[s] > 2 * source[s]]:
        for s in over:
            target[s] = 2.0 * source[s]
            left -= target[s]
            del free[s]
    target |= {s: left / sum(free.values()) * w for s, w in free.items()}
    want = []
    for s in "ab":
        at, quota = 0, round(target[s])
        key = lambda r: (r[0] is None, hashlib.md5(str(r[0]).encode()).hexdigest() if r[0] is not None else "", r[0] or 0, r[1])
        for d, n, _ in sorted((r for r in sized if r[2] == s), key=key):
            taken = sum(max(0, min(at + n, quota - k * source[s]) - at) for k in (0, 1))
            want.append((d, n, source[s], taken))
            at += n
    assert sorted(((r.doc_id, r.size, r.source_size, r.taken) for r in found), key=str) == sorted(want, key=str)
    for s in "ab":
        assert sum(r.taken for r in found if r.source_size == source[s]) == pytest.approx(target[s], abs=1)


def test_packing_keeps_near_copies_apart(spark, tmp_path):
    from proofloom.llm.queries import op5_packed_sequences
    from tests.llm.test_operators import brute_components

    rnd = random.Random(7)
    base, rows = [f"w{i}" for i in range(100)], [(None, "a b c", "en", "n", None), (1, "d e f", "en", "n", None), (1, "", "en", "n", None)]
    for d in range(2, 30):
        own = list(base)
        own[rnd.randrange(100)] = f"n{d}"
        rows.append((d, " ".join(own), "en", f"s{d}", None))
    rows += [(d, " ".join(f"x{d}y{i}" for i in range(50)), "en", f"s{d}", None) for d in range(30, 40)]
    found = op5_packed_sequences(spark, saved(spark, rows, tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in found) == sorted((str(d), len(words(t))) for d, t, *_ in rows)
    comp = {d: c for d, (_, c, _) in brute_components([r for r in rows if r[0] is not None and r[1]], 80).items()}
    bins = {}
    for r in found:
        if r.bin is not None and r.doc_id is not None:
            bins.setdefault(r.bin, []).append(comp[r.doc_id])
    assert len(set(comp.values())) < len(comp) - 20
    assert all(len(set(own)) == len(own) for own in bins.values())
