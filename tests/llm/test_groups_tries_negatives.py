"""Fingerprint groups, prefix tries and hard negatives against plain loops, on odd rows too."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.test_operators import words

# ---- 11: fingerprints


def fingerprint(text):
    w = words(text, lower=True)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def brute_groups(rows):
    """(doc_id, fingerprint, component_id) of rows (doc_id, text)."""
    prints = [fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2 and comp[i] != comp[j]:
                old = comp[i]
                comp = [comp[j] if c == old else c for c in comp]
    least = {}
    for (d, _), c in zip(rows, comp, strict=True):
        least[c] = min((x for x in (least.get(c), d) if x is not None), default=None)
    return [(d, f"{p:016x}", least[c]) for (d, _), p, c in zip(rows, prints, comp, strict=True)]


def texts(n, seed=4):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if i % 3 and out:  # a few words of a long text change few bits of its fingerprint
            w = (out[rnd.randrange(len(out))] or "x").split()
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = rnd.choice(["Neu", "ÄÖ", "z"])
            out.append(" ".join(w))
        else:
            out.append(" ".join(f"w{rnd.randrange(4000)}" for _ in range(rnd.randint(3, 600))))
    return out


ODD = [(None, "gibt es nicht"), (None, "Gibt  ES\nnicht"), (7000, None), (7001, ""), (7001, " \t"), (7002, "a b"), (7002, "A\vb"), (7003, "wort " * 40000), (None, "x" * 50000)]


@pytest.mark.parametrize("block", [1 << 14, 5])
def test_groups(spark, block):
    from proofloom.llm.simhash import SimHash, simhash_groups

    rows = [(i, t) for i, t in enumerate(texts(150))] + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("print", "tile", "least", "comp", "component_id", "fingerprint"):
        df = df.withColumn(c, F.lit("clash"))
    found = simhash_groups(df.repartition(3), SimHash(block=block, group=200, part_bytes=3000))
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute_groups(rows), key=str)
    assert simhash_groups(df.where("1 = 0")).count() == 0


def test_all_close_fingerprints_are_linked_and_links_span(spark):
    from proofloom.llm.simhash import SimHash, links

    rnd = random.Random(8)
    prints = {rnd.getrandbits(64) for _ in range(200)}
    for p in list(prints)[:60]:
        prints |= {p ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(6)}
    hot = rnd.getrandbits(64)
    prints |= {hot} | {hot ^ 1 << i for i in range(64)} | {0, 2**64 - 1, 1}
    signed = lambda p: p - (p >> 63 << 64)
    df = spark.createDataFrame([(signed(p),) for p in prints], "print long")
    found = [(r.a, r.b) for r in links(df, SimHash(block=16, group=64)).collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 4 * 64 for a, b in found)
    parent = {signed(p): signed(p) for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        parent[root(a)] = root(b)
    comp = {}
    for p in prints:
        comp.setdefault(root(signed(p)), set()).add(p)
    left, want = set(prints), []
    while left:
        group, new = set(), {left.pop()}
        while new:
            group |= new
            left -= new
            new = {q for q in left for p in new if (p ^ q).bit_count() <= 2}
        want.append(frozenset(group))
    assert {frozenset(g) for g in comp.values()} == set(want)


# ---- 12: tries


def brute_trie(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            tie = hashlib.sha256(f"{len(r.encode())}:".encode() + r.encode() + x.encode()).digest()[:16]
            convs[c].append((t is not None, t or 0, tie, r, x))
    seq = {}
    own = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq[c] = own.get(c - c % 100, [])[:h] + v[h:]
    return nodes_of(seq)


def nodes_of(seq):
    members, children = defaultdict(list), defaultdict(int)
    for c in sorted(seq):
        for d in range(len(seq[c]) + 1):
            members[tuple(seq[c][:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += not children[k]
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in m if len(seq[c]) == len(k))
        out.append((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


TURNS = "conv_id long, turn long, role string, text string"


def test_trie_of_odd_conversations(spark):
    from proofloom.llm.prefix_trie import conversation_trie

    rnd = random.Random(6)
    rows = [(None, 0, "user", "nobody's"), (0, None, "system", "no turn"), (0, 0, None, None), (0, 0, "", ""), (0, 1, "user", None), (5000, None, None, None)]
    for c in [*range(0, 60), 100, 101, 107, 250, 251, 900]:
        for t in range(rnd.choice([1, 2, 5, 9])):
            rows.append((c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "b", "é 😀", "x" * 3000])))
    rows += [(c, t, "user", f"same {t}") for c in range(300, 390) for t in range(7)]  # a group of copies
    rows += [(c, t, "user", f"same {t}" if t < 150 or c % 2 else f"other {c}") for c in (400, 500, 600, 700) for t in range(200)]
    rows += rows[10:14]  # repeated rows
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    for c in ("pos", "digest", "rep", "cls", "depth", "n", "len"):
        df = df.withColumn(c, F.lit("clash"))
    found = sorted(map(tuple, conversation_trie(df).collect()))
    assert found == brute_trie(rows)
    assert conversation_trie(df.where("1 = 0")).count() == 0


@pytest.mark.parametrize("turns", [1, 4])
def test_trie_of_turns(spark, turns):
    """The trie itself, with sequences that are prefixes of others, empty ones and one that is all there is."""
    from proofloom.llm.prefix_trie import Trie, trie

    rnd = random.Random(turns)
    letters = "abc"
    many = {i: [("u", rnd.choice(letters) * rnd.randint(1, 2)) for _ in range(rnd.randint(0, 6))] for i in range(80)}
    many |= {200 + i: [("u", "deep")] * 20 for i in range(4)} | {300: [("u", "deep")] * 19}
    for seq in (many, {4: []}, {4: [("u", "x")] * 3}, {4: [], 5: []}, {9: [("u", "x")], 4: [("u", "x")] * 2}):
        convs = spark.createDataFrame([(c, len(s)) for c, s in seq.items()], "conv_id long, len long")
        rows = [(c, i + 1, hashlib.md5(t.encode()).digest(), len(t)) for c, s in seq.items() for i, (_, t) in enumerate(s)]
        df = spark.createDataFrame(rows, "conv_id long, pos long, digest binary, chars long")
        assert sorted(map(tuple, trie(convs, df, Trie(most_turns=turns, span=3)).collect())) == nodes_of(seq)


# ---- 13: hard negatives


def brute_negatives(rows, every=100):
    known = [(v, l, [math.floor(256 * x) for x in e]) for v, l, e in rows if l is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905,E731
    first = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, (a, l, q) in enumerate(known):
        if a is None or a % every:
            continue
        scored = [(dot(q, r), v, m) for j, (v, m, r) in enumerate(known) if j != i]
        for ps, p, _ in sorted((x for x in scored if x[2] == l), key=first)[:5]:
            rest = sorted((x for x in scored if x[2] != l and 80 * ps <= 100 * x[0] <= 100 * ps), key=first)[:5]
            out += [(a, p, k, n, ps, ns) for k, (ns, n, _) in enumerate(rest, 1)]
    return sorted(out, key=str)


def vectors(n=500, dim=6, seed=1):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(8, dim))
    hot = [float(x) for x in np.float32(rnd.normal(size=dim))]
    rows = []
    for i in range(n):
        v = hot if i % 3 == 0 else (base[rnd.integers(8)] + rnd.normal(size=dim) * rnd.choice([0.01, 0.4]))
        rows.append((i, int(rnd.integers(4)), [float(x) for x in np.float32(v)]))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, small):
    from proofloom.llm.hard_negatives import HardNegatives, hard_negatives

    inf, nan = float("inf"), float("nan")
    rows = vectors() + [
        (600, None, [1.0] * 6), (700, 1, None), (800, 1, [1.0, None, 1.0]), (900, 1, [nan] * 6), (1000, 1, [inf] + [0.0] * 5), (1100, 2, []), (1200, 2, [1.0]), (1300, 3, [-1.0] * 9),
        (None, 1, [0.5] * 6), (None, 2, [0.5] * 6), (100, 1, [0.25] * 6), (100, 1, [0.25] * 6), (1400, 99, [0.1] * 6), (1500, 0, [0.0] * 6), (1501, 0, [0.0] * 6),
    ]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(4)
    for c in ("cid", "q", "ids", "cell", "r", "block", "wanted", "score"):
        df = df.withColumn(c, F.lit("clash"))
    cfg = HardNegatives(group=2, chunk=40, most_cells=6, pivot_sample=50) if small else HardNegatives()
    found = hard_negatives(df, cfg).collect()
    assert sorted(map(tuple, found), key=str) == brute_negatives(rows)
    assert len(found) > 100
    assert hard_negatives(df.where("1 = 0")).count() == hard_negatives(df.where("vec_id = 7")).count() == 0


def test_scores_of_large_vectors_are_exact(spark):
    from proofloom.llm.hard_negatives import hard_negatives

    rows = [(100, 1, [131071.0] * 12), (1, 1, [131070.5, 131071.0] * 6), (2, 2, [131000.0] * 12), (3, 2, [1e30] + [0.0] * 11), (200, 2, [-1e30] * 12), (4, 2, [-130000.0] * 12), (5, 1, [-120000.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    want = brute_negatives([(v, l, [max(-131072.0, min(131072.0, x)) for x in e]) for v, l, e in rows])
    assert sorted(map(tuple, hard_negatives(df).collect()), key=str) == want != []


def test_far_groups_get_few_candidates(spark):
    """Cells far from each other: bands keep their candidates away from groups that cannot use them."""
    from proofloom.llm.hard_negatives import HardNegatives, Join, find_positives

    rnd = np.random.default_rng(3)
    centres = np.eye(8)[:4] * 3000
    rows = [(i, 0, [int(x) for x in centres[i % 4] + rnd.normal(size=8) * 3], [i]) for i in range(400)]
    df = spark.createDataFrame(rows, "cid long, label long, q array<int>, ids array<long>")
    asked = df.where("cid < 40").select("cid", "label", "q")
    join = Join(df, asked, HardNegatives(group=10, chunk=50))
    assert len(join.space.pivots) == 4 and sorted(join.blocks) == [1, 1, 1, 1]

    def low(anchors, found):
        return anchors.join(found.where("rank = 6").selectExpr("anchor as cid", "score as low"), "cid").withColumn("high", F.lit(2.0**62))

    found = join.search(join.anchors.withColumn("wanted", F.lit(None).cast("array<long>")), find_positives(6), 6, low)
    q = np.array([r[2] for r in rows])
    for a in range(40):
        s = q @ q[a]
        want = sorted(range(400), key=lambda i: (-s[i], i))[:6]
        assert [r.vec_id for r in found.where(f"anchor = {a}").orderBy("rank").collect()] == want

