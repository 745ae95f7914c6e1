"""What bounds the size of the groups that tasks compare."""

from collections import Counter

import numpy as np


def test_cells_of_near_duplicates_are_bounded_and_hold_every_pair_once(spark):
    from proofloom.llm.near_dup import NearDup, deal

    block, members = 8, [(1, i, 0 if i < 30 else i) for i in range(120)] + [(2, i, i) for i in range(90)] + [(3, i, i // 2) for i in range(6)]
    sizes = Counter((k, c) for k, _, c in members)
    main = {k: max((n, c) for (b, c), n in sizes.items() if b == k) for k in (1, 2, 3)}
    up = lambda n: -(-n // block)
    total = Counter(k for k, *_ in members)
    rows = [(k, i, 1, c, main[k][1], up(main[k][0]), up(total[k] - main[k][0])) for k, i, c in members]
    reps = spark.range(120).selectExpr("id", "cast('' as binary) as regs")
    here = spark.createDataFrame(rows, "key long, id long, n long, comp long, main long, mains long, minors long")
    dealt, groups = deal(here, reps, NearDup(block=block))
    dealt, cells = dealt.collect(), {}
    for r in dealt:
        cells.setdefault((r.key, r.part), []).append(r)
    assert max(map(len, cells.values())) <= 5 * block
    assert groups == len(dealt) // (4 * block)
    met = Counter()
    for own in cells.values():
        for x in own:
            for y in own:
                twice = x.left and x.right and y.left and y.right and x.id > y.id
                if x.left and y.right and x.comp != y.comp and not twice:
                    met[x.key, min(x.id, y.id), max(x.id, y.id)] += 1
    want = {(k, i, j) for k, i, c in members for b, j, d in members if k == b and i < j and c != d}
    assert set(met) == want and set(met.values()) == {1}


def test_registers_of_single_shingles_are_told_apart():
    from proofloom.llm.near_dup import NearDup, registers

    cfg = NearDup()
    g = np.random.default_rng(1).integers(0, 2**64, 4000, dtype=np.uint64)
    r = registers(g, np.arange(4001), cfg).reshape(4000, cfg.bands, cfg.rows)
    assert (r > 0).all() and (r < cfg.top).all()
    assert len(np.unique(r[:, 0], axis=0)) == 4000
