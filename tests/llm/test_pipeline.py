"""Each stage of the pipeline against plain Python, on documents of which some have no doc_id and some repeat one."""

import random
from collections import Counter

import corpus_pipeline as P
import pytest

from tests.llm.test_operators import SCHEMA, brute_components, measured, without_repeats, words


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    a, b, c, d, e, f = (prose(rnd, n) for n in (90, 120, 100, 80, 150, 110))
    near = " ".join([*c.split()[:-1], "NEU"])
    texts = [(1, a), (1, a), (2, b), (2, d), (None, c), (None, c), (None, near), (5, near), (None, e), (6, e + " more"), (None, f), (None, prose(rnd, 70)), (7, "too short"), (8, prose(rnd, 60) + " " + f)]
    return [(i, t, "en", "xy"[k % 2], len(t)) for k, (i, t) in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def listed(df):
    return sorted((tuple(r) for r in df.select(*P.COLUMNS).collect()), key=str)


def grouped(rows):
    """The groups of rows (0.8) by text, as lists of rows."""
    found = brute_components([(i, r[1]) for i, r in enumerate(rows)], 80)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(found[i][1], []).append(r)
    return list(groups.values())


def test_mixing_has_every_row_as_often_as_the_mix_reads_it(spark, rows):
    found = listed(P.mixed_sources(spark, frame(spark, rows), ""))
    n = sum(len(words(r[1])) for r in rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    target = {"x": min(2 * size["x"], 1.5 * n * 3 / 4), "y": min(2 * size["y"], 1.5 * n / 4)}
    if 1.5 * n * 3 / 4 > 2 * size["x"]:
        target["y"] = min(2 * size["y"], 1.5 * n - target["x"])
    got, often, cut_off = Counter(), Counter(), Counter()
    whole = Counter((r[0], r[1], r[3]) for r in rows)
    for i, t, _, s, n_chars in found:
        got[s] += len(words(t))
        assert n_chars == len(t)
        if (i, t, s) in whole:
            often[i, t, s] += 1
        else:
            assert any(i == r[0] and s == r[3] and r[1].startswith(t + " ") for r in rows)
            cut_off[s] += 1
    assert all(abs(got[s] - target[s]) <= 1 and cut_off[s] <= 1 for s in "xy")
    assert all(often[k] <= 2 * v for k, v in whole.items())
    assert any(i is None for i, *_ in found)


def test_near_dedup_keeps_one_row_of_each_group(spark, rows):
    found = listed(P.near_dedup(spark, frame(spark, rows), ""))
    least = lambda g: min((r[0] is None, r[0] or 0) for r in g)
    groups = grouped(rows)
    assert len(found) == len(groups) < len(rows)
    for g in groups:
        (kept,) = [r for r in found if r[1] in {x[1] for x in g}]
        assert kept in g and (kept[0] is None, kept[0] or 0) == least(g)
    assert None in {r[0] for r in found} and [r[0] for r in found].count(2) == 2


def test_quality_rules_drop_rows_only_by_their_text(spark, rows):
    assert listed(P.quality_rules(spark, frame(spark, rows), "")) == sorted((r for r in rows if not measured(r[1])[-1]), key=str)


def test_substring_dedup_strips_later_documents(spark, rows):
    """Rows without doc_id stay as they are, as remove_repeats says; the rows of doc_id 2 have nothing to lose, though one of their texts repeats words of doc_id 1."""
    rows = [r for r in rows if r[0] != 1]
    want = without_repeats([r for r in rows if r[0] is not None and r[0] != 2])
    text = lambda r: want[r[0]][2] if r[0] in want and want[r[0]][1] else r[1]
    assert listed(P.substring_dedup(spark, frame(spark, rows), "")) == sorted(((r[0], text(r), r[2], r[3], len(text(r))) for r in rows), key=str)


def test_run_packs_the_words_of_the_mix(spark, rows, tmp_path):
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = P.run(spark, str(tmp_path)).collect()
    kept = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in grouped([r for r in rows if not measured(r[1])[-1]])]
    size = Counter()
    stripped = without_repeats([r for r in kept if r[0] is not None and r[0] != 2])
    for r in kept:
        size[r[3]] += len(words(r[1])) - (stripped[r[0]][1] if r[0] in stripped else 0)
    n = 1.5 * sum(size.values())
    x, y = (min(2 * size[s], n * w / 4) for s, w in (("x", 3), ("y", 1)))
    x, y = (x, min(2 * size["y"], n - x)) if n * 3 / 4 > 2 * size["x"] else (min(2 * size["x"], n - y), y)
    assert abs(sum(r.n_words for r in found) - (x + y)) <= 2
    assert None in {r.doc_id for r in found} and 7 not in {r.doc_id for r in found}


@pytest.mark.parametrize("k", range(5))
def test_stages_take_empty_tables_and_columns_of_their_own_names(spark, rows, k):
    name, stage = P.STAGES[k]
    assert stage(spark, frame(spark, []), "").count() == 0
    docs = frame(spark, rows + [(None, None, None, None, None), (9, "", "en", "x", 0)])
    more = docs
    for c in ("row", "kept", "runs", "n_words", "words", "size", "cluster", "__words", "__kept"):
        if not (k == 4 and c == "cluster"):  # packing takes such a column for the groups of copies
            more = more.withColumn(c, docs.n_chars)
    one, two = stage(spark, docs, ""), stage(spark, more, "")
    assert one.columns == two.columns and (k == 4 or one.columns == list(P.COLUMNS))
    if k < 3:
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    else:
        assert one.count() == two.count()
