"""Every operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made(seed=3, n=60):
    """Documents with exact and near copies, shared passages, junk, odd white space, an empty, a null and a long text."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéñß") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    text = lambda k: "".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", "\n", "\t", "  "]) for _ in range(k))
    passage, out = text(60), []
    for i in range(n):
        kind = i % 10
        if kind in (0, 1) or not out:
            t = text(rnd.randint(1, 200))
        elif kind == 2:
            t = out[rnd.randrange(len(out))]
        elif kind in (3, 4):
            w = WORD.findall(out[rnd.randrange(len(out))] or "") or ["x"]
            w[rnd.randrange(len(w))] = "NEU"
            t = " ".join(w)
        elif kind in (5, 6):
            t = text(rnd.randint(0, 30)) + " " + passage + text(rnd.randint(0, 30))
        else:
            t = [None, "", " \n ", "a b c d", "x " * 90, "Wort! " * 40, text(4000), "don't we'll <|endoftext|> 'sx ½ ２ 　 ok"][rnd.randrange(8)]
        out.append(t)
    sources = ["b", "a", "é", None, "a", "a"]
    return [(i * 3, t, "en", sources[i % 6], None) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t, lower=False):
    t = t or ""
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t) if lower else t)


def as_dict(df, *value):
    return {r.doc_id: tuple(r[v] for v in value) for r in df.collect()}


# ---- 1 and 8: tokens


def ids_of(texts):
    from tokenizers import Tokenizer

    from proofloom.llm.tokens import default_vocabulary

    return [e.ids for e in Tokenizer.from_file(default_vocabulary()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_equals_the_library_on_odd_texts():
    from proofloom.llm import tokens
    from proofloom.llm.words import pieces

    rnd = random.Random(5)
    letters = " \n\t'srevmlldtéßñ1２٣三.!# 　\u0085\x1c AB's're<|endoftext|>😀ª½"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + ["", "a<|endoftext|> b", "<|endoftext|>'s"]
    encoder, mine = tokens.Encoder(tokens.default_vocabulary()), []
    for _, _, data, off in pieces(pa.array(texts), 5000):
        ids, at, n = encoder.encode(data, off)
        ends = np.cumsum(n)
        mine += [ids[e - k : e].tolist() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
        assert (np.diff(at) >= 0).all()
    assert mine == ids_of(texts)


@pytest.mark.parametrize("length,batch", [(8, 2), (2048, 256)])
def test_token_files(docs, rows, length, batch):
    from proofloom.llm.tokens import TokenFiles, read_documents, token_files

    found = as_dict(read_documents(token_files(docs, TokenFiles(length=length, batch=batch, file_bytes=20000))), "start", "n_tokens", "ids_crc32")
    start, want = 0, {}
    for r, ids in zip(rows, ids_of([r[1] for r in rows]), strict=True):
        ids = np.array([*ids, 0], "<u4")
        want[r[0]] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert found == want


def test_token_files_have_equal_sequences_and_masks(docs):
    from proofloom.llm.shared import file_system
    from proofloom.llm.tokens import TokenFiles, token_files

    for f in token_files(docs, TokenFiles(length=16, batch=4, file_bytes=20000)).collect():
        fs, path = file_system(f.uri)
        t = pa.ipc.open_file(fs.open_input_file(path + ".ids")).read_all()
        assert t.schema.field("ids").type == pa.list_(pa.uint16(), 16)
        assert sum(sum(m) for m in t.column("mask").to_pylist()) == f.tokens


def test_token_files_of_no_documents(empty):
    from proofloom.llm.tokens import read_documents, token_files

    assert read_documents(token_files(empty)).count() == 0


def test_section_tokens_sum_to_documents_and_follow_the_rule(docs, rows):
    from proofloom.llm.tokens import allocate, section_tokens

    found = section_tokens(docs).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"))
    assert {k: v[0] for k, v in as_dict(found, "n").items()} == {r[0]: len(i) for r, i in zip(rows, ids_of([r[1] for r in rows]), strict=True)}
    a, b, sa, sb = (np.array(x) for x in ([0, 2, 5, 8, 12], [2, 5, 8, 12, 13], [0, 4, 6], [4, 6, 9]))
    place, crosses = allocate(a, b, sa, sb)
    assert place.tolist() == [0, 0, 2, 2, -1] and crosses.tolist() == [False, True, True, False, False]


def test_given_sections(spark):
    from proofloom.llm.tokens import section_tokens

    rows = [(1, "Title here and éé body", [("title", 0, 5), ("body", 15, 22)]), (2, "x", None), (3, None, [("a", 0, 9)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, sections array<struct<section string, first int, end int>>")
    found = {(r.doc_id, r.section): r.n_tokens for r in section_tokens(df).collect()}
    total = [len(i) for i in ids_of([r[1] for r in rows])]
    assert found[(1, "title")] == 1 and sum(v for k, v in found.items() if k[0] == 1) == total[0]
    assert found[(2, None)] == 1 and found[(3, "a")] == 0


def brute_sections(rows):
    """(doc_id, section) -> tokens, crossing tokens: each token of a whole encoding goes to the section with most of its bytes, of equals the first."""
    from tokenizers import Tokenizer

    from proofloom.llm.tokens import default_vocabulary

    library, out = Tokenizer.from_file(default_vocabulary()), Counter()
    crossing = Counter()
    for d, text, sections in rows:
        text = text or ""
        at = [len(text[:i].encode()) for i in range(len(text) + 1)]
        spans, done = [], 0
        for first, end, k in sorted((s[1], s[2], k) for k, s in enumerate(sections or []) if s and s[1] is not None and s[2] is not None):
            end = max(done, min(end, len(text)))
            spans.append((at[min(max(first, done), end)], at[end], sections[k][0]))
            done = end
            out[d, sections[k][0]] += 0
        begin = 0
        encoded = library.encode(text, add_special_tokens=False)
        for token in encoded.tokens:
            end = begin + len(token)  # a character of a byte-level token stands for a byte
            shares = [max(0, min(end, b) - max(begin, a)) for a, b, _ in spans]
            best = max(range(len(spans)), key=lambda i: (shares[i], -i)) if any(shares) else None
            out[d, spans[best][2] if best is not None else None] += 1
            crossing[d, spans[best][2] if best is not None else None] += sum(x > 0 for x in shares) > 1
            begin = end
        if not spans:
            out[d, None] += 0
    return {k: (v, crossing[k]) for k, v in out.items()}


def test_section_tokens_against_brute_force(spark):
    from proofloom.llm.tokens import section_tokens

    rnd = random.Random(11)
    rows = [(1, "abc def", [None, ("a", None, 3), ("b", 4, None)]), (2, "overlap of sections here", [("x", 0, 12), ("y", 8, 30), ("z", 3, 5)]), (None, "no id", [("k", 0, 2)])]
    for d in range(3, 40):
        text = "".join(rnd.choice(["über", "token", " ", "\n", "🙂", "12"]) for _ in range(rnd.randint(0, 30)))
        bounds = sorted(rnd.randint(0, len(text) + 3) for _ in range(2 * rnd.randint(0, 4)))
        rows.append((d, text, [(f"s{i}", bounds[2 * i] - rnd.randint(0, 1), bounds[2 * i + 1]) for i in range(len(bounds) // 2)]))
    rows = [(d, t, [s if s is None or s[1] is None else (s[0], max(s[1], 0), s[2]) for s in own]) for d, t, own in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, sections array<struct<section string, first int, end int>>")
    found = Counter(), Counter()
    for r in section_tokens(df.withColumn("n_tokens", F.lit("x"))).collect():
        found[0][r.doc_id, r.section] += r.n_tokens
        found[1][r.doc_id, r.section] += r.n_crossing
    assert {k: (v, found[1][k]) for k, v in found[0].items()} == brute_sections(rows)
    strings = section_tokens(spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, sections string")).collect()
    assert [(r.section, r.n_tokens) for r in strings] == [("0", 2)]
    assert section_tokens(df.limit(0)).count() == 0


def test_other_vocabularies_get_whole_texts():
    import os

    from proofloom.llm import tokens
    from proofloom.llm.words import pieces

    path = os.path.join(os.path.dirname(tokens.default_vocabulary()), "word_bpe_49k.json")
    encoder = tokens.Encoder(path)
    texts = ["Ein Text, don't!  äöü 🙂", "", "zwei  Wörter\n"]
    from tokenizers import Tokenizer

    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    (_, _, data, off), *_ = pieces(pa.array(texts))
    ids, at, n = encoder.encode(data, off)
    ends = np.cumsum(n)
    assert [ids[e - k : e].tolist() for e, k in zip(ends.tolist(), n.tolist(), strict=True)] == want
    assert tokens.Encoder(tokens.default_vocabulary()).by_word and (np.diff(at) >= 0).all()
    plain = {"pre_tokenizer": {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}, "model": {"type": "BPE"}}
    assert tokens.splits_by_word(plain) and not tokens.splits_by_word(plain | {"normalizer": {"type": "NFC"}})


# ---- 2: media


def test_media_columns(docs, rows, empty):
    from proofloom.llm.media import media_columns, read_file

    found = media_columns(docs).collect()
    assert len(found) == len(rows)
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    shards = {s: read_file(s) for s in {r.shard for r in found}}
    for r in found:
        data = texts[r.doc_id]
        payload = data + b" " * (-len(data) % 192 if data else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = shards[r.shard][r.payload_sha256 + ".png"]
        assert (r.media_bytes, r.media_sha256, r.width, r.height) == (len(stored), hashlib.sha256(stored).hexdigest(), 192, len(payload) // 192)
    assert len({(r.payload_sha256, r.feature, r.shard, r.offset) for r in found}) == len({r.payload_sha256 for r in found})
    assert media_columns(empty).count() == 0


# ---- 3: mixing


def test_mix(docs, rows, empty):
    from proofloom.llm.mixing import Mixing, mix

    mixed, sized, goals = mix(docs, Mixing(block=64, span_rows=7))
    mixed = mixed.collect()
    size = {r[0]: len(words(r[1])) for r in rows}
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in mixed:
        taken[r.doc_id] += r.n
        assert 0 <= r.first and r.first + r.n <= size[r.doc_id] and r.source == source[r.doc_id]
    assert all(taken[d] <= 2 * size[d] for d in size)
    goals = {g.source: g for g in goals.collect()}
    order = [*sorted(s for s in set(source.values()) if s is not None), None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(size.values()), set(order), {}
    while True:  # as the rule is told: stop those above, share the rest out again
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * goals[s].source_size}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * goals[s].source_size
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    for s in order:
        assert goals[s].target == pytest.approx(target[s])
        assert abs(sum(taken[d] for d in size if source[d] == s) - target[s]) <= 1
    half = [r.source for r in sorted(mixed, key=lambda r: r.slot)][: len(mixed) // 2]
    assert set(half) == set(order)
    again = mix(docs.repartition(5), Mixing(block=64, span_rows=7))[0]
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, mixed), key=str)
    assert mix(empty)[0].count() == 0


# ---- 4: repeats


def without_repeats(rows, k=13):
    first = {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            first[g] = min(first.get(g, d), d)
    out = {}
    for d, t, *_ in rows:
        w = words(t)
        gone = {i + j for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] < d for j in range(k)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), kept)
    return out


@pytest.mark.parametrize("batch,bucket,fan", [(4 << 20, 20 << 20, 4096), (600, 2000, 4096), (600, 2000, 4)])
def test_remove_repeats(docs, rows, empty, batch, bucket, fan):
    from proofloom.llm.repeats import Repeats, remove_repeats

    cfg = Repeats(batch_bytes=batch, bucket_bytes=bucket, fan=fan)
    clashing = docs.withColumn("n_words", F.lit("x")).withColumn("extra", F.struct(F.lit(1).alias("my-f")))
    found = remove_repeats(clashing, cfg)
    assert "extra" in found.columns and found.columns.count("n_words") == 1
    assert as_dict(found, "n_words", "n_removed", "kept_text") == without_repeats(rows)
    assert remove_repeats(empty, cfg).count() == 0


def test_repeats_of_repeated_and_null_ids(spark):
    from proofloom.llm.repeats import remove_repeats

    t = " ".join(f"w{i}" for i in range(40))
    rows = [(1, t), (1, t), (2, "x " + t), (None, t)]
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in found) == [("1", 0), ("1", 0), ("2", 40), ("None", 0)]


@pytest.mark.parametrize("batch,bucket,fan", [(4 << 20, 20 << 20, 4096), (300, 400, 2)])
def test_repeats_of_several_texts_under_one_id(spark, batch, bucket, fan):
    """Only the row that repeats a passage loses it, and rows of one doc_id are not earlier than each other."""
    from proofloom.llm.repeats import Repeats, remove_repeats

    rnd = random.Random(9)
    some = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    t = some(20)
    rows = [(1, t), (2, t), (2, some(30)), (2, None)]
    passages = [some(rnd.randint(13, 40)) for _ in range(4)]
    for _ in range(60):
        rows.append((rnd.randint(1, 12), " ".join(rnd.choice([rnd.choice(passages), some(rnd.randint(1, 20))]) for _ in range(rnd.randint(1, 4)))))
    first = {}
    for d, x in rows:
        w = words(x)
        for i in range(len(w) - 12):
            first[tuple(w[i : i + 13])] = min(first.get(tuple(w[i : i + 13]), d), d)
    want = []
    for d, x in rows:
        w = words(x)
        gone = {i + j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(13)}
        want.append((d, len(w), len(gone), " ".join(v for i, v in enumerate(w) if i not in gone)))
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), Repeats(batch_bytes=batch, bucket_bytes=bucket, fan=fan))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found.collect()) == sorted(want)
    assert (2, 30, 0) in {w[:3] for w in want}


# ---- 5: packing


def test_pack(docs, rows, empty):
    from proofloom.llm.packing import Packing, best_fit, pack

    found = pack(docs, Packing(capacity=100, block=16)).collect()
    by_bin = {}
    for r in found:
        if r.bin is not None:
            by_bin.setdefault(r.bin, []).append(r)
    source, text = {r[0]: r[3] for r in rows}, {r[0]: r[1] for r in rows}
    for own in by_bin.values():
        own.sort(key=lambda r: r.offset)
        assert own[-1].offset + own[-1].n_words <= 100
        assert all(a.offset + a.n_words == b.offset for a, b in zip(own, own[1:], strict=False))
        assert len({source[r.doc_id] for r in own}) == len(own) == len({text[r.doc_id] for r in own})
    for d, t in text.items():
        own = sorted((r for r in found if r.doc_id == d), key=lambda r: r.piece)
        assert sum(r.n_words for r in own) == len(words(t))
        assert [r.first for r in own] == [100 * i for i in range(len(own))]
    assert best_fit([6, 5, 4, 4, 3], [0, 1, 0, 2, 3], [0, 1, 2, 3, 3], 10) == [(0, 0), (1, 0), (1, 5), (0, 6), (2, 0)]
    assert pack(empty).count() == 0


# ---- 6: quality rules


def measured(t):
    t, w = t or "", words(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    n = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
    return (*n, len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_rules(docs, rows, empty):
    from proofloom.llm.quality_rules import keep_good, quality

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    found = quality(docs.withColumn("kept", F.lit(7)))
    assert as_dict(found, *names) == {r[0]: measured(r[1]) for r in rows}
    kept = {r.doc_id for r in found.where("kept").collect()}
    assert kept == {r.doc_id for r in keep_good(docs).collect()} and kept
    assert quality(empty).count() == 0


def test_quality_rules_reject_junk_and_stay_native(spark):
    from proofloom.llm.quality_rules import quality, rules

    rnd = random.Random(1)
    good = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(200))
    junk = [good.upper(), " ".join(w + "###" for w in good.split()), " ".join("12345678" for _ in good.split()), "\n".join([" ".join(good.split()[:20])] * 3 + good.split())]
    df = quality(spark.createDataFrame([(0, good), *enumerate(junk, 1)], "doc_id long, text string"))
    kept = as_dict(df, "kept")
    assert kept[0] == (True,) and not kept[1][0] and not kept[2][0] and not kept[3][0]
    from proofloom.llm.quality_rules import QualityRules, measure

    every = measure(spark.createDataFrame([(0, good)], "doc_id long, text string")).select(*rules(QualityRules()).values())
    for plan in (x._jdf.queryExecution().executedPlan().toString() for x in (df, every)):
        assert "Python" not in plan and "Arrow" not in plan and len(rules.__doc__) > 0


# ---- 7: near duplicates


def brute_components(rows, percent=85, k=5):
    sets = {}
    for d, t, *_ in rows:
        w = words(t, lower=True)
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    comp = {d: d for d in sets}
    ids = list(sets)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(comp[a], comp[b])
            if (comp[a], comp[b]) != (m, m):
                comp[a] = comp[b] = m
                changed = True
    return {d: (len(s), comp[d], comp[d] == d) for d, s in sets.items()}


@pytest.mark.parametrize("percent,block", [(85, 1024), (60, 2)])
def test_near_duplicates(docs, rows, empty, percent, block):
    from proofloom.llm.near_dup import NearDup, near_duplicates

    cfg = NearDup(percent=percent, block=block, group=3)
    assert as_dict(near_duplicates(docs, cfg), "n_shingles", "component_id", "kept") == brute_components(rows, percent)
    assert near_duplicates(empty, cfg).count() == 0


def test_near_duplicates_in_one_large_mixed_group(spark):
    from proofloom.llm.near_dup import NearDup, near_duplicates

    rnd = random.Random(9)
    base, rows = [f"w{i}" for i in range(120)], []
    for d in range(150):  # a chain of growing edits: neighbours are linked, ends are not
        if d % 3 == 0:
            base[rnd.randrange(len(base))] = f"n{d}"
        rows.append((d, " ".join(base[: 120 - d % 7])))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_dict(near_duplicates(df, NearDup(block=16, group=8)), "n_shingles", "component_id", "kept") == brute_components(rows)


def test_registers_merge_and_estimate():
    from proofloom.llm.near_dup import NearDup, likely, registers

    cfg = NearDup()
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 2**63, 1000, dtype=np.uint64) for _ in range(2))
    union = np.concatenate((a, b))
    r = registers(np.concatenate((a, b, union)), np.array([0, 1000, 2000, 4000]), cfg)
    assert (np.maximum(r[0], r[1]) == r[2]).all()
    near = registers(np.concatenate((a, np.concatenate((a[:960], b[:40])), b)), np.array([0, 1000, 2000, 3000]), cfg)
    n = np.array([1000.0])
    assert likely(near[:1], near[1:2], n, n, cfg)[0] and not likely(near[:1], near[2:3], n, n, cfg)[0]


# ---- 9: urls


def test_url_rules(spark):
    from proofloom.llm.url_rules import host_path, judge

    urls = ["https://A.example.org/es/1?q=/x#y", "http://org/fr", "ftp://borg/", "https://x.com/fr/9", "https://x.com/de/9", "https://example.org/en/12", "nothing", None, "http://h.net", "a://b://c/d", "http://spam.net/ads/1.html?id=2"]
    found = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    urls += [f"http://spam.net/ads/{i}.html" for i in range(6)] + [f"http://fine.net/text/{i}.html" for i in range(8)]
    found = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int("spam.net" not in (u or "")), 0) for i, u in enumerate(urls)], "doc_id long, quality int, toxic int")
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(found.withColumn("rule", F.lit(1)), labels).collect()}
    assert rows[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert rows[1] == ("org", "/fr", "org/", "allow") and rows[2][2] is None
    assert rows[3][2:] == ("com/fr/", "allow") and rows[4][2:] == ("com/de/", "block") and rows[5][2:] == ("example.org/en/1", "block")
    assert rows[6][:3] == ("", "", None) and rows[7][:3] == ("", "", None) and rows[8][:2] == ("h.net", "")
    assert rows[9][:2] == ("b:", "//c/d") and rows[10][3] == "block"
    assert rows[11][3] == "block" and rows[17][3] == "allow"
    none = judge(found.limit(0), labels.limit(0))
    assert none.count() == 0 and host_path


def lower_end(k, n, z):
    p = k / n
    return (p + z * z / 2 / n - z * (p * (1 - p) / n + z * z / 4 / n / n) ** 0.5) / (1 + z * z / n)


def test_mined_verdicts_of_planted_labels(spark):
    """Verdicts of a table with a planted signal against a plain count of all combinations of each page's tokens; most labels are by chance."""
    from itertools import combinations

    from proofloom.llm.url_rules import UrlFilter, host_path, judge, url_tokens

    rnd = random.Random(12)
    hosts, words_ = [f"h{i}.net" for i in range(40)], ["ads", "win", "text", "news", "de", "fr"]
    urls = [f"http{rnd.choice(['', 's'])}://{rnd.choice(hosts)}/{rnd.choice(words_)}/{rnd.choice(words_)}/{rnd.randrange(10**6)}.html" for _ in range(3000)]
    planted = lambda u: 0.75 if "/ads/" in u and "/win/" in u else 0.4 if "h7." in u else 0.12
    quality = [int(rnd.random() > planted(u)) for u in urls]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, q) for i, q in enumerate(quality) if i < 2500], "doc_id long, quality int")
    cfg = UrlFilter(listed=())
    tokens = {r.page_id: r.t for r in pages.select("page_id", url_tokens(F.col("url"), *host_path(F.col("url"))).alias("t")).collect()}
    n, rejected = 2500, sum(1 - q for q in quality[:2500])
    counts, bad = Counter(), Counter()
    for i in range(2500):
        for k in (1, 2, 3, 4, 5, 6, 7):  # no page has more than the basket
            for c in combinations(sorted(tokens[i]), k):
                counts[c] += 1
                bad[c] += 1 - quality[i]
    assert max(map(len, tokens.values())) <= cfg.basket
    rules = {c for c, m in counts.items() if bad[c] >= max(cfg.min_pages, cfg.min_support * n) and lower_end(bad[c], m, cfg.errors) >= cfg.min_lift * rejected / n}
    want = {i: any(set(r) <= set(t) for r in rules) for i, t in tokens.items()}
    found = {r.page_id: r for r in judge(pages, labels, cfg).collect()}
    assert {i: r.mined for i, r in found.items()} == want
    assert {i: r.verdict for i, r in found.items()} == {i: "block" if x else "allow" for i, x in want.items()}
    assert all(want[i] for i, u in enumerate(urls) if "/ads/" in u and "/win/" in u) and sum(want.values()) < 600


def test_url_rules_ask_for_pages_and_stay_short(spark):
    """One page's many tokens make no rules, many pages' many tokens make bounded ones, and rules hold what they say."""
    from proofloom.llm.url_rules import UrlFilter, judge, mine, url_tokens

    query = "&".join(f"n{i}=1" for i in range(14))
    urls = [f"http://a{i}.org/x" for i in range(20)] + [f"http://once.org/y?{query}"] + [f"http://many.org/z?{query}" for _ in range(7)]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(3, urls[3], "x"), (None, "http://b.org/" + "w/" * 5000, "x")], "page_id long, url string, mined string")
    labels = spark.createDataFrame([(i, int(i < 20), 0) for i in range(28)] + [(3, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    cfg = UrlFilter()
    rules, on_pages = mine(pages, labels, cfg)
    assert rules and all(len(r) <= cfg.basket for r in rules) and not any("once" in t for r in rules for t in r)
    host, path = F.col("host"), F.col("path")
    tokens = {r.page_id: set(r.t) for r in judge(pages, labels).join(pages.select("page_id", "url"), "page_id").select("page_id", url_tokens(F.col("url"), host, path).alias("t")).collect()}
    for r in rules:
        fit = [i for i, t in tokens.items() if set(r) <= t]
        assert len(fit) >= cfg.min_pages and lower_end(sum(i >= 20 for i in fit), len(fit), cfg.errors) >= cfg.min_lift * 8 / 28
        assert not any(set(x) < set(r) for x in rules)
    assert judge(pages, labels).count() == len(urls) + 2


# ---- 10: quality model


def test_quality_model(spark, sf):
    from proofloom.llm.quality_model import score_quality

    docs, labels = (spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    found = score_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    good, bad = ([r.score for r in found if r.quality == q] for q in (1, 0))
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert auc > 0.95 and np.mean([r.predicted == r.quality for r in found]) > 0.9


def test_quality_model_of_odd_tables(docs, rows, empty, spark):
    from proofloom.llm.quality_model import score_quality

    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 0), (6, None, 0), (None, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    found = score_quality(docs.withColumn("score", F.lit(2)), labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert score_quality(empty, labels).count() == 0


def test_url_rules_of_long_pages_lose_no_token(spark):
    """Rejected by a pair of tokens that tell little alone, on pages of 30 other tokens that all tell more or are always together."""
    from proofloom.llm.url_rules import UrlFilter, judge, mined_rules

    shared = "&".join(f"q{i:02d}=1" for i in range(20))
    some = lambda i: [f"s{k}" for k in range(10) if (i + k) % 10 < 3]
    rows = [(i, i % 2, i // 2 % 2) for i in range(400)]
    url = lambda i, a, b: "http://h.org/" + "/".join([*(["a"] if a else []), *(["b"] if b else []), *some(i // 4)]) + f"/?{shared}"
    pages = spark.createDataFrame([(i, url(i, a, b)) for i, a, b in rows] + [(1000, "http://else.net/a/b/x"), (1001, "http://else.net/a/x")], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not (a and b))) for i, a, b in rows], "doc_id long, quality int")
    cfg = UrlFilter(listed=(), basket=3, min_lift=3.0)
    rules, _, stands = mined_rules(pages, labels, cfg)
    assert ["path:a", "path:b"] in rules and len(stands) < 40
    mined = {r.page_id: r.mined for r in judge(pages, labels, cfg).collect()}
    assert all(mined[i] == bool(a and b) for i, a, b in rows) and mined[1000] and not mined[1001]


def test_url_tokens_on_the_same_pages_stand_for_each_other(spark):
    from proofloom.llm.url_rules import UrlFilter, judge, mined_rules

    words_ = [f"w{i:02d}" for i in range(24)]
    urls = [f"http://a{i}.org/x" for i in range(60)] + ["http://b.org/" + "/".join(words_) + f"/{i}" for i in range(20)] + ["http://c.org/w23/y", "http://c.org/y"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(80)], "doc_id long, quality int")
    rules, _, stands = mined_rules(pages, labels, UrlFilter(listed=()))
    assert len(rules) == 1 and len({stands[f"path:{w}"] for w in words_}) == 1
    mined = {r.page_id: r.mined for r in judge(pages, labels, UrlFilter(listed=())).collect()}
    assert {i for i, x in mined.items() if x} == {*range(60, 80), 80}
