"""Views by policy, refused requests, summaries of the most frequent items that merge."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from proofloom.operators import topk as K
from proofloom.operators import views as W

POLICY = W.Policy(admitted={"a": ("identification", "verdict"), "b": ("identification",), "none": ()}, shown={"read": ("verdict", "audit", "identification"), "log": ("history", "activity")})


def content():
    return {"identification": {"name": F.col("name")}, "verdict": {"verdict": F.col("verdict"), "why": F.col("why")}, "audit": {"who": F.col("who")}}


def test_columns_that_nobody_may_see_are_not_read(spark, tmp_path):
    rows = [(1, "n1", "ok", "w1", "x", "a"), (2, "n2", "no", "w2", "y", "b"), (3, "n3", "no", None, "z", "none")]
    spark.createDataFrame(rows, "k int, name string, verdict string, why string, who string, role string").write.parquet(str(tmp_path / "cases"))
    df = spark.read.parquet(str(tmp_path / "cases"))
    scan = lambda v: v._jdf.queryExecution().executedPlan().toString().split("ReadSchema:")[1].split("\n")[0]
    one = W.view(df, ["k"], POLICY, "read", "b", content())
    assert one.columns == ["k", "identification"] and "verdict" not in scan(one) and "who" not in scan(one)
    assert W.view(df, ["k"], POLICY, "read", "none", content()).columns == ["k"]
    each = W.view(df, ["k"], POLICY, "read", F.col("role"), content())
    assert each.columns == ["k", "verdict", "identification"] and "who" not in scan(each)  # audit: nobody
    found = {r.k: r for r in each.collect()}
    assert tuple(found[1].verdict) == ("ok", "w1") and found[2].verdict is None and found[2].identification.name == "n2" and found[3].identification is None
    with pytest.raises(ValueError, match="has no content"):
        W.view(df, ["k"], POLICY, "read", "a", {})
    with pytest.raises(ValueError, match="no such blocks"):
        W.Policy(admitted={"a": ("secrets",)}, shown={})
    assert len(W.BLOCKS) == len(set(W.BLOCKS)) == 13


def test_log_blocks(spark):
    events = spark.createDataFrame([(1, "x", "secret")], "k int, kind string, payload string")
    policy = W.Policy(admitted={"a": ("history", "activity"), "b": ("activity",)}, shown={"log": ("history", "activity", "audit")})
    assert [tuple(r) for r in W.log_view(events, ["k"], policy, "log", "a", "history", "payload").collect()] == [(1, "x", "secret")]
    assert W.log_view(events, ["k"], policy, "log", "b", "history", "payload").count() == 0
    assert W.log_view(events, ["k"], policy, "log", "b", "activity", "payload").columns == ["k", "kind"]


def test_the_first_check_that_fails_counts(spark):
    caps = [W.Capability("c", "read", ("a", "p")), W.Capability("d", "command", ("a",)), W.Capability("e", "read", ("a",), implemented=False), W.Capability("j", "read", ("a",), justified=True)]
    rows = [
        ("c", "a", None, "1.5", True, None, None), ("x", "a", None, None, True, None, "unknown capability"), (None, "a", None, None, True, None, "unknown capability"), ("d", "a", None, None, True, None, "not a read"),
        ("c", "b", None, None, True, None, "not granted"), ("c", None, None, None, True, None, "not granted"), ("c", "a", None, None, False, None, "other tenant"), ("c", "a", None, None, None, None, "other tenant"),
        ("c", "p", None, None, True, None, "not a party"), ("c", "p", None, None, True, True, None), ("e", "a", None, "1e3", True, None, "not implemented"), ("c", "a", None, "1e3", True, None, "binary fraction"),
        ("c", "a", None, "0.1000000000000000055", True, None, "binary fraction"), ("j", "a", " ", None, True, None, "no reason"), ("j", "a", "so", None, True, None, None),
    ]
    df = spark.createDataFrame(rows, "capability string, role string, reason string, number_text string, own boolean, party boolean, want string")
    found = W.prepared(df, caps, "read", F.col("own"), (), ("p",), F.col("party")).collect()
    assert [r.refused for r in found] == [r.want for r in found]


@pytest.mark.parametrize("most", [2, 5, 100])
def test_counts_lie_within_the_bounds_of_merged_summaries(spark, most):
    rnd = random.Random(most)
    rows = [(rnd.choice("xyz"), rnd.randrange(6), f"i{int(rnd.paretovariate(0.6)) % 40}") for _ in range(4000)] + [(None, 1, "i1"), ("x", None, "i1"), ("x", 1, None)]
    df = spark.createDataFrame(rows, "a string, b int, item string")
    fine = K.summaries(df, ["a", "b"], "item", most)
    coarse = K.merged(fine, ["a"], "item", most)
    one = K.merged(coarse.withColumn("all", F.lit(1)), ["all"], "item", most)
    exact = Counter((a, i) for a, _, i in rows if i)
    seen = set()
    for r in coarse.collect():
        assert len(r["items"]) <= most
        for x in r["items"]:
            assert x.low <= exact[r.a, x.item] <= x.high
            seen.add((r.a, x.item))
        assert all(n <= r.floor for (a, i), n in exact.items() if a == r.a and (a, i) not in seen)
    total = Counter(i for _, _, i in rows if i)
    top = K.top(one, ["all"], "item", 3).collect()
    assert all(r.low <= total[r.item] <= r.high for r in top)
    if most == 100:
        want = sorted(total, key=lambda i: (-total[i], i))[:3]
        assert [(r.place, r.item, r.low, r.high) for r in top] == [(k + 1, i, total[i], total[i]) for k, i in enumerate(want)]
