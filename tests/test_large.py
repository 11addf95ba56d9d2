"""What large tables need: the work of a query follows from its rows, not from how many groups or other queries there are."""

import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from mnemolake import plans  # noqa: F401  (fills the registry)
from mnemolake.operators import evaluation as E
from mnemolake.operators import search as S
from mnemolake.plans import registry

SF = "/root/testdata/sf0.001"


def by_lists(old, new, span):
    """Ids that a walk through both lists of a key leaves, times in seconds."""
    left = []
    for k in {k for k, _, _ in old}:
        news, j = sorted(t for x, t in new if x == k and t is not None), 0
        for t, i in sorted((t, i) for x, t, i in old if x == k and t is not None):
            while j < len(news) and t - news[j] >= span:
                j += 1
            if j < len(news) and news[j] - t < span:
                j += 1
            else:
                left.append(i)
    return sorted(left + [i for _, t, i in old if t is None])


def test_unmatched_walks_many_islands_in_a_task(spark):
    r = random.Random(4)
    keys = [None, *[(p, s) for p in ("a", "b", None) for s in ("x", None)], *[("k", str(n)) for n in range(300)]]
    flat = lambda k: k or (None, None)
    at = lambda k: None if r.random() < 0.02 else r.choice([r.randint(0, 60), r.randint(0, 5000)])
    old = [(flat(k), at(k), f"i{n}") for n, k in enumerate(r.choices(keys, k=1500) + keys[:7] * 40)]
    new = [(flat(k), at(k)) for k in r.choices(keys, k=1200) + keys[:7] * 40]
    row = lambda x: x.withColumn("at", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s")
    olds = row(spark.createDataFrame([(*k, t, i) for k, t, i in old], "p string, q string, s long, id string"))
    news = row(spark.createDataFrame([(*k, t) for k, t in new], "p string, q string, s long"))
    for tolerance in (3, 40):
        got = E.unmatched(olds, news, ["p", "q"], tolerance)
        assert sorted(x[0] for x in got.collect()) == by_lists(old, new, tolerance + 1)
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(_unit#" in x]
    assert sorted("Reused" in x for x in dealt) == [False, True], "rows are dealt out once for their order, the table of slots and the join"


def test_rows_that_wait_are_dropped_once_the_tolerance_has_passed():
    import pyarrow as pa

    held = []

    def batches():
        for n in range(40):
            t = pa.array(range(n * 1000, n * 1000 + 1000), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([False] * 1000), t, pa.array([n // 20] * 1000), pa.array([str(x.as_py()) for x in t])], ["first", "t", "old", "id"])

    for b in E._walk(10)(batches()):
        held.append(b.num_rows)
    assert held[:20] == [0] * 20, "structured rows aren't given out"
    assert held[20] == 981 and set(held[21:40]) == {1000} and held[40] == 10, "legacy rows come out as the time goes on"


WORDS = ["red", "Red", "fish", "redfish", "blue", "épée", "e", "2", "x1", "straße", "鱼", "𝟙", "😀"]


def test_matching_is_bm25_without_ranks(spark):
    r = random.Random(5)
    texts = ["".join(w + r.choice([" ", "  ", "-", "_", "\n", "́", ".", "/", ""]) for w in r.choices(WORDS, k=r.randint(0, 7))) for _ in range(400)]
    rows = spark.createDataFrame([(str(n), t) for n, t in enumerate([*texts, None, ""])], "id string, t string")
    for phrases in ([["red"]], [["red"], ["fish"]], [["red", "fish"]], [["épée"], ["x1", "e"]], [["鱼"]], [["2"], ["red", "2", "fish"]], [["straße"], ["none"]], []):
        for any_of in (False, True):
            got = S.matching(rows, F.col("t"), phrases, any_of)
            assert got.columns == rows.columns
            want = S.bm25(rows, F.col("t"), phrases, any_of)
            assert sorted(got.collect()) == sorted(want.drop("rank").collect()), (phrases, any_of)
    plan = S.matching(rows, F.col("t"), [["red"], ["fish"]])._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "Aggregate" not in plan and "Join" not in plan


def test_counts_answer_for_their_phrases(spark):
    r = random.Random(6)
    rows = spark.createDataFrame([(str(n), " ".join(r.choices(WORDS, k=r.randint(0, 9)))) for n in range(200)], "id string, t string")
    for phrases, any_of in (([["red"], ["fish"]], False), ([["red", "fish"], ["2"]], True)):
        want = {}
        docs = {x["id"]: re.findall(r"[^\W_]+", x["t"].lower()) for x in rows.collect()}
        often = lambda d, p: sum(d[i : i + len(p)] == p for i in range(len(d)))
        held = [sum(often(d, p) > 0 for d in docs.values()) for p in phrases]
        mean = sum(map(len, docs.values())) / len(docs)
        for k, d in docs.items():
            f = [often(d, p) for p in phrases]
            if (any if any_of else all)(f):
                want[k] = -sum(max(math.log((len(docs) - h + 0.5) / (h + 0.5)), S.LEAST_IDF) * x * (S.K1 + 1) / (x + S.K1 * (1 - S.B + S.B * len(d) / mean)) for x, h in zip(f, held, strict=True))
        counts = S.Counts.of(rows, F.col("t"), phrases, ["id"])
        got = {x["id"]: x["rank"] for x in S.bm25(rows, F.col("t"), phrases, any_of, counts).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    with pytest.raises(ValueError):
        S.bm25(rows, F.col("t"), [["blue"]], index=counts)


def test_rrf_expanded_writes_no_index(spark, monkeypatch):
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    monkeypatch.setattr(registry, "_STORED", {})
    assert registry.QUERIES["rrf_expanded"](spark, SF).count() == 6
    assert not registry._STORED, "an index of all words costs far more than the one query that reads it"
