"""An index that follows changes gives what an index written anew gives."""

import random

from pyspark.sql import functions as F

from mnemolake.engine import Engine
from mnemolake.operators import search as S
from mnemolake.operators.segments import SegmentedIndex
from mnemolake.schema import MEMORIES

NOW = "2024-02-01 00:00:00"


def memories(spark, rows):
    base = {"topic": "notes", "summary": "", "keywords": [], "importance": "medium", "weight": 1.0, "access_count": 0}
    return spark.createDataFrame([tuple({**base, **r}.get(n) for n in MEMORIES.fieldNames()) for r in rows], MEMORIES)


def hits(index):
    return sorted((r["id"], round(r["rank"], 9)) for r in index.hits([["red"], ["fish", "swim"]], True).collect())


def anew(spark, rows, folder):
    S.TextIndex.write(rows, "id", F.col("t"), folder)
    return hits(S.TextIndex.open(spark, folder))


def test_changes_equal_a_rebuilt_index(spark, tmp_path):
    r = random.Random(1)
    text = lambda: " ".join(r.choices(["red", "fish", "swim", "blue", "x"], k=r.randint(0, 8)))
    df = lambda d: spark.createDataFrame(sorted(d.items()), "id string, t string")
    state = {str(i): text() for i in range(60)}
    index = SegmentedIndex.create(df(state), F.col("t"), str(tmp_path / "i"), "base")
    for step in range(6):
        ids = r.sample(sorted(state), 5)
        before = {i: state[i] for i in ids}
        after = {i: text() for i in ids[:3]} | {f"n{step}": text()}
        state = {i: t for i, t in state.items() if i not in before} | after
        index = index.apply(df(before), df(after))
        want = anew(spark, df(state), str(tmp_path / f"a{step}"))
        assert hits(index) == want
        if step % 2:
            index = index.flush()
            assert hits(index) == want and len(index.segments[-1:]) and index.segments[-1].size == 4
    index = index.tidy().flush()
    assert hits(index) == want and len(index.segments) < 7
    again = SegmentedIndex.open(spark, F.col("t"), str(tmp_path / "i"))
    assert hits(again) == want and hits(again.compact(1)) == want and hits(again.compact().apply(df(state), None)) == []
    assert len(SegmentedIndex.open(spark, F.col("t"), str(tmp_path / "i"), "base").segments) == 1
    again = again.compact()
    again.vacuum()
    assert hits(SegmentedIndex.open(spark, F.col("t"), str(tmp_path / "i"))) == want


def test_engine_keeps_its_index(spark, tmp_path):
    root = str(tmp_path)
    rows = [{"id": str(i), "summary": "red fish" if i % 2 else "blue fish swim", "topic": "t" if i < 3 else "notes"} for i in range(8)]
    e = Engine(spark, NOW, {"memories": memories(spark, rows)}).build_indexes(root)
    e = e.update("1", summary="green").forget("3").invalidate("5").store(memories(spark, [{"id": "n", "summary": "red red fish"}])).decay(48).consolidate("t")
    want = sorted((r["id"], round(r["rank"], 9)) for r in S.fts(e.table("memories"), "red fish", include_invalidated=True).collect())
    got = lambda e: sorted((r["id"], round(r["rank"], 9)) for r in S.fts(e.table("memories"), "red fish", include_invalidated=True, index=e.indexes["memories"]).collect())
    assert got(e) == want and len(want) >= 3
    e.commit(root)
    assert got(Engine.open(spark, root, NOW)) == want
    assert "memories" not in e.having(memories=e.table("memories").limit(1)).indexes


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "id string, t string")
    index = SegmentedIndex.create(none, F.col("t"), str(tmp_path / "i"))
    assert hits(index) == []
    assert len(hits(index.apply(None, spark.createDataFrame([("a", "red"), ("b", ""), ("c", None)], "id string, t string")))) == 1
    assert SegmentedIndex.open(spark, F.col("t"), str(tmp_path / "none")) is None
