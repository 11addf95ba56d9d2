"""Micro-fixtures with known results, and invariants."""

import pytest
from pyspark.sql import functions as F

from mnemolake.functions import text as X
from mnemolake.operators import chunking as C
from mnemolake.operators import evaluation as E
from mnemolake.operators import feedback as FB
from mnemolake.operators import graph as G
from mnemolake.operators import search as S
from mnemolake.operators import transcripts as TR
from mnemolake.operators import transitions as T
from mnemolake.schema import MEMORIES, unit

NOW = "2024-02-01 00:00:00"


def memories(spark, rows):
    base = {"topic": "notes", "summary": "", "keywords": [], "importance": "medium", "weight": 1.0, "access_count": 0}
    names = MEMORIES.fieldNames()
    return spark.createDataFrame([tuple({**base, **r}.get(n) for n in names) for r in rows], MEMORIES)


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_decay_order_access_and_floor(spark):
    m = memories(spark, [{"id": "h", "importance": "high"}, {"id": "m"}, {"id": "l", "importance": "low"}, {"id": "c", "importance": "critical"}, {"id": "a", "access_count": 10}])
    w = dict(values(T.decay(m, 0.9), "id", "weight"))
    assert {k: round(v, 9) for k, v in w.items()} == {"h": 0.95, "m": 0.9, "l": 0.8, "c": 1.0, "a": 0.95}
    low = memories(spark, [{"id": "l", "importance": "low", "weight": 0.1}])
    assert values(T.decay(low, 0.0), "weight") == [(0.0,)]
    assert T.auto_decay(m, 3) is m


def test_prune_keeps_important_and_invalidated(spark):
    m = memories(spark, [{"id": i, "importance": k, "weight": 0.05} for i, k in (("c", "critical"), ("h", "high"), ("m", "medium"), ("l", "low"))])
    assert {r[0] for r in values(T.prune(m, 0.1), "id")} == {"c", "h"}


def test_constructor_clamps(spark):
    x = spark.sql("SELECT * FROM VALUES (2.0D), (-1.0D), (CAST('NaN' AS DOUBLE)), (NULL) AS v(x)")
    assert [r[0] for r in x.select(unit(F.col("x"), 1.0)).collect()] == [1.0, 0.0, 0.5, 1.0]


def test_bm25_known_value(spark):
    import math

    rows = spark.createDataFrame([("a", "red fish"), ("b", "blue fish swim"), ("c", "green grass grows"), ("d", "x y z"), ("e", "k l")], "id string, t string")
    got = dict(values(S.bm25(rows, F.col("t"), [["red"]]), "id", "rank"))
    avg = (2 + 3 + 3 + 3 + 2) / 5
    assert got == {"a": pytest.approx(-math.log((5 - 1 + 0.5) / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / avg)))}
    assert S.bm25(rows, F.col("t"), []).count() == 0


def test_phrases():
    assert X.fts_phrases('src/main.rs -foo "bar"') == [["src", "main", "rs"], ["foo"], ["bar"]]
    assert X.fts_phrases(" * ") == []


def test_sanitizer(spark):
    x = spark.createDataFrame([("<system>Find errors</system>",), ("User: `a`   b",), ("w " * 2000,), ("",)], "q string")
    got = [r[0] for r in x.select(X.sanitize_query(F.col("q"))).collect()]
    assert got[0].text == "Find errors" and got[0].removed == ["xml_tags"]
    assert got[1].text == "a b" and "conversation_framing" in got[1].removed
    assert got[2].was_truncated and len(got[2].text) <= 2048
    assert got[3].text == ""


def test_code_terms():
    assert X.code_terms("see src/auth/verify_token.rs and HttpServer now") == ["src", "auth", "verify_token", "verify_token.rs", "HttpServer"]
    assert X.code_terms("look at /foo and src/ or bar: please") == ["foo", "src", "bar"]
    assert X.fragments("HttpServerHandler") == ["http", "server"]


def test_learned_bias_puts_useful_first(spark):
    v = [1.0, 0.0]
    m = memories(spark, [{"id": "bad", "summary": "same text", "embedding": v}, {"id": "good", "summary": "same text", "embedding": v}])
    fx = spark.sql(f"SELECT * FROM VALUES ('good', 'r', 0.8D, TIMESTAMP_NTZ'{NOW}'), ('bad', 'r', -0.8D, TIMESTAMP_NTZ'{NOW}') AS v(memory_id, recall_event_id, effectiveness, computed_at)")
    assert [r[0] for r in values(S.hybrid(m, "same", v, 2, effects=fx, as_of=NOW), "id")] == ["good", "bad"]


def test_recency_weight(spark):
    fx = spark.sql("SELECT * FROM VALUES ('old', 0.8D, TIMESTAMP_NTZ'2023-11-03 00:00:00'), ('new', 0.8D, TIMESTAMP_NTZ'2024-01-25 00:00:00') AS v(memory_id, effectiveness, computed_at)")
    got = dict(values(S.learned(fx, NOW), "id", "learned"))
    assert got["new"] > got["old"] > 0


def test_bfs_depths(spark):
    links = spark.createDataFrame([("root", "child", "part_of", 1.0), ("child", "grand", "part_of", 1.0)], "source_id string, target_id string, relation string, weight double")
    assert G.bfs(links, "root", 1).count() == 2
    assert G.bfs(links, "root", 2).count() == 3
    assert G.bfs(links, "root", 10).count() == 3


def logs(spark, signals):
    s = spark.sql("SELECT 's' AS id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS started_at, TIMESTAMP_NTZ'2024-01-01 02:00:00' AS ended_at")
    r = spark.sql("SELECT 'r1' AS id, 's' AS session_id, TIMESTAMP_NTZ'2024-01-01 00:10:00' AS recalled_at, array('m1', 'm2') AS memory_ids")
    g = spark.createDataFrame(signals, "id string, signal_type string, signal_value long, at string").select("id", F.lit("s").alias("session_id"), F.lit(None).cast("string").alias("recall_event_id"), "signal_type", "signal_value", F.col("at").cast("timestamp_ntz").alias("occurred_at"))
    return s, r, g


def test_scores(spark):
    s, r, g = logs(spark, [("1", "test_pass", 2, "2024-01-01 00:20:00"), ("2", "session_success", 2, "2024-01-01 00:30:00"), ("3", "tool_error", -1, "2024-01-01 01:30:00"), ("4", "unknown", 5, "2024-01-01 00:21:00")])
    got = {m: (round(e, 6), n) for m, e, n in values(FB.score(r, g, s, NOW), "memory_id", "effectiveness", "signal_count")}
    assert got == {"m1": (1.0, 2), "m2": (round(1 / 1.3, 6), 2)}
    s, r, g = logs(spark, [("1", "correction", -1, "2024-01-01 00:20:00")])
    assert {e for _, e in values(FB.score(r, g, s, NOW), "memory_id", "effectiveness")} == {0.0}


def test_attribution(spark):
    s, r, g = logs(spark, [("in", "test_passed", 1, "2024-01-01 00:50:00"), ("late", "test_passed", 1, "2024-01-01 01:11:00"), ("before", "test_passed", 1, "2024-01-01 00:05:00")])
    assert dict(values(FB.attribute(g, r, s), "id", "recall_event_id")) == {"in": "r1", "late": None, "before": None}


def test_unmatched_takes_each_once(spark):
    def rows(*at):
        return spark.createDataFrame([("k", f"2024-01-01 {t}", f"i{n}") for n, t in enumerate(at)], "k string, at string, id string").withColumn("at", F.col("at").cast("timestamp_ntz"))

    old, new = rows("10:00:00", "10:01:00", "12:00:00"), rows("10:02:00", "15:00:00")
    assert {r[0] for r in values(E.unmatched(old, new, ["k"], 300), "id")} == {"i1", "i2"}


def cut(spark, chunker, text, *args, cols=("content", "heading")):
    return values(chunker(spark.createDataFrame([("d", text)], "id string, content string"), *args).orderBy("chunk_index"), *cols)


def test_headings_and_windows(spark):
    assert cut(spark, C.heading_chunks, "intro\n# One\nbody\n## Empty\n## Two\nlast", 50) == [("intro", None), ("body", "One"), ("last", "Two")]
    assert [len(w.split()) for w, _ in cut(spark, C.heading_chunks, "w " * 120, 50)] == [50, 50, 30]
    assert cut(spark, C.heading_chunks, None) == [] and cut(spark, C.window_chunks, " \n ", cols=("content",)) == []
    assert cut(spark, C.window_chunks, "a b c d e", 2, 1, cols=("content",)) == [("a b",), ("b c",), ("c d",), ("d e",)]


def test_outputs(spark):
    kind = lambda t: spark.range(1).select(C.output_type(F.lit(t))).first()[0]
    assert [kind(t) for t in ("error[E0308]: x", "plain", "\n" * 60 + "FAIL", "x\n  FAIL y")] == ["build_error", "generic", "generic", "test_result"]
    out = lambda t: cut(spark, C.output_chunks, t)
    assert out("error[E1]: a\n x\nerror: b\n y") == [("error[E1]: a\n x", "error[E1]"), ("error: b\n y", "error: b")]
    assert out("diff --git a/f b/f\n+1\ndiff --git a/g b/g\n-2")[1][1] == "g"
    assert out("2024-01-01 00:00:00 a\nb\n\n2024-01-01 00:00:05 c") == [("2024-01-01 00:00:00 a\nb", "2024-01-01 00:00:00"), ("2024-01-01 00:00:05 c", "2024-01-01 00:00:05")]
    assert [h for _, h in out("---- t::a ----\nx\nFAIL b")] == ["t::a", "FAIL b"]


def test_symbols(spark):
    d = spark.createDataFrame([("d", "use x\n\nfn a() {\n}\n\nfn b() {}\ntail"), ("e", "one\n\ntwo")], "id string, content string")
    sym = spark.createDataFrame([("d", "function", "b", 6, 6), ("d", "function", "a", 3, 4), ("d", "function", "far", 90, 99)], "id string, kind string, name string, line_start int, line_end int")
    got = C.symbol_chunks(d, sym).orderBy("document_id", "chunk_index")
    assert values(got.where("document_id = 'd'"), "heading", "line_start", "line_end") == [(None, 1, 2), ("function a", 3, 4), ("function b", 6, 6), (None, 7, 7)]
    assert values(got.where("document_id = 'e'"), "content", "line_start") == [("one", None), ("two", None)]
    lines = spark.createDataFrame([("function main [1:0-9:1]",), ("  method x [2:0-3:1]",)], "line string")
    assert values(C.parse_symbols(lines), "kind", "name", "line_start", "line_end") == [("function", "main", 1, 9)]


def test_fnv(spark):
    x = spark.createDataFrame([("",), ("a",), (None,), ("foobar",)], "s string")
    assert [r[0] for r in x.select(T.fnv1a(F.col("s"))).collect()] == ["cbf29ce484222325", "af63dc4c8601ec8c", None, "85944171f73967e8"]


def test_islands_go_on_across_slots(spark):
    at = [0, 5, 500, 630, 640, 1290, 1300, 9000, 9004]
    rows = spark.createDataFrame([("k", n, f"i{i}", 1) for i, n in enumerate(at)] + [(None, 3, "x", 0)], "k string, s long, id string, old int").withColumn("at", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = {r["id"]: r["island"] for r in E.islands(rows.drop("s"), ["k"], 10).collect()}
    assert got == {"i0": 0, "i1": 0, "i2": 1, "i3": 2, "i4": 2, "i5": 3, "i6": 3, "i7": 4, "i8": 4, "x": 0}


def test_index_and_scan_agree(spark, tmp_path):
    m = memories(spark, [{"id": str(i), "summary": t} for i, t in enumerate(["red fish blue fish", "fish red", "a blue-red thing", "blue red", "", "fish"])])
    S.TextIndex.write(m, "id", S.memory_text(), str(tmp_path))
    index = S.TextIndex.open(spark, str(tmp_path))
    for phrases, any_of in (([["fish"]], False), ([["red"], ["fish"]], False), ([["blue", "red"]], False), ([["fish"], ["blue"]], True), ([["none"]], False), ([["fish"], ["red", "fish"]], False)):
        a, b = (sorted((r["id"], round(r["rank"], 9)) for r in S.bm25(m, S.memory_text(), phrases, any_of, i).collect()) for i in (None, index))
        assert a == b, phrases
    plan = S.bm25(m.select("id", "weight"), S.memory_text(), [["fish"]], index=index)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "fish" in plan


def test_pending_never_negative():
    s = {"phase": "new", "tools": 0, "pending": 0, "errors": 0}
    for k in ("approval_response", "approval_request", "approval_response", "end"):
        s = TR.fold(s, k)
    assert s == {"phase": "ended", "tools": 0, "pending": 0, "errors": 0}


def test_labels_are_structs(spark):
    from mnemolake.operators import graph as G
    from mnemolake.schema import CONCEPTS

    c = spark.createDataFrame([("1", "m", "parse", "reads text", [("kind", "function"), ("lang", "py")], 0.5, 1, None, None, ["a"]), ("2", "m", "draw", "paints", [("kind", "class")], 0.9, 1, None, None, None)], CONCEPTS)
    assert values(G.with_label(c, "m", "kind:function"), "id") == [("1",)]
    assert values(G.with_labels(c, "m", ["kind:function", "lang:py"]), "id") == [("1",)]
    assert values(S.concept_fts(c, "function"), "id") == [("1",)]
    assert [r["source_memory_ids"] for r in G.refine(c, "1", "new", ("b", "a")).orderBy("id").collect()] == [["a", "b"], None]


def test_purge_is_a_partition(spark):
    m = memories(spark, [{"id": "a", "project": "x"}, {"id": "b", "project": "y"}, {"id": "c"}])
    kept = T.purge_project({"m": m}, "x")["m"]
    assert {r[0] for r in values(kept, "id")} == {"b", "c"}


def test_snapshot_round_trip(spark, tmp_path):
    from mnemolake.sources import snapshot as SN

    root = str(tmp_path)
    a = SN.commit(spark, root, {"t": spark.range(3)}, "0001")
    SN.commit(spark, root, {"t": spark.range(5)}, "0002")
    assert SN.load(spark, root, "t").count() == 5
    SN.restore(spark, root, a)
    assert SN.load(spark, root, "t").count() == 3


def test_engine(spark, tmp_path):
    from mnemolake.engine import Engine

    (tmp_path / "a.md").write_text("# Title\nhello world of fish\n")
    (tmp_path / "b.bin").write_bytes(b"\x00\x01")
    (tmp_path / ".hidden").write_text("no")
    e = Engine(spark, NOW).store(memories(spark, [{"id": "1", "summary": "red fish"}, {"id": "2", "summary": "blue"}]))
    hits, after = e.recall("fish")
    assert values(hits, "id") == [("1",)]
    assert dict(values(after.table("memories"), "id", "access_count")) == {"1": 1, "2": 0}
    f, rejected = e.ingest(str(tmp_path))
    assert values(f.table("chunks"), "content", "heading") == [("hello world of fish", "Title")]
    assert rejected.count() == 1
    kinds = {r[0] for r in values(f.search_all("fish"), "kind")}
    assert kinds == {"memory", "chunk"}
