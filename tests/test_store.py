"""Ingest with vectors, nested redaction, watched folders and snapshots."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from mnemolake.engine import Engine
from mnemolake.functions import embedding as EM
from mnemolake.functions.text import redact_json, redacted
from mnemolake.sources import snapshot as SN
from mnemolake.streaming import watching as W

NOW = "2024-02-01 00:00:00"


def embedders_of(log):
    """A service that doesn't answer, and one that does; within a function, so that workers get them by value."""

    class Counts:
        """Vectors of length and words; ``log`` gets a line a call."""

        dimensions = 2

        def __init__(self, log):
            self.log = log

        def __call__(self, texts):
            if texts != ["probe"]:
                with open(self.log, "a") as f:
                    f.writelines("x\n" for _ in texts)
            return [[float(len(t)), float(len(t.split()))] for t in texts]


    class Broken(Counts):
        def __call__(self, texts):
            raise OSError("no answer")

    return [("broken", Broken(log)), ("counts", Counts(log))]


def test_ingest_asks_for_each_text_once(spark, tmp_path):
    folder, log = tmp_path / "in", tmp_path / "log"
    folder.mkdir()
    log.write_text("")
    asked = lambda: len(log.read_text().splitlines())
    for n, t in (("a.txt", "red fish"), ("b.txt", "blue fish swim"), ("c.txt", "red fish")):
        (folder / n).write_text(t)
    embedders = embedders_of(str(log))
    e, _ = Engine(spark, NOW).ingest(str(folder), embedders=embedders)
    got = lambda e: sorted((r["content"], list(r["embedding"])) for r in e.table("chunks").collect())
    assert got(e) == [("blue fish swim", [14.0, 3.0]), ("red fish", [8.0, 2.0]), ("red fish", [8.0, 2.0])]
    assert asked() == 2
    (folder / "b.txt").write_text("green")
    e, _ = e.ingest(str(folder), embedders=embedders)
    assert got(e)[0] == ("green", [5.0, 1.0]) and asked() == 3
    e, _ = e.ingest(str(folder), embedders=embedders)
    assert got(e)[0] == ("green", [5.0, 1.0]) and asked() == 3
    plain, _ = Engine(spark, NOW).ingest(str(folder), embedders=embedders[:1])
    assert [r[0] for r in plain.table("chunks").select("embedding").distinct().collect()] == [None] and EM.choose([]) is None


def test_redaction_at_any_depth(spark):
    deep = {"a": [{"B": {"my_Token": {"x": [1]}, "note": "password: abcdefghij"}}, "ok", None, 1.5], "sk": "sk-" + "a" * 20}
    assert redacted(deep) == {"a": [{"B": {"my_Token": "[REDACTED]", "note": "[REDACTED]"}}, "ok", None, 1.5], "sk": "[REDACTED]"}
    rows = [json.dumps(deep), None, "no json", "secret=12345678", "[" * 100_000, '"é"']
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(redact_json(F.col("t"))).collect()]
    assert json.loads(got[0]) == redacted(deep) and got[1:] == [None, "no json", "[REDACTED]", "[" * 100_000, '"é"']


def test_watched_folder_with_deletions(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "node_modules").mkdir()
    (folder / "node_modules" / "x.txt").write_text("skipped")
    chunk = lambda d: d.select(F.col("id").alias("document_id"), "source_path", "content")
    write = lambda **files: [(folder / f"{n}.txt").write_bytes(t.encode() if isinstance(t, str) else t) for n, t in files.items()]
    step = lambda n: W.step(spark, str(folder), target, n, chunk)
    have = lambda: sorted(r["content"] for r in W.present(spark, target).collect())
    write(a="one", b="two", c=b"\x00bin", d="d", e="")
    step(0)
    assert have() == ["d", "one", "two"]
    write(a="one again", b="two")
    (folder / "d.txt").unlink()
    step(1)
    assert have() == ["one again", "two"]
    actions = {r["source_path"].rsplit("/", 1)[1]: r["action"] for r in W.manifest(spark, target).collect()}
    assert actions == {"a.txt": "changed", "b.txt": "same", "c.txt": "same", "d.txt": "deleted"}
    step(1)  # run again, as after a failure
    assert have() == ["one again", "two"]
    (folder / "a.txt").unlink()
    write(d="back")
    step(2)
    assert have() == ["back", "two"]
    for n in "bcd":
        (folder / f"{n}.txt").unlink()
    step(3)
    step(4)
    assert have() == []


def test_snapshots_share_files_and_refuse_damage(spark, tmp_path):
    root = str(tmp_path)
    SN.commit(spark, root, {"t": spark.range(3), "u": spark.range(9)}, "1")
    SN.commit(spark, root, {"t": spark.range(1, 5), "u": spark.range(9)}, "2")
    assert not (tmp_path / "2" / "u").exists() and SN.load(spark, root, "u", "2").count() == 9
    assert sorted((r["id"], r["action"]) for r in SN.diff(spark, root, "t", "1", "2").collect()) == [(0, "removed"), (3, "added"), (4, "added")]
    assert SN.diff(spark, root, "u", "1", "2").count() == 0
    name = SN.restore(spark, root, "1")
    assert sorted(r[0] for r in SN.load(spark, root, "t", name).collect()) == [0, 1, 2]
    shutil.rmtree(tmp_path / "2" / "t")
    spark.range(7).write.parquet(f"{root}/2/t")
    with pytest.raises(ValueError):
        SN.restore(spark, root, "2")
    with pytest.raises(ValueError):
        SN.restore(spark, root, "none")
