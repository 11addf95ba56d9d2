"""Training-data operators: small cases, odd inputs, and brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolake.llm import ann, chat_format, decontaminate, line_dedup, mixing, near_dedup, quality, secret_scan, token_counts, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one", "en", "a", 3), (3, "one", "en", "a", 3), (None, "no id here", "en", None, 10), (4, " \n\t ", "en", "b", 4)]


def docs(spark, rows):
    return spark.createDataFrame([(r[0], r[1], "en", "s", len(r[1] or "")) if len(r) == 2 else r for r in rows], DOCS)


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n)]


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# 1

def test_urls(spark):
    rows = [(1, "https://WWW.Example.org/es/1?x"), (2, "http://a.example.org/en/12"), (3, "http://x.com/fr/1"), (4, "http://x.com/de/1"), (5, "http://org/a"), (6, "nothing"), (7, None), (8, "http://notorg/a"), (9, "http://x.org"), (10, "http://my.net/a/1#z"), (10, "http://my.net/a/1#z"), (12, "http://q.net/" + "a/" * 2999 + "b/"), (11, "http://q.net/" + "a/" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    out = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    assert (out[1]["host"], out[1]["path"], out[1]["rule"], out[1]["verdict"]) == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert [out[i]["rule"] for i in (2, 3, 4, 5, 8, 9)] == ["example.org/en/1", "com/fr/", "com/de/", "org/", None, None]
    assert (out[6]["host"], out[7]["path"]) == ("", "")
    assert (out[10]["verdict"], out[11]["verdict"]) == ("allow", "allow") and out[11]["template"] == out[12]["template"] == "/" + "a/" * 2999 + "*/"
    labels = spark.createDataFrame([(10, 0), (10, 1), (11, 0), (99, 1), (5, None)], "page_id long, blocked int")
    out = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, labels=labels).collect()}
    assert (out[10], out[11], out[4], out[5]) == ("block", "allow", "block", "allow")
    assert url_filter.judge(df).count() == len(rows)
    assert url_filter.judge(df.limit(0)).count() == 0


def test_templates_generalise_and_reject(spark):
    rows = [("h", f"/u/w{i}x", "block" if i % 3 else None) for i in range(30)] + [("h", f"/ok/{i}", "allow") for i in range(30)]
    df = spark.createDataFrame(rows, "host string, path string, label string").withColumn("typed", url_filter._segments(F.col("path")))
    counted = df.select("host", "typed", F.lit(1).alias("n"), (F.col("label") == "block").cast("int").alias("b"), F.col("label").isNotNull().cast("int").alias("labelled")).select("host", "typed", "n", F.coalesce("b", F.lit(0)).alias("blocked"), "labelled")
    t = {r["template"]: r["purity"] for r in url_filter.learn_templates(counted).select("template", "purity").distinct().collect()}
    assert set(t) == {"/u/*", "/ok/<n>"} and t["/u/*"] > 0.5 > t["/ok/<n>"]


def counted(spark, rows):
    """Rows (host, path, label) as ``learn_templates`` takes them."""
    df = spark.createDataFrame(rows, "host string, path string, label string").withColumn("typed", url_filter._segments(F.col("path")))
    return df.select("host", "typed", F.lit(1).alias("n"), F.coalesce((F.col("label") == "block").cast("int"), F.lit(0)).alias("blocked"), F.col("label").isNotNull().cast("int").alias("labelled"))


def test_templates_of_two_variable_levels(spark):
    rows = [("h", f"/u/name{i}x/slug{i}y", None) for i in range(30)] + [("h", "/u/name0x/slug0y/edit", None)]
    out = url_filter.learn_templates(counted(spark, rows))
    assert {r["template"] for r in out.collect()} == {"/u/*/*", "/u/*/*/edit"}


def test_rare_words_are_variable_common_ones_are_tested(spark):
    # Of ten words each rare one is merged, whatever its labels; the common one is told from the rest by its labels.
    rows = [("h", f"/w{i}x", "block") for i in range(9) for _ in range(5)] + [("h", "/wide", "allow")] * 60
    out = url_filter.learn_templates(counted(spark, rows + [("g", *r[1:]) for r in rows[:40]] + [("g", "/w8x", "allow")] * 5))
    assert {(r["host"], r["template"]) for r in out.collect()} == {("h", "/*"), ("h", "/wide"), ("g", "/*")}


def test_path_rules_do_not_judge_other_branches(spark):
    paths = [f"de/{i}" for i in range(40)] + [f"fr/{i}" for i in range(12)] + [f"en/{i}" for i in range(30)] + [f"es/{i}" for i in range(30)]
    urls = [f"http://clean.com/{p}" for p in paths] + [f"http://my-casino.com/en/{i}" for i in range(5)] + ["http://my-casino.com/fr/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = df.where("url LIKE '%casino.com/en/1' OR url LIKE '%casino.com/en/2'").select("page_id", F.lit(1).alias("blocked"))
    out = {(r["host"], r["path"].split("/")[1], r["verdict"]) for r in url_filter.judge(df, labels=labels).collect()}
    assert out == {("clean.com", "de", "block"), ("clean.com", "fr", "allow"), ("clean.com", "en", "allow"), ("clean.com", "es", "allow"), ("my-casino.com", "en", "block"), ("my-casino.com", "fr", "allow")}


# 2

def spans(text):
    out = []
    for k, (kind, p, ok) in enumerate((("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 6), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24))):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(p, text, re.A) if ok(m)]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


def test_secrets_against_brute_force(spark):
    r = random.Random(3)
    parts = ["password=", "Secret: 'abcdef1'", "token: token: abcdefgh", "api_key=\"zz\"", "AKIA" + "A1" * 9, "AKIAX", "0" * 23, "deadbeef" * 4, "é", "😀", " ", "\n", "x=1", "ſecret=abcdefg", "tokenabc", "apikey = Q+/=_.-9"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(120)] + [None, ""]
    rows = list(enumerate(texts)) + [(5, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("findings", F.lit(1))
    ledger = secret_scan.scan(df, "doc_id", "text")
    found = secret_scan.report(df, "doc_id", "text", ledger)
    out = defaultdict(set)
    for x in found.collect():
        out[x["doc_id"]].add(",".join(f"{f['kind']}:{f['start']}:{f['end']}" for f in (x["findings"] or []) if f["kind"] in secret_scan.BASE))
    assert out == {i: {spans(t or "")} for i, t in enumerate(texts)}
    assert found.count() == len(rows)
    assert ledger.count() == len({t or "" for t in texts})


def test_ledger_scans_only_unseen(spark):
    S = secret_scan
    a = spark.createDataFrame([(1, "password=abcdefg"), (2, "password=abcdefg")], "doc_id long, text string")
    ledger = S.scan(a, "doc_id", "text")
    b = a.unionByName(spark.createDataFrame([(3, "secret=hijklmn " * 2), (None, None)], a.schema))
    assert S.unseen(b, "doc_id", "text", ledger).count() == 2
    newer = tuple(S.Rule(r.kind, "secret=hij", "^", "2") if r.kind == "assign" else r for r in S.RULES)
    assert {tuple(r["todo"]) for r in S.unseen(a, "doc_id", "text", ledger, newer).collect()} == {("assign@2",)}
    after = S.scan(b, "doc_id", "text", ledger)
    found = S.report(b, "doc_id", "text", after).orderBy("doc_id").collect()
    assert [[(f["start"], f["end"]) for f in r["findings"]] for r in found] == [[], [(0, 16)], [(0, 16)], [(0, 14), (15, 29)]] and after.count() == 3
    again = S.report(b, "doc_id", "text", S.scan(b, "doc_id", "text", after, newer), newer).orderBy("doc_id").collect()
    assert [[f["rule"] for f in r["findings"]] for r in again] == [[], [], [], ["assign@2"] * 2]
    # What the ledger says of a blob is believed, not found out anew.
    planted = ledger.withColumn("findings", F.filter("findings", lambda x: F.lit(False)))
    assert [len(r["findings"]) for r in S.report(b, "doc_id", "text", S.scan(b, "doc_id", "text", planted)).orderBy("doc_id").collect()] == [0, 0, 0, 2]
    long = spark.createDataFrame([(1, "x" * 999_990 + "é token=abcdefgh " + "y " * 500_000)], a.schema)
    assert [(f["start"], f["end"]) for f in S.report(long, "doc_id", "text", S.scan(long, "doc_id", "text")).first()["findings"]] == [(999_992, 1_000_006)]
    assert S.report(a.limit(0), "doc_id", "text", S.scan(a.limit(0), "doc_id", "text")).count() == 0


# 3

def test_leaks(spark):
    q = "Tom has 5 apples and gives 2 apples to Ann so that 3 kg are left for 5 more days"
    same = "before it all. " + q + " and after it"
    other = q.replace("Tom", "Bob").replace("5", "7").replace("2", "4")
    odd = q.replace("5 apples", "7 apples")  # 5 became 7 here and stays 5 there
    items = spark.createDataFrame([(1, q), (2, "short one"), (3, None), (1, q)], "item_id long, text string")
    d = docs(spark, [(1, same), (2, other), (3, odd), (4, "nothing of the kind is here at all, really nothing"), (5, None), (6, ""), (1, same)]).withColumn("item_id", F.lit(9))
    assert got(decontaminate.find_leaks(d, items), "doc_id", "item_id", "kind") == [(1, 1, "exact"), (2, 1, "reparameterised")]
    assert sorted(x["doc_id"] for x in decontaminate.drop_leaks(d, items).collect()) == [3, 4, 5, 6]
    assert decontaminate.find_leaks(d, items.limit(0)).count() == 0
    assert decontaminate.find_leaks(d.limit(0), items).count() == 0


def test_short_items_and_hot_windows(spark, monkeypatch):
    items = spark.createDataFrame([("a", "Paris"), ("b", "in 1789"), ("c", "Bob has 5 of them now"), ("d", "1 2 3 4 5 6 7 8 9 10 11 12"), (None, "never found anywhere")], "item_id string, text string").withColumn("doc_id", F.lit(7))
    d = docs(spark, [(1, "We saw Paris then"), (2, "We saw Rome in 1789"), (3, "it was in 1790"), (4, "so Ann has 7 of them now"), (5, " ".join(str(i % 97) for i in range(3000))), (6, "x " * 200_000 + "Paris")])
    want = [(1, "a", "exact"), (2, "b", "exact"), (4, "c", "reparameterised"), (5, "d", "reparameterised"), (6, "a", "exact")]
    assert got(decontaminate.find_leaks(d, items), "doc_id", "item_id", "kind") == want
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert got(decontaminate.find_leaks(d, items), "doc_id", "item_id", "kind") == want
    none = decontaminate.find_leaks(d, items.limit(0))
    assert none.count() == 0 and dict(none.dtypes)["item_id"] == "string"
    assert decontaminate.drop_leaks(d.withColumn("_leak", F.lit(1)), items.limit(0).withColumn("item_id", F.lit(1))).count() == 6


# 4

def test_mix(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * r.randint(1, 200)), "en", s, 0) for i, s in enumerate(r.choices(["a", "b", "c", None, "é"], weights=[30, 5, 3, 3, 1], k=800))] + [r + () for r in ODD]
    d = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(d).collect()
    assert len(out) == len(rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for x in out:
        assert 0 <= x["taken"] <= 3 * x["size"]
        size[x["source"]] += x["size"]
        taken[x["source"]] += x["taken"]
        target[x["source"]] = x["target"]
    total = sum(size.values())
    names = sorted(s for s in size if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full = set()
    while True:
        rest = total - sum(3 * size[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        want = {s: 3.0 * size[s] if s in full else rest * weight[s] / w for s in names}
        over = {s for s in names if s not in full and want[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    assert all(target[s] == pytest.approx(want[s]) for s in names)
    assert all(abs(taken[s] - want[s]) <= max(12, 0.02 * want[s]) for s in names)
    again = {(x["doc_id"], x["size"]): x["taken"] for x in mixing.mix(d.repartition(7)).collect()}
    assert again == {(x["doc_id"], x["size"]): x["taken"] for x in out}
    assert mixing.mix(d.limit(0)).count() == 0


def test_joins_beyond_the_broadcast(spark, monkeypatch):
    rows = [(i % 5, "w " * (i % 40), "en", f"s{i % 7}", 0) for i in range(300)]
    d = docs(spark, rows)
    near = got(mixing.mix(d), "doc_id", "size", "source", "taken")
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert got(mixing.mix(d), "doc_id", "size", "source", "taken") == near


def test_small_sources_beside_a_huge_one(spark):
    rows = [(i, "w " * 20_000, "en", "huge", 0) for i in range(100)] + [(1000 + i, "w " * n, "en", s, 0) for i, (s, n) in enumerate([("few", 5), ("few", 2), ("one", 1), ("some", 700), ("some", 801)])]
    taken, target = defaultdict(int), {}
    for x in mixing.mix(docs(spark, rows)).collect():
        taken[x["source"]] += x["taken"]
        target[x["source"]] = x["target"]
    assert (taken["few"], taken["one"], taken["some"]) == (21, 3, 4503)
    assert all(taken[s] == pytest.approx(t, rel=0.001) for s, t in target.items())


def test_own_blocks_of_small_targets(spark):
    # Weights of one to many leave a large source a small target, which is no multiple of its size.
    rows = [(i, "w " * 5_000, "en", s, 0) for i, s in enumerate(["a", "b"] * 20)]
    taken, target = defaultdict(int), {}
    for x in mixing.mix(docs(spark, rows), weights=(100_000, 3)).collect():
        taken[x["source"]] += x["taken"]
        target[x["source"]] = x["target"]
    assert target["b"] < 10 and all(taken[s] == pytest.approx(t, rel=0.02) for s, t in target.items())


def test_word_count(spark):
    texts = ["", " ", "a", " a b\n", "a\x0bb\x0cc", "a\xa0b", None, "\ta  b"]
    x = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.word_count(F.col("t"))).collect()
    assert [r[0] for r in x] == [len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for t in texts]


def test_highest_quotients(spark):
    t = {"a": 530.0, "b": 240.0, "c": 230.0}
    s = spark.createDataFrame([(k, v, 10_000) for k, v in t.items()], "source string, target double, source_size long")
    quota = {r["source"]: r["quota"] for r in mixing.apportion(s, 10, 100.0).collect()}
    best = sorted(((v / (2 * k + 1), n) for n, v in t.items() for k in range(20)), reverse=True)[:10]
    assert quota == {n: sum(1 for _, m in best if m == n) for n in t}
    r = random.Random(4)
    t = {f"s{i:03}": r.choice([1.0, 10.0, 10.0, r.uniform(0, 1000)]) for i in range(120)}
    s = spark.createDataFrame([(k, v, 1 + int(v / r.choice([0.5, 1, 3]))) for k, v in t.items()], "source string, target double, source_size long")
    size = {x["source"]: -(-x["source_size"] // 5) * 3 for x in s.collect()}
    for seats in (40, 60, 500, 5000):
        quota = {x["source"]: x["quota"] for x in mixing.apportion(s, seats, 5.0).collect()}
        best = sorted((-v / (2 * k + 1), n) for n, v in t.items() for k in range(size[n]))[:seats]
        assert quota == {n: sum(1 for _, m in best if m == n) for n in t}, seats


# 5

def edit1(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or len(a) == len(b) and a[i + 1 :] == b[i + 1 :]


def gone_lines(rows):
    """{(doc, line): what stays for it} of the lines that go: those that equal an earlier one, or whose form first stands near an even earlier one."""
    def form(s):
        return re.sub("[ \t\r\x0b\x0c]+", " ", s.lower()).strip(" ")

    lines = [((i, n), form(x)) for i, t in rows if t is not None for n, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[1]]
    first, by_length = {}, defaultdict(list)
    for p, f in sorted(lines):
        if f not in first:
            first[f] = p
            by_length[len(f)].append(f)
    long = line_dedup.LEAST_CHARS
    near = {f: [first[g] for n in (-1, 0, 1) if len(f) + n >= long for g in by_length[len(f) + n] if g != f and first[g] < first[f] and edit1(f, g)] for f in first if len(f) >= long}
    parent = {first[f]: min(ps) for f, ps in near.items() if ps}

    def root(p):
        return root(parent[p]) if p in parent else p

    return {p: root(first[f]) for p, f in lines if p != root(first[f])}


def without(text, doc, gone):
    """What is left of a document; None if all of it went."""
    rest = "\n".join(x for n, x in enumerate(text.split("\n")) if (doc, n) not in gone)
    return rest if rest.strip() or not any(d == doc for d, _ in gone) else None


def test_lines_against_brute_force(spark):
    r = random.Random(5)
    base = ["".join(r.choices("abcd ", k=r.randint(18, 40))) for _ in range(12)] + ["Read more", "ok"]

    def change(s):
        i, k = r.randrange(len(s)), r.choice("sdi-")
        return s if k == "-" else s[:i] + (r.choice("xyz9") if k != "d" else "") + s[i + (k != "i") :]

    rows = [(i, "\n".join(change(r.choice(base)) for _ in range(r.randint(0, 8)))) for i in range(60)] + [(60, None), (61, ""), (61, "é" * 30 + "\n" + "é" * 31)]
    d = docs(spark, rows)
    want = gone_lines(rows)
    out = line_dedup.repeated_lines(d.withColumn("form", F.lit(1)))
    assert {(x["doc"], x["no"]): (x["kept"]["doc"], x["kept"]["no"]) for x in out.collect()} == want
    assert not set(want.values()) & set(want)  # what stays for a line stays
    kept = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(d.where("doc_id < 60")).collect()}
    assert all(kept.get(i) == without(t, i, want) for i, t in rows[:60])


def test_lines_odd(spark):
    d = spark.createDataFrame(ODD, DOCS)
    assert line_dedup.dedup_lines(d).count() == len(ODD) - 1  # one of the two rows alike
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0
    chain = ["abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxy1", "abcdefghijklmnopqrstuvwx11", "abcdefghijklmnopqrstuvw111"]
    assert got(line_dedup.repeated_lines(docs(spark, list(enumerate(chain)))).select("doc", F.col("kept.doc").alias("kept")), "doc", "kept") == [(1, 0), (2, 0), (3, 0)]
    numbers = [(1, "the total was 1234 in the year"), (2, "the total was 5678 in the year"), (3, "Next\nNEXT ")]
    assert got(line_dedup.repeated_lines(docs(spark, numbers)), "doc", "no") == [(3, 1)]
    twice = docs(spark, [(1, "a line\n\nb line"), (1, "a line\n\nb line"), (1, "c line"), (2, " "), (2, " ")])
    twice = twice.select("*", *[F.lit("x").alias(c) for c in ("_key", "_doc", "_nth", "_gone", "kept")])
    assert got(line_dedup.repeated_lines(twice), "doc", "no") == [(1, 0), (1, 2)]
    assert got(line_dedup.dedup_lines(twice), "doc_id", "text", "_doc") == [(1, "a line\n\nb line", "x"), (1, "c line", "x"), (2, " ", "x"), (2, " ", "x")]
    long = "ab" * 50_000
    assert got(line_dedup.repeated_lines(docs(spark, [(1, long), (2, long[:-1] + "x")])), "doc", "no") == [(2, 0)]


# 6

def test_neighbours(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(400, 12))
    v[50:90] = v[7]
    rows = [(i, [float(x) for x in y]) for i, y in enumerate(v)] + [(900, None), (901, [0.0] * 12), (902, [1.0, None] + [0.0] * 10), (903, [float("nan")] * 12), (904, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    out = defaultdict(list)
    for x in ann.neighbours(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        out[x["query_id"]].append((x["vec_id"], x["score"]))
    s, hit = v @ v.T, []
    assert set(out) == set(range(0, 400, 20))
    for q, found in out.items():
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-round(s[q, i], 9), i))[:20]
        hit.append(len({i for i, _ in found} & set(best)) / 20)
        assert all(x == pytest.approx(s[q, i]) for i, x in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    assert np.mean(hit) >= 0.9
    few = got(ann.neighbours(df.where("vec_id < 5"), F.col("vec_id") == 0, 20), "vec_id")
    assert few == [(1,), (2,), (3,), (4,)]
    assert ann.neighbours(df.limit(0), F.lit(True), 3).count() == 0


def test_neighbours_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 150)
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 16)) * 3
    v = centres[r.integers(0, 12, 1500)] + r.normal(size=(1500, 16))
    rows = [(i, [float(x) for x in y]) for i, y in enumerate(v)] + [(5000 + i, [float(i), 1.0]) for i in range(4)] + [(None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for x in ann.neighbours(df, F.col("vec_id") % 20 == 0, 20).collect():
        found[x["query_id"]].append((x["rank"], x["vec_id"]))
    s = v @ v.T
    hit = [len({i for _, i in found[q]} & set(sorted((i for i in range(1500) if i != q), key=lambda i: -s[q, i])[:20])) / 20 for q in range(0, 1500, 20)]
    assert np.mean(hit) >= 0.9
    assert sorted(found[5000]) == [(1, 5001), (2, 5002), (3, 5003)]  # all score 1, and only their own length is compared


def test_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0, float(i)]) for i in range(60)] + [(100, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    assert got(ann.neighbours(df, F.col("vec_id") == 100, 5), "rank", "vec_id", "score") == [(i + 1, i, 1.0) for i in range(5)]


def test_chi_square():
    assert ann.chi2_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-5)
    assert ann.chi2_quantile(0.95, 8) == pytest.approx(15.507313, abs=1e-5)


# 7

def attributed(text, pieces, section, rule):
    """Tokens of each section, token by token and character by character."""
    cuts = [0] + [m.end() for m in re.finditer({"line": r"\n", "paragraph": r"\n[ \t\r]*\n\s*"}[section], text) if m.end() < len(text)]
    owner = lambda c: max(i for i, a in enumerate(cuts) if a <= c)
    of_byte = [i for i, c in enumerate(text) for _ in c.encode()]
    counts, at, crossing = [0] * len(cuts), 0, 0
    for n in pieces:
        chars = sorted(set(of_byte[at : at + n]))
        at += n
        homes = Counter(owner(c) for c in chars)
        crossing += len(homes) > 1
        counts[min(homes) if rule == "first" else min(homes, key=lambda s: (-homes[s], s))] += 1
    return counts, crossing


def test_tokens(spark):
    r = random.Random(2)
    texts = ["Hello world\nand more\n\nlast", "é😀\nx", None, "", "<|endoftext|>", "a" * 5000 + "\nb", "\n\n\n", "x\n \n\n  y\n"] + ["".join(r.choices(["the ", "\n", "\n\n", "ü", "😀", "words", "  ", "1"], k=60)) for _ in range(20)]
    d = docs(spark, list(enumerate(texts)))
    with open(token_counts.VOCABULARY, "rb") as f:
        enc, size = token_counts._encoder(f.read())
    for rule, section in itertools.product(token_counts.RULES, token_counts.SECTIONS):
        for x in token_counts.section_counts(d, rule=rule, section=section).collect():
            t = texts[x["doc_id"]] or ""
            ids = enc.encode_ordinary(t)
            want = attributed(t, [int(size[i]) for i in ids], section, rule) if t else ([], 0)
            assert (x["section_tokens"], x["crossing"], x["tokens"]) == (*want, len(ids))
            assert len(x["section_starts"]) == len(want[0])
    with pytest.raises(ValueError):
        token_counts.section_counts(d, rule="none")
    with pytest.raises(ValueError):
        token_counts.section_counts(d, section="none")


def test_boundary_rules():
    starts, ends, sections = np.array([0, 3, 9]), np.array([3, 9, 12]), np.array([0, 4, 10])
    assert token_counts.attribute(starts, ends, sections, "first")[0].tolist() == [2, 1, 0]
    assert token_counts.attribute(starts, ends, sections, "most")[0].tolist() == [1, 1, 1]
    assert token_counts.attribute(starts, ends, sections, "first")[1].tolist() == [1, 1, 0]


# 8

def shingles(t):
    """Runs of five words in text order; fewer words are one run."""
    w = re.findall(r"[^\x20\x09-\x0d]+", t or "")
    return list(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else [tuple(w)] if w else []


def aligned(a, b):
    """Most matches, in order, of two sequences."""
    code = {x: i for i, x in enumerate({*a, *b})}
    b = np.array([code[x] for x in b])
    row = np.zeros(len(b) + 1, int)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == code[x])))
    return int(row[-1])


def class_of(rows):
    """{(doc, text): least doc of its class}: links are alignments of at least 0.8."""
    runs = {(k, t): shingles(t) for k, t in rows}
    count = {x: Counter(s) for x, s in runs.items()}
    parent, holders = {x: x for x in runs}, defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, s in runs.items():
        shared = defaultdict(int)
        for g, n in count[x].items():
            for y in holders[g]:
                shared[y] += min(n, count[y][g])
            holders[g].append(x)
        for y, n in shared.items():  # what can be aligned at all
            both = len(s) + len(runs[y])
            if n >= 0.8 * (both - n) and root(x) != root(y) and (m := aligned(s, runs[y])) >= 0.8 * (both - m):
                parent[root(y)] = root(x)
    least = {}
    for x in runs:
        least[root(x)] = min(least.get(root(x), x[0]), x[0])
    return {x: least[root(x)] for x in runs}


def test_near_dedup_against_brute_force(spark):
    r = random.Random(2)
    rows, base = [], [words(120, i) for i in range(6)]
    for i in range(150):
        w = list(base[min(i % 9, 5)])
        for _ in range(r.choice([0, 0, 1, 2, 3, 4, 6])):
            w[r.randrange(len(w))] = f"n{i}x{r.randrange(9)}"
        rows.append((1000 + i, " ".join(w)))
    half = base[0][60:] + base[0][:60]
    rows += [(10, " ".join(half)), (11, "just a few"), (12, "just  a few"), (13, ""), (14, None), (15, " "), (13, ""), (16, " ".join(words(3000, 77))), (17, " ".join(words(3000, 77)[:2990]))]
    d = docs(spark, rows)
    out = near_dedup.classify(d.withColumn("class_id", F.lit("clash")))
    least = class_of(rows)
    want = sorted((k, least[k, t]) for k, t in rows)
    assert got(out, "doc_id", "class_id") == want
    kept = sorted(x["doc_id"] for x in near_dedup.keep_one(d).collect())
    assert kept == sorted(k for k, t in rows if not shingles(t) or k == least[k, t])
    assert near_dedup.classify(d.limit(0)).count() == 0


def test_near_dedup_odd(spark):
    d = spark.createDataFrame(ODD, DOCS)
    assert near_dedup.classify(d).count() == len(ODD)
    assert near_dedup.keep_one(d).count() == len(ODD) - 1  # one of the two rows alike


def test_order_decides(spark):
    # The halves swapped: nearly all shingles are shared, but no alignment has more than half of them.
    w = words(400, 5)
    rows = [(1, " ".join(w)), (2, " ".join(w[200:] + w[:200])), (3, " ".join(w[:396] + ["x", "y", "z", "v"])), (4, "a b c d e " * 300), (5, "a b c d e " * 310)]
    assert got(near_dedup.classify(docs(spark, rows)), "doc_id", "class_id") == [(1, 1), (2, 2), (3, 1), (4, 4), (5, 4)]


def test_crowded_buckets_of_many_components(spark):
    # A passage that all share, many variants of two texts that overlap, and pairs and chains of near copies among them.
    r = random.Random(8)
    passage, base = words(60, 1), words(200, 2)
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words(20, 100 + i) + passage + words(20, 200 + i))))
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(0, 14)):
            w[r.randrange(len(w))] = f"v{r.randrange(60)}"
        rows.append((100 + i, " ".join(w)))
        if i % 5 == 0:
            w[r.randrange(len(w))] = f"again{i}"
            rows.append((300 + i, " ".join(w)))
    rows += [(500 + i, " ".join(passage[:30] + words(3, 300 + i % 20) + ["end"] * (i // 20))) for i in range(60)]
    least = class_of(rows)
    assert len(set(least.values())) > 60
    out = near_dedup.classify(docs(spark, rows))
    assert got(out, "doc_id", "class_id") == sorted((k, least[k, t]) for k, t in rows)
    sizes = Counter(least.values())
    assert got(out, "doc_id", "class_size") == sorted((k, sizes[least[k, t]]) for k, t in rows)


def test_align():
    r = random.Random(9)
    for _ in range(400):
        few = r.choice([2, 4, 40])
        a, b = (np.array([r.randrange(few) for _ in range(r.randint(0, 16))], np.uint64) for _ in range(2))
        m = aligned(a.tolist(), b.tolist())
        for most in (0, 3, 40):
            d = len(a) + len(b) - 2 * m
            assert near_dedup.diagonals(a, b, most) == (d if d <= most else most + 1)
        for least in (0.3, 0.5, 0.8):
            assert near_dedup.align(a, b, least) == (m >= least * (len(a) + len(b) - m) - 1e-9)


def test_apart_is_a_bound():
    r = random.Random(3)
    for _ in range(100):
        a, b, c = (np.array([r.randrange(6) for _ in range(r.randint(1, 12))], np.uint64) for _ in range(3))
        m = aligned(a.tolist(), b.tolist())
        assert near_dedup.apart(a, b) <= 1 - m / (len(a) + len(b) - m) + 1e-9
        assert near_dedup.apart(a, b) <= near_dedup.apart(a, c) + near_dedup.apart(c, b) + 1e-9


# 9

def test_gradient():
    r = np.random.default_rng(1)
    x, heads, y = r.normal(size=(9, quality.N_FEATURES)), np.array([0, 2, 3, 7]), np.array([1.0, 0, 1, 0])
    m = quality.fit(x, heads, y)
    g = m.gradient(x, heads, y)

    def loss():
        s = m.forward(x, heads)[0]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for k in g:
        at = (0,) * np.ndim(m.p[k])
        old, step = np.array(m.p[k], float), 1e-5
        new = old.copy()
        new[at] += step
        m.p[k] = new
        up = loss()
        new[at] -= 2 * step
        down = loss()
        m.p[k] = old
        assert np.asarray(g[k])[at] == pytest.approx((up - down) / (2 * step), abs=1e-6)


def test_quality(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        w = words(r.randint(20, 200), i)
        good = i % 3 > 0
        rows.append((i, " ".join(w).capitalize() + "." if good else " ".join(f"{x}{r.choice(['###', '%%%'])}" for x in w)))
        labels.append((i, int(good)))
    d, lab = docs(spark, rows), spark.createDataFrame(labels + [(9999, 1), (5, None), (None, 1)], "doc_id long, quality int")
    m = quality.train(d, lab)
    out = quality.score(d.withColumn("score", F.lit("clash")), m)
    assert out.columns[-1] == "_score"
    s = {x["doc_id"]: x["_score"] for x in out.collect()}
    held = {x["doc_id"] for x in d.where(quality.held_out(F.col("doc_id"))).collect()}
    assert 50 < len(held) < 150 and np.mean([(s[i] >= 0.7) == bool(y) for i, y in labels if i in held]) > 0.95
    many = docs(spark, [(1, "same text here")] * 3000 + [(2, "other ###"), (2, "another ###")])
    assert quality.train(many, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), rows=2).p["mean"].shape == (quality.N_FEATURES,)
    odd = spark.createDataFrame(ODD, DOCS)
    assert all(0 <= x["score"] <= 1 for x in quality.score(odd, m).collect())
    assert quality.train(d, lab.limit(0)) == 0.5 and quality.train(d, lab.where("quality = 1")) == 1.0
    assert quality.score(odd.limit(0), m).count() == 0


# 10

def test_fold_and_render(spark):
    log = [("c", 1, 1, "message", "user", "hi"), ("c", 2, 2, "message", "assistant", ""), ("c", 2, 3, "delta", None, "wr"), ("c", 2, 4, "delta", None, "ong"), ("c", 2, 5, "regenerate", None, None), ("c", 2, 6, "delta", None, "ri"), ("c", 2, 7, "delta", None, "ght"), ("c", 1, 8, "edit", None, "hello"), ("c", 3, 9, "message", "user", "gone"), ("c", 3, 10, "delete", None, None), (None, 1, 1, "message", None, None)]
    e = spark.createDataFrame(log, "conv_id string, message int, seq int, type string, role string, text string").repartition(3)
    m = chat_format.fold_events(e)
    assert [(r["message"], r["role"], r["text"]) for r in m.where("conv_id = 'c'").orderBy("message").collect()] == [(1, "user", "hello"), (2, "assistant", "right")]
    x = chat_format.render(m).where("conv_id = 'c'").first()
    assert [x["formatted"][s["start"] : s["end"]] for s in x["loss_spans"]] == ["right"]
    assert chat_format.format_chats(e.limit(0)).count() == 0


def test_rows_become_a_log_that_folds_back(spark):
    rows = [("c", 1, "user", "hello"), ("c", 1, "user", "hello"), ("c", 2, "assistant", "an answer"), ("c", None, "user", "first of all"), ("c", 2, "assistant", None)]
    log = chat_format.as_events(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"))
    kinds = Counter(r["type"] for r in log.collect())
    assert kinds["regenerate"] == 2 and kinds["edit"] == 2 and kinds["delta"] > kinds["message"]
    x = chat_format.format_chats(log).select("loss_spans", "formatted", chat_format.read_back(F.col("formatted")).alias("t")).first()
    assert [tuple(t) for t in x["t"]] == [("user", "first of all"), ("user", "hello"), ("user", "hello"), ("assistant", ""), ("assistant", "an answer")]
    assert [x["formatted"][s["start"] : s["end"]] for s in x["loss_spans"]] == ["", "an answer"]


def test_null_sequence_comes_first(spark):
    log = [("c", 1, 5, "message", "user", "b"), ("c", 2, None, "message", "user", "a"), ("c", 2, 9, "delta", None, "!")]
    e = spark.createDataFrame(log, "conv_id string, message int, seq int, type string, role string, text string")
    assert chat_format.format_chats(e).first()["formatted"] == "<turn user>\na!</turn>\n<turn user>\nb</turn>\n"


def test_running_sums(spark):
    from mnemolake.llm._common import running_sums

    n = [random.Random(1).randrange(9) for _ in range(1000)]
    df = spark.createDataFrame([(n,), ([],), ([4],)], "a array<long>")
    assert [r[0] for r in df.select(running_sums(F.col("a"))).collect()] == [list(itertools.accumulate(n)), [], [4]]


def test_round_trip(spark):
    r = random.Random(6)
    parts = ["<turn user>\n", "</turn>\n", "\\", "\\l", "\\b", "<", ">", "é😀", "\n", "assistant", ""]
    rows = [(c, t, r.choice(["user", "assistant", "system", "a>b", None]), r.choice([None, "".join(r.choices(parts, k=6))])) for c in range(20) for t in range(r.randint(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat_format.format_chats(chat_format.as_events(df))
    back = {x["conv_id"]: x for x in out.select("conv_id", "formatted", "loss_spans", chat_format.read_back(F.col("formatted")).alias("turns")).collect()}
    for c in range(20):
        want = [(role or "", text or "") for _, _, role, text in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        assert [tuple(t) for t in back[c]["turns"]] == want
        said = [back[c]["formatted"][s["start"] : s["end"]] for s in back[c]["loss_spans"]]
        plain = lambda s: s.replace("\\l", "<").replace("\\g", ">").replace("\\b", "\\")
        assert list(map(plain, said)) == [t for role, t in want if role == "assistant"]


def test_summary_follows_the_spans(spark):
    rows = [("c", 1, "user", "hi"), ("c", 2, "assistant", "é😀 <\\b>"), ("c", 3, "assistant", ""), ("c", 4, "assistant", "end"), ("d", 1, "user", "alone")]
    out = chat_format.format_chats(chat_format.as_events(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")))
    loss = lambda df: {r["conv_id"]: (r["loss_chars"], r["loss_sha256"]) for r in chat_format.summary(df).collect()}
    says = lambda t: (len(t), hashlib.sha256(t.encode()).hexdigest())
    assert loss(out) == {"c": says("é😀 <\\b>end"), "d": says("")}
    wrong = out.withColumn("loss_spans", F.slice("loss_spans", 2, 9))
    assert loss(wrong)["c"] == says("end")


# queries and pipeline

def test_probe_conversation(spark):
    x = chat_format.op10_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    t = r"\### Assistant: </turn> ok"
    assert x["n_turns"] == 2 and x["loss_chars"] == len(t)
    assert x["loss_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert x["turns_sha256"] == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    read = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    at = spark.read.parquet(f"{sf}/documents.parquet")
    texts = read(at)
    good = {r["doc_id"] for r in P.quality(spark, at, sf).collect()}
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert np.mean([(i in good) == bool(label[i]) for i in texts if i in label]) > 0.9
    at = at.where(F.col("doc_id").isin(*good))

    rows = sorted(read(at).items())
    gone = gone_lines(rows)
    at = P.line_dedup(spark, at, sf).cache()
    left = {i: without(t, i, gone) for i, t in rows}
    assert read(at) == {i: t for i, t in left.items() if t is not None}
    assert at.where("n_chars != length(text)").isEmpty()

    rows = sorted(read(at).items())
    least = class_of(rows)
    at = P.near_dedup(spark, at, sf).cache()
    assert read(at) == {i: t for i, t in rows if not shingles(t) or least[i, t] == i}

    rows = sorted(read(at).items())
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    at = P.decontaminate(spark, at, sf).cache()
    kept = read(at)
    flat = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    for i, t in rows:
        share = max(np.mean([" ".join(w[n : n + 8]) in flat(t) for n in range(len(w) - 7)]) for x in items if len(w := flat(x).split()) >= 8)
        assert (i in kept) == (share < 0.5)

    out = {r["doc_id"]: r for r in P.mixture(spark, at, sf).collect()}
    assert set(out) <= set(kept) and all(0 < r["taken"] <= 3 * r["size"] for r in out.values())
    total = sum(len(re.findall(r"[^\x20\x09-\x0d]+", t)) for t in kept.values())
    assert sum(r["taken"] for r in out.values()) == pytest.approx(total, rel=0.02)


def test_stages_with_odd_rows(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    rows = ODD + [(i, " ".join(words(50, i % 3)) + "\nRead more", "en", "s", 9) for i in range(10, 19)]
    odd = spark.createDataFrame(rows, DOCS).select("*", *[F.lit("x").alias(c) for c in ("_key", "_digest", "_leak", "_nth", "_gone", "score", "k")])
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns and out.where("_key != 'x' OR _leak != 'x'").isEmpty(), name
        assert stage(spark, odd.limit(0), sf).count() == 0, name
    left = P.near_dedup(spark, P.line_dedup(spark, odd, sf), sf)
    assert sorted(r["doc_id"] for r in left.where("doc_id >= 10").collect()) == [10, 11, 12]
    assert P.mixture(spark, odd, sf).where("taken <= 0").isEmpty() and P.mixture(spark, odd.limit(0), sf).count() == 0


def test_pipeline_runs(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    raw = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, raw, sf).columns == raw.columns, name
    out = P.run(spark, sf)
    assert out.where("taken <= 0 OR taken > 3 * size").isEmpty() and out.count() > 50
