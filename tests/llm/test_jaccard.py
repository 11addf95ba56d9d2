"""The n-gram Jaccard join: brute force on groups of near copies and shared passages, odd inputs, and what it compares."""

import random
from collections import Counter

from mnemolake.llm import jaccard_join

DOCS = "doc_id long, text string, node string, component_id string"
ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "no id here"), (None, "no id here"), (4, " \n\t "), (5, "ONE two"), (6, "one\ttwo"), (7, "Éa b"), (8, "éa b")]


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS)


def brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = [x.decode() for x in (t or "").translate(lower).encode().split()]
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    head = list(range(len(rows)))

    def root(i):
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 90 * len(x | sets[j]):
                head[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return Counter((d, len(x), least.get(root(i)) if x else d) for i, ((d, _), x) in enumerate(zip(rows, sets)))


def made(seed):
    """Groups of copies with few and many edits, texts that share passages, chains of small steps, and equal texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 6)))
    passage = [word() for _ in range(120)]
    texts = []
    for size, n, most in ((40, 200, 6), (30, 90, 4), (25, 60, 3), (12, 14, 1)):
        base = [word() for _ in range(n)]
        for _ in range(size):
            t = list(base)
            for _ in range(r.randint(0, most)):
                t[r.randrange(len(t))] = word()
            if r.random() < 0.3:
                t = t[: r.randint(n - n // 12, n)]
            texts.append(t)
    texts += [passage + [word() for _ in range(r.randint(0, 25))] for _ in range(40)]
    t = [word() for _ in range(100)]
    for i in range(25):
        t = list(t)
        t[(i * 7) % 100] = word()
        texts.append(t)
    rows = [(i + 10, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(i + 500, rows[i][1].upper()) for i in range(0, len(rows), 9)] + rows[:3] * 2
    r.shuffle(rows)
    return rows


def got(spark, rows):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs(spark, rows).repartition(3)).collect())


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = made(seed) + ODD
        assert got(spark, rows) == brute(rows)


def test_long_texts_and_empty_tables(spark):
    r = random.Random(4)
    long = [str(r.randrange(10**6)) for _ in range(300_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:290_000])), (3, " ".join(long[:200_000])), (4, "x" * 1_000_000)]
    assert got(spark, rows) == Counter({(1, 299_998, 1): 1, (2, 289_998, 1): 1, (3, 199_998, 3): 1, (4, 1, 4): 1})
    assert jaccard_join.jaccard_components(docs(spark, [])).count() == 0


def test_shared_passages_are_not_compared(spark, monkeypatch):
    """Texts that share 300 words and have 40 of their own: no pair is listed, however many they are."""
    listed = []
    links = jaccard_join.Join.compared

    def counted(self, pairs):
        listed.append(pairs.distinct().count())
        return links(self, pairs)

    monkeypatch.setattr(jaccard_join.Join, "compared", counted)
    passage = [f"p{i}" for i in range(300)]
    for n in (100, 400):
        rows = [(i, " ".join(passage + [f"w{i}x{k}" for k in range(40)])) for i in range(n)]
        listed.clear()
        assert len(got(spark, rows)) == n and sum(listed) == 0
    rows = [(i, " ".join([*passage, f"w{i}"])) for i in range(400)]  # copies, each with a word of its own: a star
    listed.clear()
    assert {k[2] for k in got(spark, rows)} == {0} and sum(listed) < 2 * 400 * 2


def test_near_dedup_compares_no_texts_that_only_share_a_passage(spark, monkeypatch):
    """Texts with 300 words in common and 40 of their own: crowded buckets, but none has a partner; with near copies among them, only those."""
    from mnemolake.llm import near_dedup

    rows = []
    hopeful = near_dedup.hopeful

    def counted(*args):
        out = hopeful(*args)
        rows.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "hopeful", counted)
    passage = [f"p{i}" for i in range(300)]
    for n in (100, 400):
        texts = [(i, " ".join(passage + [f"w{i}x{k}" for k in range(40)])) for i in range(n)]
        out = near_dedup.classify(spark.createDataFrame(texts, "doc_id long, text string")).collect()
        assert {r["class_id"] for r in out} == set(range(n))
    assert rows == [0, 0]


def test_near_dedup_counts_shared_shingles_in_lots(spark):
    """What texts have beyond their centre comes in rows of lots, not of shingles; the counts are those of each shingle."""
    from collections import Counter

    from mnemolake.llm import near_dedup

    r = random.Random(8)
    rows = [(bytes([a]) * 16, i.to_bytes(16, "big"), i, r.sample(range(-300, 3000), r.randint(0, 60)) + [5000 + a]) for a in (1, 2, 3) for i in range(200)]
    seen = Counter((a, t) for a, _, _, x in rows for t in x)
    want = {(a, d): (s, sum(seen[a, t] > 1 for t in x)) for a, d, s, x in rows}
    far = spark.createDataFrame(rows, "a binary, digest binary, shared long, beyond array<long>")
    for lot in (near_dedup.LOT, 500):
        out = near_dedup._others(far, lot)
        assert {(bytes(x["a"]), bytes(x["digest"])): (x["shared"], x["others"]) for x in out.collect()} == want
        assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert near_dedup._others(far.limit(0)).count() == 0


def test_near_dedup_sends_pairs_in_small_batches(spark, monkeypatch):
    """Pairs carry both texts' shingles: they aren't sent to Python 64 MB at a time, which took 3 GB of an executor with crowded buckets."""
    from mnemolake.llm import near_dedup

    name, seen, verify = "spark.sql.execution.arrow.maxBytesPerBatch", [], near_dedup._verify
    before = spark.conf.get(name)
    monkeypatch.setattr(near_dedup, "_verify", lambda *args: (seen.append(spark.conf.get(name)), verify(*args))[1])
    near_dedup.classify(docs(spark, [(1, "a b c d e f"), (2, "a b c d e f g")])).collect()
    assert set(seen) == {"8m"} and spark.conf.get(name) == before
