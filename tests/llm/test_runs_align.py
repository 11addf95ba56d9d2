"""Periodic runs and cross-tokenizer alignment: brute force, odd inputs, long texts."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from mnemolake.llm import align, runs

DOCS = "doc_id long, text string, runs string, groups string"
ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "no id here"), (4, " \n\t ")]
SF = "/root/testdata/sf0.001/documents.parquet"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS)


# 12

def brute_runs(w, least):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            k = i
            while k + q < len(w) and w[k] == w[k + q]:
                k += 1
            if k - i >= q and k - i + q >= least:
                found.setdefault((i, k - i + q), q)
            i = k + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def test_runs_against_brute_force():
    r = random.Random(5)
    for trial in range(1500):
        w = [r.randint(1, r.randint(1, 4)) for _ in range(r.randint(0, 60))]
        while trial % 3 == 0 and len(w) < 90:
            w += (w[r.randint(0, max(0, len(w) - 1)) :] or [1]) * r.randint(1, 3)
        assert runs.runs_of(w, 2) == brute_runs(w, 2)
        got = [(s + a, n, p) for a, b in runs.stretches(np.array(w, np.int64), np.zeros(len(w), np.int64)) for s, n, p in runs.runs_of(w[a:b])]
        assert got == brute_runs(w, 12)


def test_runs_of_many_periods_take_linear_time():
    a, b = [1], [1, 2]
    while len(b) < 100_000:
        a, b = b, b + a
    for w in (b, [1] * 100_000, list(range(500)) * 200, ([1] * 300 + [2]) * 300):
        steps = [0]

        class Counted(list):
            def __getitem__(self, k):
                steps[0] += 1
                return list.__getitem__(self, k)

        runs.next_smaller(Counted(w))
        assert steps[0] < 12 * len(w)


def test_find_runs(spark):
    r = random.Random(1)
    texts = [" ".join(r.choices("ab", k=r.randint(0, 40))) + "\n" + " ".join(["x y  z"] * r.randint(0, 6)) for _ in range(60)]
    rows = [*ODD, *((i + 10, t) for i, t in enumerate(texts)), (200, "u v w " * 200_000)]
    out = runs.find_runs(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    got = Counter((r["doc_id"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in out)
    want = Counter()
    for i, t in rows:
        w = (t or "").encode().split()
        w = [x.decode() for x in w]
        found = brute_runs(w, 12) if i != 200 else [(0, 600_000, 3)]
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        want[i, tuple(found), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    assert got == want
    assert runs.find_runs(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(docs(spark, []), least=8)


# 13

def brute_links(texts):
    """(n_a, n_b, groups, links) of each text, encoded whole, and what its columns are."""
    with open(align.A_FILE, encoding="utf-8") as f, open(align.B_FILE, "rb") as g:
        coder = align.Coder(f.read(), g.read())
    each = []
    for t in texts:
        a, al, b, bl = next(coder.encode([t])) if t else (None,) * 4
        groups = []
        if a is not None:
            ae, be = np.cumsum(al).tolist(), np.cumsum(bl).tolist()
            x = y = 0
            for end in sorted(set(ae) & set(be)):
                p, q = ae.index(end, x) + 1, be.index(end, y) + 1
                groups.append((a[x:p], b[y:q]))
                x, y = p, q
        each.append(groups)
    counts = Counter(p for g in each for p in {(x, y) for a, b in g for x in a for y in b})
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    out = []
    for g in each:
        links = [(x, y) for a, b in g for x in a for y in b]
        s = ";".join("|".join(",".join(map(str, side)) for side in pair) for pair in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), s))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def test_stretches_give_the_tokens_of_whole_texts():
    with open(align.A_FILE, encoding="utf-8") as f, open(align.B_FILE, "rb") as g:
        raw = f.read()
        coder = align.Coder(raw, g.read())
    assert coder.stretches_end_tokens(raw)
    r = random.Random(2)
    pool = [*"abz'sé \t\n ▁1,.<>|\xa0　\x1c\x85​😀ﬁ", "<|endoftext|>", "<s>", "<0x41>", "the ", " of", "\r\n", "don't", " 's"]
    for _ in range(3000):
        t = "".join(r.choices(pool, k=r.randint(1, 30)))
        assert " ".join(align.stretches(t)) == t
        whole, parts = next(coder.encode([t])), list(coder.encode(align.stretches(t)))
        if any(p[0] is None for p in parts):
            assert whole[0] is None
        else:
            assert list(whole) == [sum((p[k] for p in parts), []) for k in range(4)]


def test_stretches_aligned_at_once():
    """Many stretches encoded as one text have the groups of each alone; those without tokens are found among them."""
    with open(align.A_FILE, encoding="utf-8") as f, open(align.B_FILE, "rb") as g:
        coder = align.Coder(f.read(), g.read())
    r = random.Random(4)
    pool = [*"abz'sé1,.<>|　\x85​😀", "<|endoftext|>", "the", "tion", " \n", "  "]
    texts = ["".join(r.choices(pool, k=r.randint(1, 12))) + "x" for _ in range(2000)]
    texts = [*dict.fromkeys(s for t in texts for s in align.stretches(t) if s and not s[-1].isspace()), "ﬁ", "▁", "end\n"]
    got = [np.concatenate(x) for x in zip(*coder.align(texts), strict=True)]
    known = align._Aligned(*got)
    assert len(known.groups) == len(texts)
    want = brute_links(texts)
    assert known.strings() == [b[-1] + ";" * bool(b[-1]) for b in want]
    sizes = (known.a_at[known.bounds], known.b_at[known.bounds], known.bounds, known.at)
    assert list(zip(*(np.diff(x).tolist() for x in sizes), strict=True)) == [b[:4] for b in want]
    assert sum(n == 0 for n in known.groups) == sum(not b[-1] for b in want) > 0


def test_links_against_brute_force(spark):
    r = random.Random(3)
    pool = [*"abé ,\n1", "the ", " of", "tion ", "<|endoftext|>", "😀", "é", " ▁"]
    texts = ["".join(r.choices(pool[:-1] if i % 5 else pool, k=r.randint(1, 80))) for i in range(120)]
    texts += texts[:7] + [" ", "  two  spaces ", "\n" * 3000, " " * 3000, "x" * 5000, "ab " * 10_000]
    rows = [*ODD, *((i + 10, t) for i, t in enumerate(texts))]
    want = Counter((i, *b) for (i, _), b in zip(rows, brute_links([t for _, t in rows])))
    for chars in (align.BLOCK_CHARS, 500):
        out = align.link_documents(docs(spark, rows), block_chars=chars).collect()
        assert Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in out) == want
    assert align.link_documents(docs(spark, [])).count() == 0


def test_whole_texts_where_stretches_end_no_token(spark, monkeypatch):
    rows = [(1, "the the of"), (2, "the of"), (3, "a ▁ b")]
    want = sorted((i, *b) for (i, _), b in zip(rows, brute_links([t for _, t in rows])))
    monkeypatch.setattr(align.Coder, "stretches_end_tokens", lambda *_: False)
    out = align.link_documents(docs(spark, rows)).collect()
    assert sorted((r["doc_id"], *(r[c] for c in COLUMNS)) for r in out) == want


def test_op13(spark):
    if not os.path.exists(SF):
        pytest.skip("no driver tables")
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(SF).collect()]
    want = [(i, *b[:-1], hashlib.sha256(b[-1].encode()).hexdigest() if b[-1] else "") for (i, _), b in zip(rows, brute_links([t for _, t in rows]))]
    out = align.op13_align(spark, os.path.dirname(SF)).collect()
    assert sorted((r["doc_id"], *(r[c] for c in (*COLUMNS[:-1], "groups_sha256"))) for r in out) == sorted(want)


# 7

def test_long_white_space_in_token_counts(spark, monkeypatch):
    """Equal to the plain encoding where that works; 5 million blanks, which it can't do, are counted too."""
    import re

    from mnemolake.llm import token_counts as T

    with open(T.VOCABULARY, "rb") as f:
        encoder, _ = T._encoder(f.read())
    r = random.Random(6)
    monkeypatch.setattr(T, "LONG_SPACE", re.compile(T.LONG_SPACE.pattern.replace("10000", "5")))
    for _ in range(3000):
        t = "".join(r.choice(["a", "'s", "1", ".", "é", " " * r.randint(1, 12), "\n" * r.randint(1, 9), "\t\x85　" * r.randint(1, 4), "\x1c" * 7]) for _ in range(r.randint(1, 12)))
        assert T.ids_of(encoder, t) == encoder.encode_ordinary(t)
    monkeypatch.undo()
    big = "a b" + " " * 5_000_000 + "c\n" + "\n" * 1_000_000
    out = T.section_counts(spark.createDataFrame([(1, big), (2, " " * 20_000 + "x")], "doc_id long, text string")).collect()
    got = {x["doc_id"]: x["tokens"] for x in out}
    assert got[2] == len(encoder.encode_ordinary(" " * 20_000 + "x")) and got[1] > 2_000_000
