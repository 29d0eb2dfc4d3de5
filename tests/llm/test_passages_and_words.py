"""Spelling variants, toxic segments and periodic runs: brute force, held-out accuracy and odd rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from barloom.llm import periodic_runs, spelling_variants, toxicity
from barloom.llm.wordhash import words_of

ODD = [
    (1, None, "a", 1), (2, "", "b", 2), (3, " \n\t ", "a", 3), (4, "one", "a", 4), (5, "one", "a", 4), (5, "one", "a", 4), (6, "ONE two\nÉÀ × ÷ é🙂", "b", 5),
    (7, "word " * 60_000, "a", 6), (None, "a b " * 40, None, 8), (11, "x" * 200_000, "b", 9), (12, "x" * 200_000, "b", 9),
]
SCHEMA = "doc_id long, text string, runs string, score int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_runs(ws):
    out = []
    for q in range(1, len(ws) // 4 + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q) and not any(all(ws[x] == ws[x + d] for x in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(r):
    k = r.choice((1, 2, 2, 3, 5))
    ws = [r.choice("abcde"[:k]) for _ in range(r.randrange(80))]
    if r.random() < 0.5:
        block = [r.choice("abc"[:k]) for _ in range(r.randrange(1, 12))]
        ws = ws[: r.randrange(20)] + (block * 12)[: r.randrange(1, 12 * len(block))] + ws[: r.randrange(10)]
    return ws


def test_runs_equal_brute_force():
    r = random.Random(3)
    for _ in range(300):
        texts = [some_words(r) for _ in range(4)]
        w = words_of([" ".join(x).encode() for x in texts])
        found = [[] for _ in texts]
        for s, n, q in zip(*(x.tolist() for x in periodic_runs.find_runs(w))):
            found[w.owner[s]].append((s - int(w.first[w.owner[s]]), n, q))
        assert found == [brute_runs(x) for x in texts]


def test_runs_and_collapsed_text(spark, odd, none):
    got = {r["doc_id"]: r for r in periodic_runs.periodic_runs(odd).collect()}
    assert [tuple(x) for x in got[7]["runs"]] == [(0, 60_000, 1)] and got[7]["collapsed"] == "word"
    assert [tuple(x) for x in got[None]["runs"]] == [(0, 80, 2)] and got[None]["collapsed"] == "a b"
    assert all(got[i]["runs"] == [] and got[i]["collapsed"] == "" for i in (1, 2, 3)) and got[6]["collapsed"] == "ONE two ÉÀ × ÷ é🙂"
    assert periodic_runs.periodic_runs(none).count() == 0
    both = periodic_runs.periodic_runs(odd, keep=("doc_id", "runs"), prefix="found_")
    assert both.columns == ["doc_id", "runs", "found_runs", "found_collapsed"] and both.count() == len(ODD)


def test_run_digests(spark, odd, none):
    r = random.Random(5)
    rows = [(i, None if i % 17 == 0 else " ".join(some_words(r))) for i in range(200)]
    got = {x["doc_id"]: x for x in periodic_runs.run_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    changed = 0
    for i, text in rows:
        ws, h = (text or "").split(), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and ws:
            a = g % len(ws)
            p = 1 + (len(ws) - a) // (3 + g % 8)
            ws = [w if j < a else ws[a + (j - a) % p] for j, w in enumerate(ws)]
            changed += 1
        runs = brute_runs(ws)
        gone = {j for s, n, q in runs for j in range(s + q, s + n)}
        x = got[i]
        assert x["n_runs"] == len(runs)
        assert x["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert x["collapsed_sha256"] == hashlib.sha256(" ".join(w for j, w in enumerate(ws) if j not in gone).encode()).hexdigest()
        best = min(runs, key=lambda v: (-v[1], v[0], v[2]), default=(None, None, None))
        assert (x["start"], x["length"], x["period"]) == best and x["exponent_milli"] == (best[1] and 1000 * best[1] // best[2])
    assert changed > 5 and periodic_runs.run_digests(odd).count() == len(ODD) and periodic_runs.run_digests(none).count() == 0


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(counts):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v.encode()), default=None)
        out[w] = (best if best is not None and counts[best] >= 10 * n else None, n, len(near))
    return out


def test_variants_equal_brute_force(spark):
    r = random.Random(9)
    syllables = ["ba", "be", "dé", "on", "ñi", "st", "zz", "à"]
    stems = ["".join(r.choice(syllables) for _ in range(r.randrange(3, 7))) for _ in range(60)]
    texts = []
    for i in range(150):
        ws = []
        for _ in range(60):
            w = r.choice(stems[: r.choice((5, 60))])
            if r.random() < 0.2:
                j = r.randrange(len(w))
                w = r.choice((w[:j] + w[j + 1 :], w[:j] + r.choice("abé") + w[j + 1 :], w[:j] + r.choice("abé") + w[j:], w.capitalize(), w[::-1]))
            ws.append(w)
        texts.append((i, r.choice((" ", ", ", "1")).join(ws)))
    counts = Counter()
    import re

    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    want = brute_variants({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    # tiny cells and a sample smaller than the vocabulary: words cross cells
    for more in ({}, {"sample": 80, "cell": 8}):
        rows = spelling_variants.spelling_variants(docs, **more).collect()
        got = {x["word"]: (x["form"], x["n"], x["n_near"]) for x in rows}
        assert got == want and len(rows) == len(want)
        for x in rows:
            end = x["word"]
            while want[end][0] is not None:
                end = want[end][0]
            assert x["root"] == end and x["form_n"] == (want[x["form"]][1] if x["form"] else None)
    assert sum(x["form"] is not None for x in rows) > 10


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i:02}", f"w{i + 1:02}") for i in range(13)]
    got = {r["word"]: r["root"] for r in spelling_variants.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {a: "w13" for a, _ in chain}


def test_variants_of_odd_rows(spark, odd, none):
    got = {r["word"]: r for r in spelling_variants.spelling_variants(odd).collect()}
    assert set(got) == {"x" * 200_000} and got["x" * 200_000]["n"] == 2 and got["x" * 200_000]["root"] == "x" * 200_000
    assert spelling_variants.spelling_variants(none).count() == 0


def brute_segments(scores):
    """Maximal segments by their definition: the best segment, then the parts before and after it."""
    best = max(((sum(scores[i:j]), i - j, -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 1e-9:
        return []
    i, j = best[3], best[4]
    return brute_segments(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute_segments(scores[j:])]


def test_maximal_segments():
    r = np.random.default_rng(4)
    for _ in range(200):
        scores = np.round(r.normal(-0.2, 1, r.integers(0, 25)), 3) + 1e-6 * r.random()
        got = toxicity.maximal_segments(scores)
        want = brute_segments(scores.tolist())
        assert [round(v, 6) for _, _, v in got] == [round(float(scores[a:b].sum()), 6) for a, b in want]
        assert len(got) == len(want) and all(abs(scores[a:b].sum() - v) < 1e-9 for a, b, v in got)


def test_extreme_values():
    r = np.random.default_rng(6)
    n = r.integers(50, 2000, 4000).astype(float)
    sums = (np.log(0.02 * n) - np.log(-np.log(r.random(4000)))) / 1.5
    decay, scale = toxicity.extreme_values(sums[sums > 0], n[sums > 0])
    assert abs(decay - 1.5) < 0.1 and abs(scale - 0.02) < 0.006


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_documents(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    assert rows["score"].between(0, 1).all() and ((rows["score"] >= 0.3) == (rows["predicted"] == 1)).all()
    ranks, y = rows["score"].rank().to_numpy(), rows["toxic"].to_numpy() == 1
    area = (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert area > 0.95 and rows["predicted"][y].mean() > 0.85 and rows["predicted"][~y].mean() < 0.03


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, "q") for i in range(1, 300)] + [(None, 1, "q"), (7, None, "q"), (8, 5, "q")], "doc_id long, toxic int, text string")
    calm = "the clear morning brought a long walk along quiet water and everyone talked about bread "
    docs = odd.select("doc_id", "text").union(
        spark.createDataFrame([(i, calm * 3 + (f"you vile wretch{'abc'[i % 3]} " * 3 if i % 2 else "") + f"item{i % 40}") for i in range(13, 300)], "doc_id long, text string")
    )
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    assert toxicity.score_documents(docs, labels).count() == docs.count()
    assert all(0 <= got[i]["score"] < 0.3 and got[i]["predicted"] == 0 for i in (1, 2, 3)) and not got[None]["held_out"]
    far = [i for i in range(13, 300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i in far) and np.mean([got[i]["predicted"] == i % 2 for i in far]) > 0.95
    model = toxicity.learn(docs, labels)
    passage = toxicity.toxic_passages(docs.where("doc_id = 15"), model).first()["passages"]
    words = (calm * 3 + "you vile wretcha " * 3).split()
    assert len(passage) == 1 and "vile" in words[passage[0]["start"] : passage[0]["end"]] and passage[0]["start"] >= 45
    assert toxicity.score_documents(none, labels).count() == 0
    without = toxicity.score_documents(docs, labels.where("toxic = 0")).collect()
    assert all(r["score"] == 0 and r["predicted"] == 0 for r in without)
