"""Groups of many near copies and ids picked by a bitmap: every link is found, with work that does not grow with the square of a group's size."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import common, ngram_join, paragraph_dedup


def text_of(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def changed(words, times, seed):
    r, out = random.Random(seed), list(words)
    for i in r.sample(range(len(out)), times):
        out[i] = f"e{seed}x{i}"
    return " ".join(out)


def grams(text, k):
    words = text.split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def smallest(sets, percent):
    root = {i: i for i in sets}
    for _ in sets:
        before = dict(root)
        for i, a in sets.items():
            for j, b in sets.items():
                if i < j and 100 * len(a & b) >= percent * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    return root


@pytest.fixture
def compared(monkeypatch):
    """Rows sent to be compared, by call."""
    sent, real = [], ngram_join._compare

    def counted(rows, *rest):
        sent.append(rows.count())
        return real(rows, *rest)

    monkeypatch.setattr(ngram_join, "_compare", counted)
    return sent


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("size", [60, 1700])
def test_many_probes_at_once_equal_one_by_one(percent, size):
    r = np.random.default_rng(size + percent)
    base, sets = r.integers(1, 2**63, size).astype(np.uint64), []
    for _ in range(40):
        other = r.integers(1, 2**63, size).astype(np.uint64)
        sets.append(np.unique(np.where(r.random(size) < r.uniform(0, 0.2), other, base)[: size - r.integers(0, size // 6)]))
    sets += [np.zeros(0, np.uint64), base[:1]]
    trie = ngram_join.SetTrie(sets, percent)
    found = {x: sorted(y.tolist()) for x, y in trie.similar_to_each(list(range(len(sets))))}
    want = {i: [j for j, b in enumerate(sets) if j != i and len(a) and 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))] for i, a in enumerate(sets)}
    assert {x: y for x, y in found.items() if len(sets[x])} == {x: y for x, y in want.items() if len(sets[x])}
    # with only some sets compared with the others, no similar pair of those is lost
    first = ngram_join.plausible([len(s) for s in sets], [ngram_join.sketch(s) for s in sets], percent, 10)
    assert all(first[i] and first[j] for i in range(10) for j in want[i])


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_large_group_in_tiles_equals_brute_force(spark, monkeypatch, k, percent):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "SKETCHED", 6)
    monkeypatch.setattr(ngram_join, "TILED", 100)
    base, other = text_of(100, 1), text_of(130, 2)
    texts = [changed(base, i % 12, i) for i in range(70)] + [changed(other, i % 9, 500 + i) for i in range(30)]
    texts += [" ".join(base[:90 - i] + text_of(10 + i, 900 + i)) for i in range(0, 40, 4)] + texts[:3]
    random.Random(3).shuffle(texts)
    got = ngram_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=k, percent=percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == smallest({i: grams(t, k) for i, t in enumerate(texts)}, percent)


def test_unlike_members_of_a_large_group_are_not_compared_with_all(spark, monkeypatch, compared):
    """Texts that share a passage, but are not alike, in a group over ``SKETCHED``: their texts were sent to every block."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "SKETCHED", 32)
    monkeypatch.setattr(ngram_join, "HEAVY", 1)
    passage = text_of(40, 1)
    texts = [" ".join(passage + text_of(60, 10 + i)) for i in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = ngram_join.jaccard_components(rows).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got)
    assert sum(compared) < 50, compared


def test_edited_lines_of_a_large_group_meet_in_tiles(spark, monkeypatch, compared):
    """Lines outside their group's main component met every block of it, one by one."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    base = text_of(40, 1)
    lines = [changed(base, i % 6, i) for i in range(160)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    bands = paragraph_dedup._units(docs).where("kind = 2").selectExpr("h AS gram", "doc", "n", "doc AS s1")
    members = bands.groupBy("gram").agg(F.count("*").alias("m")).where("m > 4").agg(F.sum("m")).first()[0]
    ngram_join.grouped_links(bands, paragraph_dedup._paragraphs(docs), paragraph_dedup.SHINGLE, paragraph_dedup.PERCENT, once=True).collect()
    assert compared[-1] <= 3 * members, (compared, members)


def test_ids_by_bitmap(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(3000)] + [(5, "again"), (None, "none"), (-4, "x"), (2**62, "y")], "doc_id long, text string")
    ids = spark.createDataFrame([(5,), (5,), (-4,), (None,), (2**62,), (10**9,), *((7 * i,) for i in range(100))], "doc long")
    want = sorted([(i, f"t{i}") for i in {5, *range(0, 700, 7)}] + [(5, "again"), (-4, "x"), (2**62, "y")])
    for bits in (common.ID_BITS, 64):  # few bits let others through, the join drops them
        monkeypatch.setattr(common, "ID_BITS", bits)
        assert sorted(map(tuple, common.with_ids(rows, "doc_id", ids).collect())) == want
    assert common.with_ids(rows, "doc_id", ids.limit(0)).count() == 0
