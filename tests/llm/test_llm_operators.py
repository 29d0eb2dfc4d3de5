"""The operators on small tables: odd rows, ties, clashing names, and brute force where SQL has no answer."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from barloom.llm import (
    bpe_transducer, common, html_extract, language_id, ngram_join, packing, paragraph_dedup, projection_join, quality_rules, sharding, url_filter,
)

rng = random.Random(11)
VOCABULARY = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "r", "st", "l", "mp")]


def prose(n, seed=None):
    r = random.Random(seed) if seed is not None else rng
    return " ".join(r.choice(VOCABULARY) + (r.choice("xyz") * r.randrange(3)) for _ in range(n))


def edited(text, times, seed):
    r, words = random.Random(seed), text.split()
    for _ in range(times):
        words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
    return " ".join(words)


#: Null, empty, white, tiny and very long texts; repeated rows; a null id; extra columns with the operators' own names.
ODD = [
    (1, None, "a", 1, "q"), (2, "", "b", 2, "q"), (3, " \n\t ", "a", 3, None), (4, "one", "a", 4, "q"), (5, "one", "a", 4, "q"), (5, "one", "a", 4, "q"),
    (6, "ONE two\nONE two\n% # é🙂", "b", 5, "q"), (7, "word " * 60_000, "a", 6, "q"), (8, prose(400, 1), "a", 7, "q"), (9, prose(400, 1), "b", 7, "q"),
    (None, prose(80, 2), None, 8, "q"), (10, "x" * 200_000, "b", 9, "q"),
]
SCHEMA = "doc_id long, text string, lang string, size int, component string"
KINDS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_rules(spark, odd, none):
    got = quality_rules.repetition_rules(odd).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["base_failed"] and not by[i]["kept"] for i in (1, 2, 3, 4, 5, 6, 7, 10)) and by[8]["kept"] and by[9]["kept"] and by[None]["kept"]
    assert by[7]["n_words"] == 60_000 and by[7]["longest_repeat"] == 59_999 and by[6]["n_dup_lines"] == 1 and by[1]["n_words"] == 0
    block = prose(120, 5)
    twice = spark.createDataFrame([(1, prose(200, 6) + " " + block + " " + prose(150, 7)), (2, block + " " + prose(40, 8) + " " + block)], "doc_id int, text string")
    assert {r["doc_id"]: (r["kept"], r["covered_words"]) for r in quality_rules.repetition_rules(twice).collect()} == {1: (True, 0), 2: (False, 240)}
    kept = quality_rules.keep_unrepetitive(odd)
    assert kept.columns == odd.columns and kept.dtypes == odd.dtypes and {r["doc_id"] for r in kept.collect()} == {8, 9, None}
    assert quality_rules.repetition_rules(none).count() == 0


def test_sharding(spark, odd, none):
    got = sharding.shard_documents(odd).collect()
    assert len(got) == len(ODD) and sharding.shard_documents(none).count() == 0
    for r in got:
        text = next((t for i, t, *_ in ODD if i == r["doc_id"])) or ""
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "key")
        assert r["grown_shard"] in (r["shard"], 16)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_rendezvous_weights_and_growth(spark):
    ids = spark.range(20_000)
    from pyspark.sql import functions as F

    a = sharding.rendezvous(F.col("id"), [1.0, 2.0, 1.0])
    b = sharding.rendezvous(F.col("id"), [1.0, 2.0, 1.0, 4.0])
    rows = ids.select(a.alias("a"), b.alias("b"), sharding.rendezvous(F.col("id"), [1.0, 1.0], [0, 2]).alias("c")).collect()
    assert abs(sum(r["a"] == 1 for r in rows) / 20_000 - 0.5) < 0.02 and abs(sum(r["b"] == 3 for r in rows) / 20_000 - 0.5) < 0.02
    assert all(r["b"] in (r["a"], 3) for r in rows) and all(r["c"] == (2 if r["c"] == 1 else r["c"]) or r["c"] in (0, 2) for r in rows)
    assert {r["c"] for r in rows} == {0, 2}
    for bad in ([-1.0, 1.0], [0.0]):
        with pytest.raises(ValueError):
            sharding.rendezvous(F.col("id"), bad)


def test_packing(spark, odd, none):
    got = packing.pack_documents(odd).collect()
    assert packing.pack_documents(none).count() == 0
    total = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
        assert r["offset"] + r["length"] <= r["capacity"] and r["capacity"] in packing.CAPACITIES and r["start"] % max(packing.CAPACITIES) == 0
    words = lambda i: sum(len((t or "").split()) + 1 for j, t, *_ in ODD if j == i)
    assert total == {i: words(i) for i in {r[0] for r in ODD}}
    bins = {}
    for r in got:
        bins.setdefault((r["bin_id"], r["capacity"]), []).append((r["offset"], r["offset"] + r["length"]))
    assert len({b for b, _ in bins}) == len(bins)
    for spans in bins.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_urls(spark):
    urls = [
        (1, None, "v"), (2, "", "v"), (3, "no scheme.com/", "v"), (4, "http://WWW.Example.com/en/x?q#f", "v"), (5, "http://example.com/en/", "v"), (6, "http://badexample.com/en/", "v"),
        (7, "http://a.net/es/casino", "v"), (8, "http://a.net/de/casino", "v"), (9, "http://com", "v"), (10, "http://x.org?free=1&bet", "v"), (11, "http://x.org/free", "v"), (11, "http://x.org/free", "v"),
        (12, "a://b://c/d", "v"), (None, "http://net/fr/", "v"),
    ]
    got = url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string, verdict string")).collect()
    assert sorted((r["page_id"] or 0, r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == sorted([
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        (5, "example.com", "/en/", "example.com/en/", "block"), (6, "badexample.com", "/en/", "com/", "allow"), (7, "a.net", "/es/casino", "net/es/", "block"),
        (8, "a.net", "/de/casino", None, "block"), (9, "com", "", None, "allow"), (10, "x.org", "", None, "block"), (11, "x.org", "/free", None, "allow"), (11, "x.org", "/free", None, "allow"),
        (12, "b:", "//c/d", None, "allow"), (0, "net", "/fr/", "net/fr/", "block"),
    ], key=str) or sorted(map(str, got))
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_language(spark, odd, none):
    got = language_id.classify_documents(odd).collect()
    assert len(got) == len(ODD) and language_id.classify_documents(none).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["lang_rejected"] for i in (1, 2, 3))
    assert all(r["lang_pred"] in ("a", "b", "und") and 0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None) and not by[None]["held_out"]


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.classify_documents(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out").collect()
    long = [r for r in rows if r["n_chars"] >= 200]
    assert len(rows) > 250 and np.mean([r["lang"] == r["lang_pred"] for r in long]) > 0.98
    assert np.mean([r["lang_rejected"] for r in long]) < 0.01


def test_encoding(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = bpe_transducer.encode_documents(odd, path, public_tokenizers.PATTERN, with_ids=True)
    rows = got.collect()
    assert len(rows) == len(ODD)
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_transducer.read_ranks(path), special_tokens={})
    for (i, text, *_), r in zip(ODD, rows):
        if text is not None and len(text) > 100_000 and " " not in text:
            continue  # slow in the library
        ids = enc.encode_ordinary(text or "")
        assert r["doc_id"] == i and r["n_tokens"] == len(ids) and r["ids"] == ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert all(r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for (_, t, *_), r in zip(ODD, rows))
    texts = bpe_transducer.decode_documents(got, path).collect()
    assert [r["text"] for r in texts] == [t or "" for _, t, *_ in ODD]
    assert bpe_transducer.encode_documents(none, path, public_tokenizers.PATTERN).count() == 0


def shingle_set(text, k):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def smallest_reachable(ids, similar):
    component = {i: i for i in ids}
    for _ in ids:
        for i in ids:
            for j in similar[i]:
                low = min(component[i], component[j])
                component[i] = component[j] = low
    return component


def test_jaccard_join_odd_rows(spark, odd, none):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(odd).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (4, 6), 7: (1, 7), 8: (397, 8), 9: (397, 8), None: (77, None), 10: (1, 10)}
    assert ngram_join.jaccard_components(odd).count() == len(ODD) and ngram_join.jaccard_components(none).count() == 0


@pytest.mark.parametrize("block", [3, 128])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, block):
    """Large groups of near copies, chains, a passage that unlike texts share, whole copies; tiny blocks force every path."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    texts, passage = [], prose(60, 3)
    for family in range(3):
        base = prose(120 + 40 * family, 20 + family)
        texts += [edited(base, i % 9, 100 * family + i) for i in range(14)]
    chain = prose(150, 31)
    for i in range(12):  # each like its neighbours, the ends unlike
        texts.append(chain)
        chain = edited(chain, 2, 900 + i)
    texts += [prose(20 + 7 * (i % 5), 50 + i) + " " + passage + " " + prose(15, 80 + i) for i in range(16)]
    texts += [texts[0]] * 5 + [None, "", "a b", "A  b", "c"]
    random.Random(2).shuffle(texts)
    sets = {i: shingle_set(t, 4) for i, t in enumerate(texts)}
    similar = {i: [j for j, b in sets.items() if a and j != i and 100 * len(a & b) >= 85 * len(a | b)] for i, a in sets.items()}
    want = smallest_reachable(list(sets), similar)
    got = ngram_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("local", [0, 1_000_000])
def test_components_of_paths_stars_and_loops(spark, monkeypatch, local):
    monkeypatch.setattr(common, "LOCAL_EDGES", local)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(3, 3), (200, 201), (201, 202), (202, 200)]
    random.Random(1).shuffle(edges)
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 if 100 <= i <= 160 else 7 if i < 60 else 200 for i in [*range(100, 161), *range(7, 60), 200, 201, 202]}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_passages(spark, odd, none):
    got = paragraph_dedup.dedup_paragraphs(odd, keep=("lang", "component")).collect()
    assert len(got) == len(ODD) and paragraph_dedup.dedup_paragraphs(none).count() == 0
    by = {r["doc_id"]: r for r in got}
    source = {i: t for i, t, *_ in ODD}
    assert all(by[i]["text"] == source[i] for i in (1, 2, 3, 4, 5, 6, 8, 10, None)) and by[9]["text"] == "" and by[9]["n_words_removed"] == 400
    assert by[6]["component"] == "q" and by[6]["lang"] == "b"


def test_passages_inside_lines_and_near_copies(spark):
    passage, short, line = prose(60, 70), prose(12, 71), prose(70, 72)
    texts = [prose(30, 200 + i) + " " + passage + " " + prose(30, 300 + i) + "\n" + short + "\nend " + str(i) for i in range(6)]
    texts += [prose(25, 400 + i) + "\n" + edited(line, 1, i) for i in range(4)]
    clean = [prose(200, 500 + i) + "\n" + short for i in range(5)]
    rows = list(enumerate(texts + clean))
    got = {r["doc_id"]: r for r in paragraph_dedup.dedup_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["text"] for i in range(10, 15)] == clean and got[0]["text"] == texts[0] and got[6]["text"] == texts[6]
    for i in range(1, 6):
        assert passage not in got[i]["text"] and got[i]["text"].endswith(f"\n{short}\nend {i}") and 35 <= got[i]["n_words_removed"] <= 60
        assert got[i]["text"].startswith(prose(28, 200 + i)) and prose(30, 300 + i)[-60:] in got[i]["text"]
    for i in range(7, 10):
        assert got[i]["text"] == prose(25, 400 + i - 6) and got[i]["n_words_removed"] == 70


def test_passages_in_short_lines(spark):
    """A passage laid out in lines of ten words, and one with a short line inside, is a passage all the same."""
    words = prose(60, 73).split()
    wrapped = "\n".join(" ".join(words[i : i + 10]) for i in range(0, 60, 10))
    broken = prose(22, 74) + "\n" + prose(6, 75) + "\n" + prose(22, 76)
    texts = [prose(30, 700 + i) + "\n" + wrapped + "\n" + prose(30, 720 + i) for i in range(4)]
    texts += ["\n".join((prose(12, 740 + i) + " " + broken + " " + prose(12, 760 + i)).split("\n")) for i in range(4)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in paragraph_dedup.dedup_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["text"] == texts[0] and got[4]["text"] == texts[4]
    for i in (1, 2, 3):
        assert got[i]["n_words_removed"] >= 35 and " ".join(words[20:40]) not in " ".join(got[i]["text"].split())
        assert got[i + 4]["n_words_removed"] >= 25 and prose(6, 75) not in got[i + 4]["text"]


def test_passages_of_51_words_go_whole(spark):
    """Every one, to its last word, in one long line with other words around it."""
    texts = []
    for i in range(60):
        passage = prose(51, 5000 + i)
        texts += [f"{prose(40, 5100 + i)} left{i}a {passage} right{i}a {prose(40, 5200 + i)}", f"{prose(40, 5300 + i)} left{i}b {passage} right{i}b {prose(40, 5400 + i)}"]
    got = {r["doc_id"]: r for r in paragraph_dedup.dedup_paragraphs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i]["n_words_removed"] for i in range(120)] == [0, 51] * 60
    assert all(got[2 * i + 1]["text"] == f"{prose(40, 5300 + i)} left{i}b right{i}b {prose(40, 5400 + i)}" for i in range(60))


def test_near_copies_of_the_pipeline(spark):
    """Five-word shingles and a similarity of 0.8: a pair at 0.802 (0.839 with four words) is one, a pair at 0.785 is none."""
    words = prose(460, 800).split()
    rows = []
    for i, edits in enumerate((0, 10, 11)):
        changed = list(words)
        for e in range(edits):
            changed[20 + 40 * e] = f"edit{i}x{e}"
        rows.append((i, " ".join(changed), "a", "s", 5))
    sets = {k: [shingle_set(r[1], k) for r in rows] for k in (4, 5)}
    similar = lambda k, j: len(sets[k][0] & sets[k][j]) / len(sets[k][0] | sets[k][j])
    assert 0.80 <= similar(5, 1) < 0.816 and similar(4, 1) < 0.85 and similar(5, 2) < 0.80
    docs = spark.createDataFrame(rows, ", ".join(f"{k} {v}" for k, v in KINDS.items()))
    assert {r["doc_id"] for r in corpus_pipeline.near_copy_stage(spark, docs, "").collect()} == {0, 2}


def test_lines_that_repeat_words_keep_their_length_class(spark):
    line = prose(60, 810)
    longer = line + " " + " ".join(line.split()[30:])
    docs = spark.createDataFrame([(1, line), (2, longer)], "doc_id long, text string")
    bands = paragraph_dedup._units(docs).where("kind = 2").selectExpr("h AS gram", "doc", "n", "doc AS s1")
    assert {r["n"] for r in bands.collect()} == {len(shingle_set(line, 5)), len(shingle_set(longer, 5))} == {56, 60}
    links = ngram_join.grouped_links(bands, paragraph_dedup._paragraphs(docs), paragraph_dedup.SHINGLE, paragraph_dedup.PERCENT, once=True)
    assert len({(min(r), max(r)) for r in links.collect()}) == 1


def test_vectors(spark):
    r = np.random.default_rng(0)
    base = r.normal(size=(40, 16))
    close = base[r.integers(0, 40, 500)] + r.normal(size=(500, 16)) * r.uniform(0.02, 0.3, (500, 1))
    vectors = [*close.tolist(), close[0].tolist(), close[0].tolist()]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0] * 5, [2.0] * 5, [1e300] * 16, [1e-300] * 16]
    rows = [(i, v, 0) for i, v in enumerate(vectors + odd)] + [(None, [1.0] * 16, 0)]
    got = projection_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept int")).collect()
    assert len(got) == len(rows)
    by = {x["vec_id"]: x for x in got}
    n = len(vectors)
    for i in range(n, n + 6):
        assert (by[i]["n_links"], by[i]["component_id"], by[i]["kept"]) == (0, i, True)
    assert by[None]["n_links"] == 0 and by[None]["kept"] and by[n + 6]["n_links"] == by[n + 7]["n_links"] == by[n + 8]["n_links"] == 1
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1)[:, None]
    linked = (unit @ unit.T >= 0.9) & ~np.eye(n, dtype=bool)
    found = np.array([by[i]["n_links"] for i in range(n)])
    assert (found <= linked.sum(axis=1)).all() and found.sum() >= 0.95 * linked.sum() > 1000
    assert by[0]["n_links"] == by[n - 1]["n_links"] == by[n - 2]["n_links"]
    assert all(x["kept"] == (x["vec_id"] == x["component_id"]) for x in got if x["vec_id"] is not None)
    assert projection_join.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_in_blocks_count_the_same(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(1, 12)) + r.normal(size=(120, 12)) * 0.12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, projection_join.near_duplicates(df).collect()))
    monkeypatch.setattr(projection_join, "BLOCK", 16)
    assert sorted(map(tuple, projection_join.near_duplicates(df).collect())) == whole and sum(x[1] for x in whole) > 5000


def test_pages(spark):
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (3, "u", "<article><h1>A &lt; b</h1><p>one  two<br>three</article>", "t"), (3, "u", "<p>", "t"), (None, "u", "no markup", "t")]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r["page_id"], r["url"]) for r in got] == [(r[0], r[1]) for r in rows] and all(r["n_chars"] == len(r["text"]) for r in got)
    assert got[0]["text"] == got[1]["text"] == got[3]["text"] == "" and got[2]["text"] == "A < b\none two three"
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_given_pages_give_their_articles(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in entry.queries()["op10_dom_trees"](spark, "/root/testdata/sf0.01").collect()}
    for p in pages:
        article = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1].replace("<br>", " ").replace("<b>", "")
        blocks = [" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[p["page_id"]] == "\n".join(b for b in blocks if b)


def test_pipeline_stages(spark, tmp_path):
    """Every stage on odd rows: what it drops and keeps, by the operators' definitions."""
    base, passage = prose(200, 600), prose(70, 601)
    rows = [
        (1, base, "a", "s", len(base)), (2, edited(base, 1, 3), "a", "s", 5), (3, base, "a", "s", 5), (4, prose(180, 602) + "\n" + passage, "a", "s", 5),
        (5, prose(180, 603) + "\n" + passage, None, "s", 5), (6, "too short", "a", "s", 5), (7, None, "a", "s", 5), (8, "word " * 200, "a", "s", 5),
        (9, "1234 " * 100, "a", "s", 5), (10, prose(9000, 604), "a", "s", 5),
    ]
    docs = spark.createDataFrame(rows, ", ".join(f"{k} {v}" for k, v in KINDS.items()))
    (tmp_path / "in").mkdir()
    docs.write.parquet(str(tmp_path / "in/documents.parquet"))
    out, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.written(stage(spark, out, str(tmp_path / "in")), name)
        assert out.dtypes == docs.dtypes
        kept.append({r["doc_id"]: r for r in out.collect()})
    assert set(kept[0]) - {6} == {1, 2, 3, 4, 5, 8, 10} and set(kept[1]) == {1, 2, 3, 4, 5, 10}
    component = smallest_reachable([1, 2, 3], {1: [2, 3], 2: [1, 3], 3: [1, 2]})
    assert set(kept[2]) == {4, 5, 10, *component.values()}
    assert kept[3][5]["text"] == prose(180, 603) and kept[3][5]["n_chars"] == len(prose(180, 603)) and kept[3][4]["text"] == rows[3][1] and kept[3][1]["text"] == base
    packed = corpus_pipeline.run(spark, str(tmp_path / "in")).collect()
    total = {}
    for r in packed:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {i: len(r["text"].split()) + 1 for i, r in kept[3].items()}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path / "in")).count() == 0


def test_registered():
    names, sqls = set(entry.queries()), set(entry.oracle_sql())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert {n for n in sqls if n.startswith("op")} == {"op1_suffix_repetition", "op2_rendezvous_sharding", "op4_url_vocabulary", "op8_prefix_tree_join", "op11_letter_trees", "op13_seeded_runs"}
