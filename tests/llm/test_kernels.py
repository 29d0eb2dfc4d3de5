"""Parts that run inside tasks, against definitions by brute force."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import bpe_transducer, html_dom, html_extract, language_id, ngram_join, packing, paragraph_dedup, quality_rules, url_filter
from barloom.llm.boosted_trees import fit
from barloom.llm.wordhash import shingles, words_of

RANKS = bpe_transducer.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe_transducer.Codec(RANKS, public_tokenizers.PATTERN)


def test_words_and_hashes():
    texts = [b"", b" a  b\n", b"b a", b"\t", "é b\x0bc".encode()]
    w = words_of(texts)
    assert [w.data[a:b].tobytes() for a, b in zip(w.start, w.end)] == [x for t in texts for x in t.split()]
    assert w.owner.tolist() == [1, 1, 2, 2, 4, 4, 4] and w.first.tolist() == [0, 0, 2, 4, 4, 7]
    assert w.hash[0] == w.hash[3] and w.hash[1] == w.hash[2] == w.hash[5] and len(set(w.hash.tolist())) == 4
    assert shingles(w.hash, 8).tolist() == [] and len(shingles(w.hash, 7)) == 1
    assert words_of([b"AbC"], lower=True).hash == words_of([b"abc"]).hash


def repeats(words, least):
    n, covered, top = len(words), set(), 0
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        if best >= least:
            top = max(top, best)
            covered |= set(range(i, i + best))
    return len(covered), top


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), min_size=1, max_size=5), st.integers(1, 4))
def test_suffix_repeats_equal_brute_force(texts, least):
    got = quality_rules.text_figures([" ".join(t).encode() for t in texts], least)
    for t, covered, longest in zip(texts, got["covered_words"], got["longest_repeat"]):
        assert repeats(t, least) == (covered, longest)


def test_base_figures():
    got = quality_rules.text_figures(["a b c a b c\na b c a b c\n \nx#é é|\n \n".encode(), b""])
    assert {k: v.tolist() for k, v in got.items()} == {
        "n_words": [14, 0], "word_chars": [17, 0], "n_symbols": [2, 0], "n_dup_lines": [1, 0], "n_repeat_words": [12, 0],
        "covered_words": [0, 0], "longest_repeat": [0, 0],
    }


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("abetinrs '.,1\n\t é漢🙂\xa0 %")) | st.characters(codec="utf-8", exclude_characters="\x1c\x1d\x1e\x1f"), max_size=60))
def test_bpe_equals_the_library(text):
    ids, digits = CODEC.encode(text)
    assert list(ids) == REFERENCE.encode_ordinary(text)
    assert digits == " ".join(map(str, ids)) and CODEC.decode(ids) == text


def test_bpe_pairs_by_definition():
    rng = random.Random(4)
    for _ in range(3000):
        a, b = rng.randrange(len(RANKS)), rng.randrange(len(RANKS))
        fst = CODEC.fst
        assert fst.fits(a, b) == (fst.merged(fst.bytes_of[a] + fst.bytes_of[b]) == [a, b])


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=12), st.integers(1, 5))
def test_utf8_machine_equals_the_codec(data, step):
    decoder = bpe_transducer.Utf8Decoder({})
    got = "".join(decoder.feed(data[i : i + step]) for i in range(0, len(data), step)) + decoder.end()
    assert got == data.decode("utf-8", "replace")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=20), min_size=1, max_size=12), st.sampled_from([50, 80, 85]))
def test_trie_finds_all_similar_sets(sets, percent):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    trie = ngram_join.SetTrie(arrays, percent)
    similar = [[j for j, b in enumerate(sets) if j != i and 100 * len(a & b) >= percent * len(a | b)] for i, a in enumerate(sets)]
    assert [sorted(trie.similar(i)) for i in range(len(sets))] == similar
    edges, root = ngram_join.linked(arrays, percent)
    reach = {i: {i} for i in range(len(sets))}
    for _ in sets:
        for i, more in enumerate(similar):
            for j in more:
                reach[i] |= reach[j]
                reach[j] |= reach[i]
    assert all((root[i] == root[j]) == (j in reach[i]) for i in reach for j in reach)


def one_by_one(lengths, capacities, cost):
    bins = []
    for n in sorted(lengths, reverse=True):
        open_ = [b for b in bins if b[0] - b[1] >= n]
        if open_:
            min(open_, key=lambda b: b[0] - b[1])[1] += n
        else:
            bins.append([min((c for c in capacities if c >= n), key=lambda c: (cost(c) / (c // n * n), -c)), n])
    return sorted((min(c for c in capacities if c >= used), used) for _, used in bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64) | st.just(7), max_size=80))
def test_packing_plan_equals_best_fit_one_by_one(lengths):
    counts = {n: lengths.count(n) for n in lengths}
    bins, placed = {}, set()
    for r in packing.plan(counts, (16, 32, 64)):
        for rank in range(r.first, r.last + 1):
            at = rank - r.first
            start = r.offset + at % r.each * r.length
            bins.setdefault((r.bin + at // r.each, r.capacity), []).append((start, start + r.length))
            placed.add((r.length, rank))
    assert placed == {(n, i) for n, c in counts.items() for i in range(c)}
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), spans in bins.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= capacity and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert sorted((c, s[-1][1]) for (_, c), s in bins.items()) == one_by_one(lengths, (16, 32, 64), packing.default_cost)


def test_packing_rejects_items_that_fit_nowhere():
    with pytest.raises(ValueError):
        packing.plan({65: 1}, (64,))
    assert packing.plan({}, (64,)) == []


def test_url_terms_need_boundaries():
    found = url_filter.vocabulary()
    assert url_filter.term_hits("http://CASINO-win.example/", found) == (1, 1)
    assert url_filter.term_hits("http://casinos.example/winner", found) == (0, 0)
    assert url_filter.term_hits("http://x/free/free/bet", found) == (0, 2)
    assert url_filter.term_hits("http://a/écasino", found) == (1, 0)
    assert url_filter.term_hits(None, found) == url_filter.term_hits("", found) == (0, 0)


def test_language_classifier_edges():
    model = language_id.Classifier({"aa": b"lorem ipsum dolor sit amet " * 40, "bb": "größer als tausend häuser ".encode() * 40})
    assert model.predict("lorem ipsum dolor sit amet, dolor sit")[0] == "aa"
    assert model.predict("TAUSEND HÄUSER ALS GRÖSSER")[0] == "bb"
    assert model.predict(None) == model.predict("12 3!") == model.predict("") == ("und", 0.0)
    assert language_id.Classifier({}).predict("abc") == ("und", 0.0)
    assert 0 <= model.predict("x")[1] <= 1 and language_id.Classifier({"aa": b"abc"}).predict("abc")[0] == "aa"
    assert model.predict("lorem ipsum " * 50_000)[0] == "aa"


def test_cuts_depend_on_the_words_around_only():
    rng = random.Random(9)
    words = [f"w{rng.randrange(500)}" for _ in range(300)]
    before, after = ["x%d" % i for i in range(40)], ["y%d" % i for i in range(23)]
    grams = lambda ws: shingles(words_of([" ".join(ws).encode()]).hash, 5)
    alone = paragraph_dedup._cuts(grams(words), np.ones(296, bool))
    other = paragraph_dedup._cuts(grams(before + words + after), np.ones(359, bool)) - 40
    inner = lambda cuts: [c for c in cuts.tolist() if 10 <= c < 285]
    assert inner(alone) == inner(other) and len(inner(alone)) > 10


def test_passages_of_51_words_share_an_anchor():
    """Whatever stands around them, at every place in a document, and where words repeat."""
    rng = random.Random(12)
    for trial in range(300):
        passage = [f"w{rng.randrange(2000)}" for _ in range(51)] if trial % 10 else [f"w{i % (3 + trial // 10)}" for i in range(51)]
        found = []
        for side in "xy":
            ws = [f"{side}{i}" for i in range(rng.randrange(60))] + passage + [f"{side}{i}" for i in range(60, 60 + rng.randrange(60))]
            runs = shingles(words_of([" ".join(ws).encode()]).hash, paragraph_dedup.LEAST_RUN)
            found.append(set(runs[paragraph_dedup._anchors(runs, np.ones(len(runs), bool))].tolist()))
        assert found[0] & found[1]
    same = shingles(words_of([b"word " * 200]).hash, paragraph_dedup.LEAST_RUN)
    assert paragraph_dedup._anchors(same, np.ones(len(same), bool)).tolist() == [0]


def test_cut_text_extends_to_the_words_around():
    text = b" ".join(b"w%d" % i for i in range(60))
    h = words_of([text]).hash
    other = words_of([b"o p"]).hash
    left, right = np.concatenate((other, h[7:10])).tobytes(), np.concatenate((h[40:44], other)).tobytes()
    assert paragraph_dedup.cut_text(text, [(1, 10, 30, left, right)]) == (b" ".join(b"w%d" % i for i in [*range(7), *range(44, 60)]), 37, 1)


def test_cut_text_keeps_the_rest():
    text = b"a b  c\n" + b" ".join(b"w%d" % i for i in range(60)) + b"\n\n tail  x\n"
    assert paragraph_dedup.cut_text(text, []) == (text, 0, 0)
    assert paragraph_dedup.cut_text(text, [(1, 3, 10), (1, 13, 14)]) == (text, 0, 0)[:1] + (0, 0)  # runs of 24 words are too short
    out, words, spans = paragraph_dedup.cut_text(text, [(1, 3, 12), (1, 15, 18)])
    assert out == b"a b  c\n" + b" ".join(b"w%d" % i for i in range(30, 60)) + b"\n\n tail  x\n" and (words, spans) == (30, 1)
    assert paragraph_dedup.cut_text(text, [(0, 3, 60)])[0] == b"a b  c\n\n tail  x\n"


def test_dom_reads_broken_markup():
    page = html_dom.parse("<P>one<p>two &amp; <b>three<br>four<div>x<script>var a='<p>no</p>'</script>y</div></b>&eacute;<!-- z --><ul><li>p<li>q</ul><img alt='>'>end<")
    assert [t for t in page.text if t] == ["one", "two & three four", "xy", "é", "p", "q", "end<"]
    assert [t for t in html_dom.parse("").text if t] == [] and html_dom.parse("<a <b>").parent == [-1]
    assert [t for t in html_dom.parse("a&#00065;&#x000042;&#0;&#99999999999999;&#" + "1" * 5000 + ";b").text if t] == ["aAB\ufffd\ufffd\ufffdb"]


def test_reader_of_pages_is_linear():
    n = 40_000
    for source, text in (
        ("<div>" * n + "deep" + "</div>" * n, ["deep"]), ("<a '" * n, ["<a '" * (n - 1) + "<a '"]), ("<a \"'" * n, None), ("<a " * n, None), ("<a" * n, None),
        ("<b>" * n + "</i>" * n + "x", ["x"]), ("<table><tr><td>" * n + "x", ["x"]), ("<script>" + "</script " * n, []), ("<!-" * n, ["<!-" * n]),
        ("<p class='" + 'id="' * n + "'>x", ["x"]), ("&#0" * n + ";", None),
    ):
        began = time.process_time()
        page = html_dom.parse(source)
        html_dom.features([page])
        assert time.process_time() - began < 10, source[:30]
        if text is not None:
            assert [t.replace(" ", "") for t in page.text if t] == [t.replace(" ", "") for t in text], source[:30]


def test_sums_over_subtrees_and_ancestors():
    page = html_dom.parse("<nav id=menu>a <b>b</b><div class='post ad'>c, d.<p>e</p></div></nav><div>f<ul><li>g<li>h</ul></div>")
    x, parent, _ = html_dom.features([page, page])
    n, names = len(page.parent), {name: i for i, name in enumerate(html_dom.NUMBERS)}
    assert parent.tolist() == [max(p, 0) for p in page.parent] + [max(p, 0) + n for p in page.parent]
    for i in range(n):
        above, at = [], i
        while page.parent[at] >= 0:
            at = page.parent[at]
            above.append(at)
        below = [j for j in range(i + 1, n) if i in _chain(page.parent, j)]
        assert x[i, names["depth"]] == x[n + i, names["depth"]] == len(above)
        assert np.isclose(x[i, names["nodes"]], np.log1p(len(below) + 1))
        assert np.isclose(x[i, names["log_chars"]], np.log1p(sum(len(page.text[j] or "") for j in (i, *below))))
        tags = len(html_dom.NUMBERS) + len(html_dom.TAGS)
        assert {t for t in range(len(html_dom.TAGS)) if x[i, tags + t]} == {page.tag[j] for j in above}
        flags = [{g for g in range(html_dom.N_GROUPS) if x[i, tags + len(html_dom.TAGS) + k * html_dom.N_GROUPS + g]} for k in range(3)]
        bits = lambda nodes: {g for g in range(html_dom.N_GROUPS) for j in nodes if page.groups[j] >> g & 1}
        assert flags == [bits([i]), bits(above) - bits([i]), bits(below)]


def _chain(parent: list[int], i: int) -> list[int]:
    out = []
    while parent[i] >= 0:
        i = parent[i]
        out.append(i)
    return out
    assert all(p < i for i, p in enumerate(page.parent))


def test_decoding_is_consistent_and_likeliest():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(2, 9))
        parent = [-1, *[int(rng.integers(0, i)) for i in range(1, n)]]
        inner = set(parent)
        parent_of_leaf = [i not in inner for i in range(n)]
        page = html_dom.Page(parent, [0] * n, [0] * n, [f"t{i}" if leaf and i else None for i, leaf in enumerate(parent_of_leaf)], [0] * n)
        p = rng.uniform(0.05, 0.95, n)
        best = None
        for bits in range(1 << n):
            on = [bits >> i & 1 for i in range(n)]
            fine = all(not on[i] or parent[i] < 0 or on[parent[i]] for i in range(n))
            fine &= all(not on[i] or page.text[i] is not None or any(on[j] and parent[j] == i for j in range(n)) for i in range(n))
            score = sum(np.log(p[i] if on[i] else 1 - p[i]) for i in range(n))
            if fine and (best is None or score > best[0]):
                best = (score, [page.text[i] for i in range(1, n) if on[i] and page.text[i]])
        assert html_extract.decode(page, p) == best[1]


def test_trees_learn_and_extraction_generalises():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((fit(x, y).predict(x) > 0.5) == y).mean() > 0.97
    forest = html_extract.train()
    held = html_extract.training_pages(100, seed=1234)
    texts = html_extract.extract([s for s, _ in held], forest)
    assert np.mean([t == "\n".join(m) for t, (_, m) in zip(texts, held)]) > 0.88
    assert html_extract.extract([None, "", "<nav><a href=/>x</a></nav>"], forest)[:2] == ["", ""] and html_extract.extract([], forest) == []


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([5, 60, 1600]))
def test_sketches_lose_no_similar_sets(seed, size):
    rng = np.random.default_rng(seed)
    sets = []
    for base in rng.integers(1, 2**63, (3, size)).astype(np.uint64):
        for _ in range(3):
            other = rng.integers(1, 2**63, size).astype(np.uint64)
            sets.append(np.unique(np.where(rng.random(size) < rng.uniform(0, 0.2), other, base)))
    found = ngram_join.plausible([len(s) for s in sets], [ngram_join.sketch(s) for s in sets], 85)
    for i, a in enumerate(sets):
        if any(100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)) for j, b in enumerate(sets) if j != i):
            assert found[i]
    full = [ngram_join.sketch(np.arange(n, dtype=np.uint64) * np.uint64(1024)) for n in (400, 3000)]
    assert ngram_join.plausible([400, 3000], full, 85).all()  # full buckets bound nothing
