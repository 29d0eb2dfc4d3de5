"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

One replaced code point moves at most one letter count up and one down, one
inserted code point moves one up: near words are at most two apart in L1.  So

1. words are counted over all texts (``word_counts``);
2. for every word length a k-d tree over letter counts cuts the vocabulary
   into cells of bounded size.  Its upper part comes from a bounded sample of
   the words and is sent to the tasks; each cell builds its own lower part;
3. every word visits the cells of its own length and of the next one whose box
   can hold a near word: a box that needs more than one count up or one down
   (for a longer word: any down) is left out;
4. in a cell the words walk its tree together, the same bounds prune boxes, a
   bit pattern of the counts bounds what is left, and the order of the letters
   decides.

Each near pair meets in exactly one cell (pairs of different lengths) or in one
for each side (equal lengths), so counts need no removal of repeated pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: Words have at least so many code points and occur at least so often.
LEAST_CHARS, LEAST_COUNT = 7, 2
#: A form occurs at least so many times as often as the word that it explains.
TIMES = 10
#: Words that the upper trees are made from, at most; words of a cell; least words of the sample in a cell; words of a leaf.
SAMPLE, CELL, LEAST_SAMPLE, LEAF = 200_000, 16_384, 48, 64
#: Words that walk a cell's tree at a time, in characters: the memory of a task.
WALK_CHARS = 1 << 17
#: Letter counts: a-z, and the other letters in six groups.
DIMS = 32

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def code_points(words: list[str]) -> np.ndarray:
    """Matrix of the code points of words of one length."""
    return np.array(words).view(np.uint32).reshape(len(words), -1)


def letter_counts(points: np.ndarray) -> np.ndarray:
    """How often each letter occurs in each row, at most 255 times."""
    place = np.where(points < 0xC0, points - 97, 26 + points % 6).astype(np.int64) % DIMS
    flat = (np.arange(len(points))[:, None] * DIMS + place).ravel()
    return np.minimum(np.bincount(flat, minlength=len(points) * DIMS).reshape(-1, DIMS), 255).astype(np.uint8)


def bit_pattern(counts: np.ndarray) -> np.ndarray:
    """Two bits for each letter: once or more, twice or more."""
    bits = np.zeros(len(counts), np.uint64)
    for d in range(DIMS):
        bits |= (counts[:, d] >= 1).astype(np.uint64) << np.uint64(2 * d)
        bits |= (counts[:, d] >= 2).astype(np.uint64) << np.uint64(2 * d + 1)
    return bits


class LetterTree:
    """k-d tree over letter counts: inner nodes (letter, count, low child, high child), leaves of at most ``leaf`` rows unless all rows are equal."""

    def __init__(self, nodes: list[tuple[int, int, int, int]], rows: list[np.ndarray], root: int):
        self.nodes, self.rows, self.root = nodes, rows, root  # rows of each leaf

    @classmethod
    def of(cls, counts: np.ndarray, leaf: int) -> LetterTree:
        tree = cls([], [], 0)
        tree.root = tree._built(counts, np.arange(len(counts)), leaf)
        return tree

    def _built(self, counts: np.ndarray, own: np.ndarray, leaf: int) -> int:
        """Node number; leaves are ~number."""
        if len(own) > leaf:
            part = counts[own]
            best = None
            for d in range(DIMS):
                mid = int(np.median(part[:, d]))
                for t in {mid, mid - 1}:
                    if t >= 0:
                        low = int((part[:, d] <= t).sum())
                        if low and low < len(own) and (best is None or abs(2 * low - len(own)) < best[0]):
                            best = (abs(2 * low - len(own)), d, t)
            if best is not None:
                _, d, t = best
                below = part[:, d] <= t
                at = len(self.nodes)
                self.nodes.append((d, t, 0, 0))
                self.nodes[at] = (d, t, self._built(counts, own[below], leaf), self._built(counts, own[~below], leaf))
                return at
        self.rows.append(own)
        return ~(len(self.rows) - 1)

    def visits(self, counts: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of ``counts``) whose box is within so many counts up and down.

        A letter that is cut twice on a way adds up to more than one either way,
        so the sum over the cuts prunes as the distance to the box does.
        """
        none = np.zeros(len(counts), np.int16)
        todo = [(self.root, np.arange(len(counts)), none, none)]
        while todo:
            node, own, ups, downs = todo.pop()
            if node < 0:
                yield ~node, own
                continue
            d, t, low, high = self.nodes[node]
            c = counts[own, d].astype(np.int16)
            more = downs + np.maximum(c - t, 0)
            fit = more <= down
            if fit.any():
                todo.append((low, own[fit], ups[fit], more[fit]))
            more = ups + np.maximum(t + 1 - c, 0)
            fit = more <= up
            if fit.any():
                todo.append((high, own[fit], more[fit], downs[fit]))


def near_pairs(tree: LetterTree, bits: np.ndarray, points: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``asked``, row of ``points``) of the words that are exactly one edit apart; ``asked`` has the same length or one less."""
    shorter = asked.shape[1] < points.shape[1]
    counts = letter_counts(asked)
    own_bits = bit_pattern(counts)
    found_a, found_b = [], []
    for leaf, own in tree.visits(counts, 1, 0 if shorter else 1):
        rows = tree.rows[leaf]
        for i in range(0, len(own), 4096):
            some = own[i : i + 4096]
            for j in range(0, len(rows), 1024):
                there = rows[j : j + 1024]
                x, y = own_bits[some][:, None], bits[there][None, :]
                down = np.bitwise_count(x & ~y)
                fit = (np.bitwise_count(y & ~x) <= 1) & (down <= (0 if shorter else 1))
                a, b = np.nonzero(fit)
                for k in range(0, len(a), WALK_CHARS):
                    p, q = some[a[k : k + WALK_CHARS]], there[b[k : k + WALK_CHARS]]
                    if shorter:
                        same = asked[p] == points[q, :-1]
                        ahead = np.where(same.all(axis=1), asked.shape[1], same.argmin(axis=1))
                        same = (asked[p] == points[q, 1:])[:, ::-1]
                        behind = np.where(same.all(axis=1), asked.shape[1], same.argmin(axis=1))
                        near = ahead + behind >= asked.shape[1]
                    else:
                        near = (asked[p] != points[q]).sum(axis=1) == 1
                    found_a.append(p[near])
                    found_b.append(q[near])
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """word, n: occurrences over all texts of the letter runs that are ``least`` code points or longer.

    Runs of A-Z, a-z and U+00C0 to U+00FF, only A-Z lower-cased; where 31
    divides the CRC-32 of ``<id>:<run>``, one code point of the run is left
    out.  A null id counts as the empty string.
    """
    runs = df.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(text_col, F.lit(rf"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))).alias("run"),
    )
    # most runs have no capitals: lower() is cheap and keeps those as they are
    low = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", _UPPER, _LOWER))
    rows = runs.select("id", low.alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    cut = F.pmod(h, F.char_length("run")).cast("int")
    word = F.when(h % 31 == 0, F.concat(F.expr("left(run, cut)"), F.expr("substr(run, cut + 2)"))).otherwise(F.col("run"))
    words = rows.withColumn("cut", cut).select(word.alias("word")).where(F.char_length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def upper_trees(vocabulary: DataFrame, sample: int, cell: int) -> dict[int, LetterTree]:
    """A tree over the letter counts of each word length, from at most ``sample`` words: its leaves are the cells."""
    size = vocabulary.count()
    if not size:
        return {}
    share = min(1.0, 0.9 * sample / size)
    some = vocabulary.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))).select("word").limit(sample).collect()
    by_length: dict[int, list[str]] = {}
    for r in some:
        by_length.setdefault(len(r["word"]), []).append(r["word"])
    leaf = max(int(cell * share), LEAST_SAMPLE if share < 1 else 1)
    trees = {}
    for length, words in by_length.items():
        tree = LetterTree.of(letter_counts(code_points(words)), leaf)
        trees[length] = LetterTree(tree.nodes, [], tree.root)
    return trees


def _routed(vocabulary: DataFrame, trees: dict[int, LetterTree]) -> DataFrame:
    """Each word in its cell (kind 0), and in the cells where near words of its length (kind 1) or one longer (kind 2) can be."""
    # bounded by the sample; plain tuples, so workers need no copy of this package
    sent = vocabulary.sparkSession.sparkContext.broadcast({k: (t.nodes, t.root) for k, t in trees.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = {k: LetterTree(nodes, [], root) for k, (nodes, root) in sent.value.items()}
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                counts = letter_counts(code_points([words[i] for i in at.tolist()]))
                rows, cells, kinds = [], [], []
                for kind, there, up, down in ((0, length, 0, 0), (1, length, 1, 1), (2, length + 1, 1, 0)):
                    tree = trees.get(there)
                    for leaf, own in tree.visits(counts, up, down) if tree else [(0, np.arange(len(at)))]:
                        rows.append(at[own])
                        cells.append(np.full(len(own), there << 32 | leaf, np.int64))
                        kinds.append(np.full(len(own), kind, np.int32))
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(cells)), pa.array(np.concatenate(kinds)), batch.column(0).take(take), n.take(take)], names=["cell", "kind", "word", "n"]
                )

    return vocabulary.select("word", "n").mapInArrow(run, "cell long, kind int, word string, n long")


def _tallied(words: list[str], own: np.ndarray, other_words: list[str], other: np.ndarray, other_n: np.ndarray) -> pa.RecordBatch:
    """word, how many near words, and the one of largest n (ties: smallest); rows of ``other_words`` are in word order."""
    order = np.lexsort((other, -other_n[other], own))
    own, other = own[order], other[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    count = np.diff(np.append(first, len(own)))
    return pa.RecordBatch.from_arrays(
        [pa.array([words[i] for i in own[first].tolist()], pa.string()), pa.array(count.astype(np.int64)),
         pa.array(other_n[other[first]]), pa.array([other_words[i] for i in other[first].tolist()], pa.string())],
        names=["word", "near", "best_n", "best"],
    )


def _searched(routed: DataFrame) -> DataFrame:
    """Partial tallies (word, near, best_n, best) of all cells."""
    rows = routed.repartition("cell").sortWithinPartitions("cell", "kind", "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = kind = None
        held: list[str] = []
        held_n: list[int] = []
        points = n = tree = bits = None
        for batch in batches:
            cells, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            words, counts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(words)]):
                if begin == end:
                    continue
                if cells[begin] != cell:
                    cell, held, held_n, tree = cells[begin], [], [], None
                kind = kinds[begin]
                if kind == 0:  # the words of the cell come first
                    held += words[begin:end]
                    held_n += counts[begin:end]
                    continue
                if not held:
                    continue
                if tree is None:
                    points, n = code_points(held), np.array(held_n, np.int64)
                    vectors = letter_counts(points)
                    tree, bits = LetterTree.of(vectors, LEAF), bit_pattern(vectors)
                step = max(1, WALK_CHARS // points.shape[1])
                for i in range(begin, end, step):
                    asked = words[i : min(i + step, end)]
                    a, b = near_pairs(tree, bits, points, code_points(asked))
                    if len(a):
                        yield _tallied(asked, a, held, b, n)
                        if kind == 2:
                            yield _tallied(held, b, asked, a, np.array(counts[i : i + len(asked)], np.int64))

    return rows.mapInArrow(run, "word string, near long, best_n long, best string")


def near_words(vocabulary: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """word, n_near, best, best_n for every word of ``vocabulary`` (distinct ``word``, ``n``) that has a near word.

    A near word differs by exactly one inserted, deleted or replaced code
    point; ``best`` is the one with the largest n, the smallest of equals.
    """
    tallies = _searched(_routed(vocabulary, upper_trees(vocabulary, sample, cell)))
    top = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("top")
    return tallies.groupBy("word").agg(F.sum("near").alias("n_near"), top).select("word", "n_near", F.col("top.w").alias("best"), (-F.col("top.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word reached from each ``word`` over ``form``, by doubling (a form's n grows tenfold, so chains are short)."""
    known = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = known.select(F.col("word").alias("at"), F.col("root").alias("further"))
        ahead = written(known.join(further, known["root"] == further["at"], "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        drop_written(known)
        known = ahead.select("word", "root")
        if not ahead.where("moved").limit(1).count():
            return known


def spelling_variants(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, times: int = TIMES,
    sample: int = SAMPLE, cell: int = CELL,
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word with ``least_count`` occurrences.

    ``form`` is the near word of largest n, the smallest of equals, if its n is
    at least ``times`` the word's; ``root`` is where forms lead from the word
    (itself without one).

    Null and empty texts have no words, a very long run of letters is a word
    like others, repeated rows count each, a null id counts as the empty
    string, other columns are ignored, an empty table gives no rows.
    """
    counted = word_counts(df, id_col, text_col, least_chars)
    vocabulary = written(counted.where(F.col("n") >= least_count), "vocabulary")
    near = written(near_words(vocabulary, sample, cell), "near-words")
    joined = vocabulary.join(near, "word", "left")
    form = F.when(F.col("best_n") >= times * F.col("n"), F.col("best"))
    judged = written(
        joined.select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n")),
        "judged-words",
    )
    ends = roots(judged.where("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: Words that agree with one code point left out at the same place (replaced), or one of which is the other with a code point left out.
SQL = r"""
WITH RECURSIVE crc_table(i, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_table WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM crc_table WHERE k = 8),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), distinct_runs AS (SELECT run, count(*) AS m, coalesce(doc_id::VARCHAR, '') || ':' || run AS key FROM runs GROUP BY doc_id, run),
bytes AS (SELECT run, m, hex(encode(key)) AS x FROM distinct_runs),
hashed AS (
  SELECT run, m, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)),
    lambda a, b: xor(a >> 8, t[CAST(xor(a & 255, b) + 1 AS BIGINT)])), 4294967295::BIGINT) AS h FROM bytes, crc
), counted AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(m) AS n FROM hashed GROUP BY 1
), words AS (SELECT word, CAST(n AS BIGINT) AS n FROM counted WHERE length(word) >= 7 AND n >= 2),
holes AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, a.n AS n, b.word AS b, b.n AS m FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT h.word, h.n, w.word, w.n FROM holes h JOIN words w ON h.rest = w.word
  UNION SELECT w.word, w.n, h.word, h.n FROM holes h JOIN words w ON h.rest = w.word
), best AS (SELECT a, n, count(*) AS n_near, first(b ORDER BY m DESC, b) AS b, max(m) AS m FROM pairs GROUP BY a, n),
judged AS (
  SELECT word, CASE WHEN m >= 10 * w.n THEN b END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best ON a = word
), chain AS (
  SELECT word, word AS here, 0 AS d FROM judged UNION ALL SELECT c.word, j.form, d + 1 FROM chain c JOIN judged j ON c.here = j.word WHERE j.form IS NOT NULL
), ends AS (SELECT word, arg_max(here, d) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM judged JOIN ends USING (word)
"""
