"""Toxic passages by maximum-scoring segments over token log-odds.

1. Units are the words of a text (letters, lower-cased) and their beginnings of
   a few bytes.  From a bounded sample of labelled documents, each unit gets
   the log-odds that a document with it is toxic, against the overall odds,
   under Dirichlet priors: a unit's prior is its next shorter beginning, the
   shortest ones' is the overall share.  A standard error is taken off, so
   rare units say little.
2. A word scores its longest known unit, less a drift that makes clean text
   lose.  One linear pass finds all maximal-scoring segments of a document.
3. The best segment of n clean words exceeds S with probability
   1 - exp(-K n exp(-lambda S)); lambda and K are the likeliest for clean
   labelled documents that the log-odds did not see.  Segments that are
   significant under it are the toxic passages; they are pooled into one
   p-value of the document (the sum statistic of several high-scoring
   segments), and a logistic curve turns that into the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wordhash import mix, slices, words_of

#: Labelled documents that are learnt from, of each class at most.
LABELLED = 20_000
#: Bytes of the beginnings; units are kept from so many documents on, so many at most (the most telling ones).
BEGINNINGS, LEAST_DOCS, UNITS = (4, 5, 6, 7, 8), 3, 262_144
#: Documents that the prior counts for; what every word loses; expected number of clean segments as high as a significant one.
PRIOR, DRIFT, MOST_EXPECTED = 10.0, 0.05, 0.5
#: Standard errors that are taken off the log-odds.
ERRORS = 2.5
#: Score from which a document counts as toxic.
TOXIC_FROM = 0.3
#: Longest list of segments that is pooled (further ones add nothing that can be told from 0).
POOLED = 64

_APART = np.ones(256, bool)
_APART[65:91] = _APART[97:123] = False
_APART[128:] = False
_WORD = np.uint64(0x9E3779B97F4A7C15)
_LEVELS = len(BEGINNINGS) + 1


class Model(NamedTuple):
    """Units by hash with their scores, the clean distribution of the best segment, and the curve of the score."""

    units: np.ndarray  # uint64, sorted
    scores: np.ndarray
    decay: float  # lambda
    scale: float  # K
    curve: tuple[float, float]


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _lowered(texts: list[bytes]) -> list[bytes]:
    return [t.decode("utf-8", "replace").lower().encode() for t in texts]


def _units(w) -> np.ndarray:
    """Hash of each unit of each word (row), from the shortest beginning to the whole word; 0 where the word is too short."""
    out = np.zeros((len(w.hash), _LEVELS), np.uint64)
    size = w.end - w.start
    for i, k in enumerate(BEGINNINGS):
        long = np.flatnonzero(size >= k)
        out[long, i] = w.spans(w.start[long], w.start[long] + k)
    out[:, -1] = mix(w.hash ^ _WORD)
    return out


def unit_counts(docs: DataFrame) -> DataFrame:
    """unit, parent, toxic, clean: in how many documents of ``docs`` (text, toxic) each unit is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions: dict = {}
        for part, texts in slices(batches, "text"):
            label = part.column(1).to_numpy()
            w = words_of(_lowered(texts), positions=positions, separators=_APART)
            # words once per document, then their units once per document
            once = np.unique(mix(w.hash + mix(w.owner.astype(np.uint64))), return_index=True)[1]
            units, owner = _units(w)[once], w.owner[once]
            known = units != 0
            parent = np.zeros_like(units)
            for i in range(1, _LEVELS):  # the next shorter unit that the word has
                parent[:, i] = np.where(known[:, i - 1], units[:, i - 1], parent[:, i - 1])
            u, p, o = units[known], parent[known], np.repeat(owner, known.sum(axis=1))
            once = np.unique(mix(u + mix(o.astype(np.uint64))), return_index=True)[1]
            u, p, bad = u[once], p[once], label[o[once]] == 1
            all_units, at, place = np.unique(u, return_index=True, return_inverse=True)
            toxic = np.bincount(place, weights=bad, minlength=len(all_units)).astype(np.int64)
            total = np.bincount(place, minlength=len(all_units)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(all_units.view(np.int64)), pa.array(p[at].view(np.int64)), pa.array(toxic), pa.array(total - toxic)], names=["unit", "parent", "toxic", "clean"]
            )

    found = docs.select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(run, "unit long, parent long, toxic long, clean long")
    return found.groupBy("unit").agg(F.min("parent").alias("parent"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(units: np.ndarray, parents: np.ndarray, toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """Log-odds of each unit against the overall ``share``, less one standard error, under priors that come down from the parents."""
    place = {int(u): i for i, u in enumerate(units.tolist())}
    above = np.array([place.get(p, -1) for p in parents.tolist()], np.int64)
    prior = np.full(len(units), share)
    rate = np.empty(len(units))
    done = above < 0
    rate[done] = (toxic[done] + PRIOR * share) / (toxic[done] + clean[done] + PRIOR)
    while not done.all():
        ready = ~done & done[np.maximum(above, 0)]
        prior[ready] = rate[above[ready]]
        rate[ready] = (toxic[ready] + PRIOR * prior[ready]) / (toxic[ready] + clean[ready] + PRIOR)
        done = done | ready
    raw = np.log(rate / (1 - rate)) - math.log(share / (1 - share))
    error = np.sqrt(1 / (toxic + PRIOR * share) + 1 / (clean + PRIOR * (1 - share)))
    return np.sign(raw) * np.maximum(np.abs(raw) - ERRORS * error, 0)


def word_scores(w, units: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Score of each word: that of its longest known unit, less the drift.

    The log-odds speak of documents with a word, not of how often it is there:
    a positive score of the n-th occurrence in a text is divided by n.
    """
    out = np.zeros(len(w.hash))
    if len(units) and len(out):
        kinds, place = np.unique(w.hash, return_index=True, return_inverse=True)[1:]
        some = w._replace(start=w.start[kinds], end=w.end[kinds], hash=w.hash[kinds])
        found = np.zeros(len(kinds))
        for column in _units(some).T:
            at = np.minimum(np.searchsorted(units, column), len(units) - 1)
            hit = (units[at] == column) & (column != 0)
            found[hit] = scores[at[hit]]
        out = found[place]
        high = np.flatnonzero(out > 0)
        key = mix(w.hash[high] + mix(w.owner[high].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        new = np.append(True, key[order][1:] != key[order][:-1]) if len(high) else np.zeros(0, bool)
        at = np.arange(len(high))
        out[high[order]] /= 1 + at - np.maximum.accumulate(np.where(new, at, 0))
    return out - DRIFT


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, sum) of all maximal-scoring segments, in one pass over the runs of positive scores.

    A segment is kept while no later one can be joined to it to their common
    gain; ``low`` and ``high`` are the sums of all scores before and after it.
    """
    up = scores > 0
    edge = np.flatnonzero(up[1:] != up[:-1]) + 1
    if len(up) and up[0]:
        edge = np.concatenate(([0], edge))
    if len(edge) % 2:
        edge = np.append(edge, len(up))
    total = np.concatenate(([0.0], np.cumsum(scores)))
    kept: list[list] = []  # start, end, low, high, the last earlier one with a smaller low
    for start, end in zip(edge[0::2].tolist(), edge[1::2].tolist()):
        low, high = total[start], total[end]
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                kept.append([start, end, low, high, j])
                break
            # joined with everything from j on
            start, low = kept[j][0], kept[j][2]
            del kept[j:]
            j = len(kept) - 1
    return [(s, e, float(h - l)) for s, e, l, h, _ in kept]


def pooled(sums: list[float], n: int, decay: float, scale: float) -> tuple[list[bool], float]:
    """Which segments are significant in a text of n words, and -ln p of all of them together."""
    if not sums or not n:
        return [False] * len(sums), 0.0
    norm = [decay * s - math.log(scale * n) for s in sums]
    best, t = 0.0, 0.0
    for r, x in enumerate(sorted(norm, reverse=True)[:POOLED], 1):
        if x <= 0:
            break
        t += x
        # sum statistic of r segments; one segment: the extreme value itself
        value = -math.log(-math.expm1(-math.exp(-x))) if r == 1 and x < 30 else t - (r - 1) * math.log(t) + math.lgamma(r + 1) + math.lgamma(r)
        best = max(best, value - math.log(r) if r > 1 else value)
    return [x >= -math.log(MOST_EXPECTED) for x in norm], best


def extreme_values(sums: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(lambda, K) that make the best segments of clean texts of n words likeliest."""
    use = (n > 0) & (sums > 0)
    sums, n = sums[use], n[use].astype(float)
    if len(sums) < 10 or sums.max() == sums.min():
        return 1.0, 0.01
    low, high = 1e-3, 50.0
    for _ in range(100):  # the slope of the likelihood falls with lambda
        mid = (low + high) / 2
        weight = n * np.exp(-mid * (sums - sums.min()))
        if 1 / mid - sums.mean() + (sums * weight).sum() / weight.sum() > 0:
            low = mid
        else:
            high = mid
    return low, float(len(sums) / (n * np.exp(-low * sums)).sum())


def logistic_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of the score 1 / (1 + exp(-a - b log(1 + x))), by Newton steps with a slight ridge."""
    z = np.column_stack((np.ones(len(x)), np.log1p(x)))
    beta = np.zeros(2)
    ridge = np.diag([1e-6, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, toxic, fit: at most ``most`` labelled ids of each class; equal texts of a class count once.

    ``fit``: whether the log-odds see the document; the others calibrate.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    span, parts = 1 << 30, []
    for label, size in sizes.items():
        share = int(span * min(1.0, 0.9 * most / size))
        parts.append(known.where((F.col("toxic") == label) & (F.pmod(F.xxhash64("doc_id"), F.lit(span)) < share)).limit(most))
    if len(parts) < 2:
        return known.limit(0).withColumn("fit", F.lit(True))
    ids = F.broadcast(parts[0].union(parts[1]))  # bounded by ``most``
    texts = docs.where(F.col("text").isNotNull()).join(ids, "doc_id").select("doc_id", "toxic", F.xxhash64("text").alias("h"))
    return texts.groupBy("h", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic", (F.pmod("h", F.lit(3)) != 0).alias("fit"))


def _best_segments(docs: DataFrame, units: np.ndarray, scores: np.ndarray) -> DataFrame:
    """toxic, n_words and the sums of the highest segments of each document."""
    sent = docs.sparkSession.sparkContext.broadcast((units, scores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions: dict = {}
        for part, texts in slices(batches, "text"):
            w = words_of(_lowered(texts), positions=positions, separators=_APART)
            points = word_scores(w, *sent.value)
            sums = [sorted((s for _, _, s in maximal_segments(points[a:b])), reverse=True)[:POOLED] for a, b in zip(w.first[:-1], w.first[1:])]
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(np.diff(w.first)), pa.array(sums, pa.list_(pa.float64()))], names=["toxic", "n_words", "sums"])

    return docs.select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(run, "toxic long, n_words long, sums array<double>")


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = LABELLED) -> Model | None:
    """The model of a bounded sample of labelled documents; None without both classes.

    What reaches the driver is bounded: ``UNITS`` units, and the segment sums
    of at most ``2 * most`` documents.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample = _sample(docs, labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")), most).collect()
    fit = {k: sum(r["toxic"] == k and r["fit"] for r in sample) for k in (0, 1)}
    if not (fit[0] and fit[1]):
        return None
    spark = df.sparkSession
    ids = F.broadcast(spark.createDataFrame([(r["doc_id"], r["toxic"], r["fit"]) for r in sample], f"doc_id {dict(docs.dtypes)['doc_id']}, toxic int, fit boolean"))
    texts = docs.join(ids, "doc_id")
    share = fit[1] / (fit[0] + fit[1])
    counts = unit_counts(texts.where("fit")).where(F.col("toxic") + F.col("clean") >= LEAST_DOCS)
    total = F.col("toxic") + F.col("clean")
    counts = counts.orderBy(F.desc(F.abs(F.col("toxic") - total * share) / F.sqrt(total)), "unit").limit(UNITS).toPandas()
    units = counts["unit"].to_numpy(np.int64)
    scores = log_odds(units, counts["parent"].to_numpy(np.int64), counts["toxic"].to_numpy(float), counts["clean"].to_numpy(float), share)
    keys = units.view(np.uint64)
    order = np.argsort(keys)
    keys, scores = keys[order], scores[order]
    rows = _best_segments(texts.where(~F.col("fit")), keys, scores).collect()
    labels_of = np.array([r["toxic"] for r in rows], float)
    n = np.array([r["n_words"] for r in rows], float)
    sums = [list(r["sums"]) for r in rows]
    top = np.array([s[0] if s else 0.0 for s in sums])
    decay, scale = extreme_values(top[labels_of == 0], n[labels_of == 0])
    x = np.array([pooled(s, m, decay, scale)[1] for s, m in zip(sums, n)])
    curve = logistic_curve(x, labels_of) if len(set(labels_of)) == 2 else (math.log(share / (1 - share)), 0.0)
    return Model(keys, scores, decay, scale, curve)


def toxic_passages(df: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The columns ``keep`` of every row, its ``score`` (0 to 1), ``n_words`` and its ``passages``.

    ``passages`` are the significant segments (start, end, sum), in words (runs
    of letters) from 0, the end not included.  Null and empty texts and texts
    without a letter have the score of a text without evidence; without a model
    all scores are 0.  Very long texts are scored whole; repeated rows and null
    ids are returned each; other columns are ignored; an empty table gives no
    rows.
    """
    rows = df.select(F.col(text_col).alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)])
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[1:]]
    schema = ", ".join([*kinds, "_score double, _n long, _passages array<struct<start:bigint,end:bigint,sum:double>>"])
    # bounded by UNITS; a plain tuple, so workers need no copy of this package
    sent = df.sparkSession.sparkContext.broadcast(None if model is None else tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions: dict = {}
        model = sent.value and Model(*sent.value)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("sum", pa.float64())]))
        for part, texts in slices(batches, "_text"):
            w = words_of(_lowered(texts), positions=positions, separators=_APART)
            n = np.diff(w.first)
            scores, passages = np.zeros(len(texts)), [[]] * len(texts)
            if model is not None:
                points = word_scores(w, model.units, model.scores)
                for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                    found = maximal_segments(points[a:b])
                    high, x = pooled([s for _, _, s in found], b - a, model.decay, model.scale)
                    scores[i] = 1 / (1 + math.exp(-model.curve[0] - model.curve[1] * math.log1p(x)))
                    passages[i] = [{"start": s, "end": e, "sum": v} for (s, e, v), ok in zip(found, high) if ok]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array(scores), pa.array(n.astype(np.int64)), pa.array(passages, kind)], names=[*part.schema.names[1:], "_score", "_n", "_passages"]
            )

    out = rows.mapInArrow(run, schema)
    own = [F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)]
    return out.select(*own, *[F.col(a).alias(prefix + b) for a, b in (("_score", "score"), ("_n", "n_words"), ("_passages", "passages"))])


def score_documents(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = LABELLED) -> DataFrame:
    """Learn from the labels not held out, score all: doc_id, held_out, score, predicted, n_passages."""
    model = learn(df, labels, id_col, text_col, label_col, most)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = toxic_passages(rows, model)
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), F.size("passages").alias("n_passages")
    )
