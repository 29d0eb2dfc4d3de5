"""Removal of repeated passages: paragraphs that collide under banded MinHash, verified and clustered.

A paragraph is a line.  Its words' 5-word shingles give a MinHash signature;
bands are tuned for recall, and colliding paragraphs are verified by exact
Jaccard similarity.  Connected components of verified pairs are the clusters;
the first occurrence, by document and place, stays.

A passage pasted into the middle of a longer line has no line of its own, and
one set in short lines has no paragraph.  So the words of the whole document,
across line ends, are also compared: of every ``WINDOW`` consecutive runs of
``LEAST_RUN`` words the one with the least hash is an anchor.  Two places that
share ``LEAST_RUN + WINDOW - 1`` = 49 words or more share an anchor, whatever
stands around them.  Equal anchors are exact copies; those of one passage
overlap or touch, and the united span is extended word by word on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, written
from .ngram_join import grouped_links
from .wordhash import Words, mix, shingles, slices, words_of

#: Words per shingle and Jaccard similarity of near copies.
SHINGLE, PERCENT = 5, 80
#: Bands of two rows each: a pair at the threshold is missed with probability (1 - 0.8**2)**5 < 0.7 %.
BANDS, ROWS = 5, 2
#: Shortest line that is a paragraph, and shortest copied run of a document that is removed (words).
LEAST_PARAGRAPH, LEAST_RUN = 20, 25
#: Runs of ``LEAST_RUN`` words of which one is an anchor; at most ``LEAST_RUN``, so that neighbouring anchors leave no gap.
WINDOW = 25
#: A cut is the least hash among so many shingles on either side.
REACH = 5
_BASE = 0xD1342543DE82EF95
_SEEDS = [(0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64)) | 1 for i in range(BANDS * ROWS)]


def _lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, byte start, byte end) of each line with a word."""
    ends = np.flatnonzero(w.data == 10)
    begins = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    first, last = np.searchsorted(w.start, begins), np.searchsorted(w.start, ends)
    some = last > first
    return first[some], last[some], begins[some], ends[some]


def _line_keys(w: Words, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return w.spans(begins, ends)


def _distinct(grams: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many different values each span has."""
    line = np.repeat(np.arange(len(begin)), end - begin)
    value = grams[np.arange(len(line)) + np.repeat(begin - np.cumsum(end - begin) + (end - begin), end - begin)]
    order = np.lexsort((value, line))
    line, value = line[order], value[order]
    new = np.append(True, (line[1:] != line[:-1]) | (value[1:] != value[:-1]))
    return np.bincount(line[new], minlength=len(begin))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.ones(n + 1, np.uint64)
    up[1:] = np.uint64(_BASE)
    down = np.ones(n + 1, np.uint64)
    down[1:] = np.uint64(pow(_BASE, -1, 1 << 64))
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _cuts(grams: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Positions whose shingle hash is the least, leftmost of equals, within ``REACH`` on either side (the operator uses :func:`_anchors`)."""
    top = np.uint64(2**64 - 1)
    h = np.where(valid, grams, top)
    least = valid.copy()
    for d in range(1, REACH + 1):
        least[d:] &= h[d:] < h[:-d]
        least[:-d] &= h[:-d] <= h[d:]
    return np.flatnonzero(least)


def _anchors(grams: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Positions, leftmost of equals, of the least hash of any ``WINDOW`` positions from a valid one on.

    At least ``WINDOW - 1`` positions that are not valid follow the valid ones
    of a document.  Windows that reach beyond count at a document's begin
    only.  A position is left out if the hash also stands less than
    ``LEAST_RUN`` positions before it: the text repeats itself there, and
    what overlaps itself is no copy.
    """
    top = np.uint64(2**64 - 1)
    h = np.concatenate((np.where(valid, grams, top), np.full(WINDOW, top)))
    valid = np.concatenate((valid, np.zeros(WINDOW, bool)))
    begins = valid.copy()
    begins[1:] &= ~valid[:-1]
    j = np.flatnonzero(valid[: -WINDOW + 1] & (valid[WINDOW - 1 :] | begins[: -WINDOW + 1]))
    if not len(j):
        return j
    found = np.unique(j + np.lib.stride_tricks.sliding_window_view(h, WINDOW).argmin(axis=1)[j])
    again = np.zeros(len(found), bool)
    for d in range(1, LEAST_RUN):
        again |= (h[found] == h[found - d]) & (found >= d)
    return found[~again]


def _units(docs: DataFrame) -> DataFrame:
    """kind 0: a paragraph (key h); 1: n words of a document from an anchor on (key h); 2: a band (key h) of paragraph ``doc`` with n different shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions: dict = {}
        for part, texts in slices(batches, "text"):
            w = words_of(texts, lower=True, positions=positions)
            ids = part.column(0).cast(pa.int64())
            known = ~np.asarray(ids.is_null())
            ids = np.asarray(ids.fill_null(0))
            grams = shingles(w.hash, SHINGLE)
            kinds, hs, docs_, ats, ns = [], [], [], [], []

            def add(kind, h, doc, at, n):
                kinds.append(np.full(len(h), kind, np.int32)), hs.append(h), docs_.append(doc), ats.append(at), ns.append(n)

            first, last, begins, ends = _lines(w)
            keep = (last - first >= LEAST_PARAGRAPH) & known[w.owner[first]]
            first, last, begins, ends = first[keep], last[keep], begins[keep], ends[keep]
            if len(first):
                owner = w.owner[first]
                key = _line_keys(w, begins, ends).view(np.int64)
                # bands over each line's shingles
                edges = np.stack((first, last - SHINGLE + 1), axis=1).reshape(-1)
                fit = np.append(grams, np.uint64(2**64 - 1))
                n_grams = _distinct(grams, first, last - SHINGLE + 1)
                add(0, key, ids[owner], first - w.first[owner], last - first)
                for band in range(BANDS):
                    value = np.full(len(first), np.uint64(band))
                    for seed in _SEEDS[band * ROWS : (band + 1) * ROWS]:
                        value = mix(value ^ np.minimum.reduceat(mix(fit * np.uint64(seed)), edges)[::2])
                    add(2, value.view(np.int64), key, np.zeros(len(first), np.int64), n_grams)
            # anchors, over the words of the whole document: a passage may be laid out in short lines
            runs = shingles(w.hash, LEAST_RUN)
            open_ = np.zeros(len(runs) + 1, np.int64)
            fits = known & (np.diff(w.first) >= LEAST_RUN)
            np.add.at(open_, w.first[:-1][fits], 1)
            np.add.at(open_, w.first[1:][fits] - LEAST_RUN + 1, -1)
            at = _anchors(runs, np.cumsum(open_[:-1]) > 0)
            if len(at):
                doc = w.owner[at]
                add(1, runs[at].view(np.int64), ids[doc], at - w.first[doc], np.full(len(at), LEAST_RUN, np.int64))
                # where the text repeats itself anchors are rare: the words as far as the next one, or the end, are a unit too
                stop = np.append(at[1:], 0) + LEAST_RUN
                final = np.append(doc[1:] != doc[:-1], True)
                stop[final] = w.first[doc[final] + 1]
                far = stop - at >= LEAST_RUN + np.where(final, WINDOW, WINDOW + 1)
                start, stop, doc = at[far], stop[far], doc[far]
                if len(start):
                    up, down = _powers(len(w.hash))
                    total = np.concatenate(([np.uint64(0)], np.cumsum(w.hash * up[:-1], dtype=np.uint64)))
                    value = mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))
                    add(1, value.view(np.int64), ids[doc], start - w.first[doc], stop - start)
            if kinds:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (kinds, hs, docs_, ats, ns)], names=["kind", "h", "doc", "at", "n"]
                )

    return docs.mapInArrow(run, "kind int, h long, doc long, at long, n long")


def _paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): key and text of every paragraph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions: dict = {}
        for _, texts in slices(batches, "text"):
            w = words_of(texts, lower=True, positions=positions)
            first, last, begins, ends = _lines(w)
            long = last - first >= LEAST_PARAGRAPH
            begins, ends = begins[long], ends[long]
            keys = _line_keys(w, begins, ends).view(np.int64)
            data = w.data.tobytes()
            lines = [data[a:b] for a, b in zip(begins.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(lines, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return docs.mapInArrow(run, "doc_id long, text string")


def _later(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a key that are not its first occurrence (by document and place)."""
    first = rows.groupBy(key).agg(F.min(F.struct("doc", "at")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    return rows.join(first.select(key, "first"), key).where(F.struct("doc", "at") != F.col("first"))


def _copied_runs(parts: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, at, n, left, right): united spans of later copies; hashes of the words left and right of their first occurrence."""
    by = ["doc", "doc0", "shift"]
    later = _later(parts, "h").select("doc", "at", (F.col("at") + F.col("n")).alias("end"), F.col("first.doc").alias("doc0"), (F.col("at") - F.col("first.at")).alias("shift"))
    order = Window.partitionBy(*by).orderBy("at", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("_new", F.coalesce((before < F.col("at")).cast("int"), F.lit(1)))
    later = later.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = later.groupBy(*by, "_run").agg(F.min("at").alias("at"), F.max("end").alias("end"))
    runs = written(runs.select("doc", "doc0", "at", "end", (F.col("at") - F.col("shift")).alias("at0"), (F.col("end") - F.col("shift")).alias("end0")), "copied-runs")
    edges = runs.select("doc0", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("at0").alias("pos")), F.struct(F.lit(1).alias("side"), F.col("end0").alias("pos")))).alias("e"))
    # a text has at most two edges a word
    asked = edges.distinct().groupBy("doc0").agg(F.collect_list("e").alias("edges"))
    texts = docs.join(asked, docs["doc_id"] == asked["doc0"]).select("doc0", "text", "edges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions: dict = {}
        for part, texts in slices(batches, "text"):
            w = words_of(texts, lower=True, positions=positions)
            owners, sides, at, words = [], [], [], []
            for i, (d, edges) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist())):
                own = w.hash[w.first[i] : w.first[i + 1]]
                for e in edges:
                    side, pos = e["side"], e["pos"]
                    owners.append(d), sides.append(side), at.append(pos)
                    words.append((own[pos : pos + WINDOW] if side else own[max(pos - WINDOW, 0) : pos]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(owners, pa.int64()), pa.array(sides, pa.int32()), pa.array(at, pa.int64()), pa.array(words, pa.binary())],
                names=["doc0", "side", "pos", "words"],
            )

    around = written(texts.mapInArrow(run, "doc0 long, side int, pos long, words binary").dropDuplicates(["doc0", "side", "pos"]), "copied-edges")
    left = around.where("side = 0").select("doc0", F.col("pos").alias("at0"), F.col("words").alias("left"))
    right = around.where("side = 1").select("doc0", F.col("pos").alias("end0"), F.col("words").alias("right"))
    return runs.join(left, ["doc0", "at0"]).join(right, ["doc0", "end0"]).select("doc", "at", (F.col("end") - F.col("at")).alias("n"), "left", "right")


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two sequences have in common from their begin on."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def cut_text(text: bytes, spans: list[tuple], positions: dict | None = None) -> tuple[bytes, int, int]:
    """Text without the copied spans (kind, first word, words); words and spans removed.

    A span may be followed by the hashes of the words left and right of its
    first occurrence: it goes as far as they are the same here.
    Untouched lines stay as they are; a line that loses words keeps the rest,
    trimmed and joined by spaces; a line without words left goes.
    """
    w = words_of([text], lower=True, positions=positions)
    gone = np.zeros(len(w.hash) + 1, bool)
    removed = 0
    parts, runs = [], []
    for kind, at, n, *around in spans:
        a, b = at, at + n
        if around and around[0] is not None:
            a -= _equal(np.frombuffer(around[0], np.uint64)[::-1], w.hash[:a][::-1])
            b += _equal(np.frombuffer(around[1], np.uint64), w.hash[b:])
        (parts if kind == 1 else runs).append((a, b))
    parts.sort()
    begin = end = None
    for a, b in [*parts, (1 << 60, 1 << 60)]:
        if end is not None and a <= end:
            end = max(end, b)
            continue
        if end is not None and end - begin >= LEAST_RUN:
            runs.append((begin, end))
        begin, end = a, b
    for a, b in runs:
        removed += not gone[a:b].all()
        gone[a:b] = True
    if not removed:
        return text, 0, 0
    out = []
    first, last, begins, ends = _lines(w)
    touched = {}
    for a, b, x, y in zip(first.tolist(), last.tolist(), begins.tolist(), ends.tolist()):
        if gone[a:b].any():
            kept, i = [], a
            while i < b:
                if gone[i]:
                    i += 1
                    continue
                j = i
                while j < b and not gone[j]:
                    j += 1
                kept.append(text[w.start[i] : w.end[j - 1]])
                i = j
            touched[x] = b" ".join(kept) if kept else None
    at = 0
    for line in text.split(b"\n"):
        new = touched.get(at, line)
        if new is not None:
            out.append(new)
        at += len(line) + 1
    return b"\n".join(out), int(gone.sum()), removed


def dedup_paragraphs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text without later copies, n_words_removed, n_spans_removed, and the ``keep`` columns of ``df`` unchanged.

    Null texts stay null, empty ones empty.  Ids are integers; rows with a null
    id are returned unchanged and are no source of copies; repeated rows (same
    id and text) count as one document and are each returned.  Ties go to the
    smaller id, then the earlier place.  Columns not named are ignored.
    """
    named = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    units = written(_units(docs), "paragraph-units")
    bands = units.where("kind = 2").select(F.col("h").alias("gram"), "doc", "n", F.col("doc").alias("s1"))
    own = units.where("kind = 0").select("h", "doc", "at", "n")
    texts = _paragraphs(docs)
    parts = _copied_runs(units.where("kind = 1").select("h", "doc", "at", "n"), docs)
    edges = grouped_links(bands, texts, SHINGLE, PERCENT, once=True)
    clusters = components(edges)
    occurrences = own.join(clusters, F.col("h") == F.col("id"), "left").select(F.coalesce("component", "h").alias("c"), "doc", "at", "n")
    nothing = F.lit(None).cast("binary")
    later = _later(occurrences, "c").select("doc", F.lit(0).alias("kind"), "at", "n", nothing.alias("left"), nothing.alias("right"))
    later = later.union(parts.select("doc", F.lit(1).alias("kind"), "at", "n", "left", "right"))
    spans = later.groupBy("doc").agg(F.collect_list(F.struct("kind", "at", "n", "left", "right")).alias("_spans"))
    types = dict(df.dtypes)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *named)
    rows = rows.join(spans, rows["doc_id"].cast("long") == spans["doc"], "left").drop("doc")
    schema = f"doc_id {types[id_col]}, text string, n_words_removed long, n_spans_removed long" + "".join(
        f", _keep{i} {types[c]}" for i, c in enumerate(keep)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions: dict = {}
        for part, texts in slices(batches, "_text"):
            names = part.schema.names
            known = np.asarray(part.column(names.index("_text")).is_valid())
            words, count = [0] * len(texts), [0] * len(texts)
            for i, spans in enumerate(part.column(names.index("_spans")).to_pylist()):
                if spans and texts[i]:
                    texts[i], words[i], count[i] = cut_text(texts[i], [(s["kind"], s["at"], s["n"], s["left"], s["right"]) for s in spans], positions)
            extra = [n for n in names if n.startswith("_keep")]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(texts, pa.binary(), mask=~known).cast(pa.string()), pa.array(words, pa.int64()), pa.array(count, pa.int64())]
                + [part.column(names.index(n)) for n in extra],
                names=["doc_id", "text", "n_words_removed", "n_spans_removed", *extra],
            )

    out = rows.mapInArrow(run, schema)
    return out.select("doc_id", "text", "n_words_removed", "n_spans_removed", *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)])
