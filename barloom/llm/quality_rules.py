"""Quality rules on repetition inside a text, from a suffix array over its words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import Words, mix, shingles, slices, words_of

#: Repeats shorter than this many words do not count.
LEAST_REPEAT = 16
#: Largest part of a text's words inside repeats, in percent, and longest repeat in words.
MOST_COVERED, LONGEST_REPEAT = 40, 200
LEAST_WORDS, MOST_REPEAT_WORDS = 50, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between consecutive ``bounds``."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def marked_words(hits: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Whether each of ``n`` words lies in a span that starts at ``hits`` and has ``lengths`` words."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, hits, 1)
    np.add.at(step, hits + lengths, -1)
    return np.cumsum(step[:-1]) > 0


def repeated_windows(w: Words, k: int) -> np.ndarray:
    """Positions of the k-word windows that occur twice or more in their own text."""
    at = np.arange(max(len(w.hash) - k + 1, 0))
    at = at[w.owner[at] == w.owner[at + k - 1]]
    key = mix(shingles(w.hash, k)[at] + mix(w.owner[at].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return at[twice]


def suffix_repeats(w: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, words) of the longest repeat that begins at each word, where it has ``least`` words or more.

    Suffixes are sorted by prefix doubling.  The texts of a batch share one
    array of words tagged with their text, so no two texts share a prefix.
    Only suffixes whose first ``least`` words repeat enter the suffix array,
    and only words inside repeats (and the word after) get ranks.  The length
    that neighbours in the array share follows from the ranks of all rounds;
    the larger one of a suffix's two neighbours is the depth of the LCP
    interval it belongs to, so its longest repeat.
    """
    at = repeated_windows(w, least)
    n = len(w.hash)
    if not len(at):
        return at, at
    inside = np.flatnonzero(marked_words(at, least, n))
    inside = np.unique(np.concatenate((inside, inside[inside < n - 1] + 1)))
    lone = -1 - np.arange(n + 1)  # a rank no other position has
    rank = lone.copy()
    tagged = mix(w.hash[inside] + mix(w.owner[inside].astype(np.uint64)))
    rank[inside] = np.unique(tagged, return_inverse=True)[1]
    rounds, length = [(1, rank)], 1
    while len(np.unique(rank[at])) < len(at):
        pair = rank[inside] * (2 * n + 4) + rank[np.minimum(inside + length, n)] + n + 2
        rank = lone.copy()
        rank[inside] = np.unique(pair, return_inverse=True)[1]
        length *= 2
        rounds.append((length, rank))
    order = at[np.argsort(rank[at])]
    i, j = order[:-1], order[1:]
    shared = np.zeros(len(i), np.int64)
    for length, rank in reversed(rounds):
        step = np.where(rank[i] == rank[j], length, 0)
        shared += step
        i, j = np.minimum(i + step, n), np.minimum(j + step, n)
    best = np.zeros(n, np.int64)
    best[order[:-1]] = shared
    best[order[1:]] = np.maximum(best[order[1:]], shared)
    return at, best[at]


def text_figures(texts: list[bytes], least: int = LEAST_REPEAT, positions: dict | None = None) -> dict[str, np.ndarray]:
    """All counts of the rules for each text."""
    w = words_of(texts, positions=positions)
    n, m = len(texts), len(w.hash)
    white = _WHITE[w.data]
    lines = np.flatnonzero(w.data == 10)
    begins = np.concatenate(([0], lines[:-1] + 1)) if len(lines) else lines
    worded = per_text(~white, np.append(begins, len(w.data))) > 0 if len(lines) else np.zeros(0, bool)
    begins, ends = begins[worded], lines[worded]
    owner = np.searchsorted(w.offsets, begins, side="right") - 1
    key = np.unique(mix(w.spans(begins, ends) + mix(owner.astype(np.uint64))), return_index=True)[1]
    at, longest = suffix_repeats(w, least)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, w.owner[at], longest)
    return {
        "n_words": np.diff(w.first),
        "word_chars": per_text(~white & _STARTS_CHAR[w.data], w.offsets),
        "n_symbols": per_text(_SYMBOL[w.data], w.offsets),
        "n_dup_lines": np.bincount(owner, minlength=n) - np.bincount(owner[key], minlength=n),
        "n_repeat_words": per_text(marked_words(repeated_windows(w, 3), 3, m), w.first),
        "covered_words": per_text(marked_words(at, longest, m), w.first),
        "longest_repeat": top,
    }


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def _judged(df: DataFrame, columns: list, text_col: str, least_repeat: int, most_covered: int, longest_repeat: int) -> DataFrame:
    """The given columns as _c0, _c1, ..., the figures of the whole texts, base_failed and kept."""
    rows = df.select(F.col(text_col).alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)])
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[1:]] + [f"{c} long" for c in FIGURES])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions: dict = {}
        for part, texts in slices(batches, "_text"):
            found = text_figures(texts, least_repeat, positions)
            yield pa.RecordBatch.from_arrays(
                part.columns[1:] + [pa.array(found[c].astype(np.int64)) for c in FIGURES], names=part.schema.names[1:] + list(FIGURES)
            )

    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_WORDS * F.col("n_words"))
    fine = (100 * F.col("covered_words") <= most_covered * F.col("n_words")) & (F.col("longest_repeat") <= longest_repeat)
    return rows.mapInArrow(judge, schema).withColumns({"base_failed": failed, "kept": ~failed & fine})


def repetition_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    least_repeat: int = LEAST_REPEAT, most_covered: int = MOST_COVERED, longest_repeat: int = LONGEST_REPEAT,
) -> DataFrame:
    """doc_id, the figures of every whole text, base_failed and kept.

    A text fails the base rule below 50 words or with over half of its words in
    repeated 3-word windows.  Otherwise it is kept while at most
    ``most_covered`` percent of its words lie in repeats of ``least_repeat``
    words or more and none of these has over ``longest_repeat`` words.

    Null and empty texts have no words and fail; repeated rows and rows with a
    null id are judged each; other columns are ignored; an empty table gives no
    rows.
    """
    out = _judged(df, [id_col], text_col, least_repeat, most_covered, longest_repeat)
    return out.select(F.col("_c0").alias("doc_id"), *FIGURES, "base_failed", "kept")


def keep_unrepetitive(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns unchanged, whose texts :func:`repetition_rules` keeps."""
    out = _judged(df, df.columns, text_col, LEAST_REPEAT, MOST_COVERED, LONGEST_REPEAT).where("kept")
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(df.columns)])


#: Repeats of k words or more cover a word exactly where a repeated k-word window does.
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM docs),
spots AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM split),
w3 AS (SELECT r, i, count(*) OVER (PARTITION BY r, list_slice(ws, i, i + 2)) AS n FROM spots WHERE i + 2 <= len(ws)),
wk AS (SELECT r, i, count(*) OVER (PARTITION BY r, list_slice(ws, i, i + {LEAST_REPEAT - 1})) AS n FROM spots WHERE i + {LEAST_REPEAT - 1} <= len(ws)),
c3 AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM w3 WHERE n > 1) GROUP BY r),
ck AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + {LEAST_REPEAT})) AS j FROM wk WHERE n > 1) GROUP BY r),
far AS (SELECT DISTINCT r FROM (
  SELECT r, i FROM spots WHERE i + {LONGEST_REPEAT} <= len(ws)
  QUALIFY count(*) OVER (PARTITION BY r, hash(list_slice(ws, i, i + {LONGEST_REPEAT}))) > 1)),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM docs)
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
figures AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c3.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(ck.n, 0) AS BIGINT) AS covered_words, far.r IS NOT NULL AS long_repeat
  FROM split LEFT JOIN c3 USING (r) LEFT JOIN ck USING (r) LEFT JOIN far USING (r) LEFT JOIN lines USING (r)
), judged AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEAT_WORDS} * n_words AS base_failed FROM figures
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, base_failed,
  NOT base_failed AND 100 * covered_words <= {MOST_COVERED} * n_words AND NOT long_repeat AS kept
FROM judged
"""
