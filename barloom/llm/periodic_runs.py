"""Runs of words that repeat with a period inside one text, by seeds on diagonals that are extended.

1. A run of period q has at least ``TIMES`` q words, so it equals itself q
   words later over at least ``(TIMES - 1) q`` words (``LEAST - q`` for short
   periods).  Lags are taken in classes: k is the overlap that every lag of a
   class guarantees, and the k-grams of a text are indexed by hash.
2. An occurrence of a k-gram and the next one in the same text are a seed on
   the diagonal of their lag.  A class spans less than a factor of 1.5, so
   inside a run no k-gram comes back before the period is over: each run is
   seeded, on the diagonal of its smallest period only, and pairs grow with
   the words, not with their square.
3. Seeds are extended to both sides word by word.  A table holds how far each
   lag is covered; a seed inside a covered stretch is not extended again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import marked_words
from .wordhash import Words, mix, slices, words_of

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 6, 4
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def next_pairs(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and their next ones with an equal key (``at`` grows), and which positions have an equal one at all."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    a, b = order[:-1][same], order[1:][same]
    repeated = np.zeros(len(at), bool)
    repeated[a] = repeated[b] = True
    return at[a], at[b], repeated


def equal_ahead(ids: np.ndarray, i: int, lag: int, stop: int) -> int:
    """First position from ``i`` on, at most ``stop``, whose word differs from the word ``lag`` later."""
    step = 32
    while i < stop:
        to = min(i + step, stop)
        differ = ids[i:to] != ids[i + lag : to + lag]
        if differ.any():
            return i + int(differ.argmax())
        i, step = to, 2 * step
    return stop


def find_runs(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, ordered by start, then period; start counts the words of all texts."""
    n = len(w.hash)
    most = int(np.diff(w.first).max()) if n else 0
    at, names, width = np.arange(n), mix(w.hash), 1  # names[i]: hash of the ``width`` words from i on
    found: list[tuple[int, int, int]] = []
    lag = 1
    while max(LEAST, TIMES * lag) <= most and len(at):
        beyond = max(lag + 1, -(-3 * lag // 2))
        k = max(LEAST - lag, (TIMES - 1) * lag)
        while 2 * width <= k:
            names = mix(names[:-width] + mix(names[width:] ^ np.uint64(0x5851F42D4C957F2D)))
            width *= 2
        at = at[at <= n - k]
        at = at[w.owner[at] == w.owner[at + k - 1]]
        if not len(at):
            break
        gram = mix(names[at] + mix(names[at + k - width] ^ np.uint64(0x14057B7EF767814F)))
        a, b, repeated = next_pairs(at, mix(gram + mix(w.owner[at].astype(np.uint64))))
        lags = b - a
        seeded = (lags >= lag) & (lags < beyond)
        a, lags = a[seeded], lags[seeded]
        order = np.lexsort((a, lags))
        a, lags = a[order], lags[order]
        # of seeds next to each other on one diagonal the first one covers the others
        heads = np.ones(len(a), bool)
        heads[1:] = (lags[1:] != lags[:-1]) | (a[1:] != a[:-1] + 1)
        covered: dict[int, int] = {}
        for i, q in zip(a[heads].tolist(), lags[heads].tolist()):
            if i < covered.get(q, 0):
                continue
            text = w.owner[i]
            begin, stop = i, int(w.first[text + 1]) - q
            while begin > w.first[text] and w.hash[begin - 1] == w.hash[begin - 1 + q]:
                begin -= 1
            covered[q] = end = equal_ahead(w.hash, i, q, stop)
            if end - begin + q >= max(LEAST, TIMES * q):
                found.append((begin, end - begin + q, q))
        at, lag = at[repeated], beyond
    runs = np.array(found, np.int64).reshape(-1, 3)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


def periodic_runs(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The columns ``keep`` of every row with its ``runs`` and its ``collapsed`` text.

    ``runs`` are (start, length, period), counted in words from 0, by start and
    then period: every stretch of words with a smallest period q of which it
    has at least max(``LEAST``, ``TIMES`` q) words and that cannot be made
    longer.  ``collapsed`` are the words joined by single spaces, without those
    that lie in a run after its first period.  ``prefix`` avoids clashes of the
    two names.

    Null, empty and white texts have no runs and an empty collapsed text; very
    long texts are taken whole, alone in memory; repeated rows and null ids
    are returned each; other columns are ignored; an empty table gives no rows.
    """
    rows = df.select(F.col(text_col).alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)])
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[1:]] + [f"_runs array<{RUN}>", "_collapsed string"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions: dict = {}
        for part, texts in slices(batches, "_text"):
            w = words_of(texts, positions=positions)
            start, length, period = find_runs(w)
            stays = ~marked_words(start + period, length - period, len(w.hash))
            lost = np.add.reduceat(np.append(~stays, False), w.first[:-1]) * (np.diff(w.first) > 0) if len(texts) else []
            collapsed = []
            for i, t in enumerate(texts):
                words = t.split()
                collapsed.append(b" ".join(compress(words, stays[w.first[i] : w.first[i + 1]].tolist()) if lost[i] else words))
            runs = pa.StructArray.from_arrays([pa.array(start - w.first[w.owner[start]]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
            ends = np.searchsorted(start, w.first).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.ListArray.from_arrays(pa.array(ends), runs), pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=[*part.schema.names[1:], "_runs", "_collapsed"],
            )

    out = rows.mapInArrow(scan, schema)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], F.col("_runs").alias(f"{prefix}runs"), F.col("_collapsed").alias(f"{prefix}collapsed"))


def planted(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and text; of every tenth row by the CRC of its id, the words from one place on are those of one period again and again."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # a column of its own: inside the function of transform() the text would be cut anew for each word
    rows = rows.withColumn("words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n = F.size("words")
    rows = rows.withColumn("a", F.when(n > 0, g % n)).withColumn("p", F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + g % 8)))
    a = F.col("a")
    again = F.transform("words", lambda word, i: F.when(i < a, word).otherwise(F.get("words", (a + (i - a) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(n > 0, F.concat_ws(" ", again)).otherwise(F.col("text")).alias("text"))


def run_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_runs, the longest run (ties: first start, then period; null without one) and digests of runs and collapsed text."""
    found = periodic_runs(planted(df, id_col, text_col))
    runs = F.col("runs")
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = found.select("doc_id", "collapsed", F.size(runs).cast("long").alias("n_runs"), best.alias("b"), F.concat_ws("", lines).alias("lines"))
    return out.select(
        "doc_id", "n_runs", F.col("b.s").alias("start"), (-F.col("b.l")).alias("length"), F.col("b.p").alias("period"),
        F.expr("(-b.l * 1000) div b.p").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Pairs of equal 5-grams up to a quarter of the text apart, joined to stretches by lag; stretches inside one of a smaller lag have that period.
SQL = r"""
WITH RECURSIVE crc_table(i, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_table WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM crc_table WHERE k = 8),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
      lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295::BIGINT) AS h
  FROM documents, crc
), places AS (SELECT r, doc_id, ws, h, len(ws) AS n, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM docs),
periods AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM places),
changed AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(0, n), lambda i: ws[CASE WHEN i < a THEN i + 1 ELSE a + (i - a) % p + 1 END]) ELSE ws END AS ws
  FROM periods
), words AS (SELECT r, n, unnest(range(0, n)) AS i, unnest(ws) AS w FROM changed),
grams AS (
  SELECT r, n, i, md5(string_agg(w, ' ') OVER five) AS g FROM words
  WINDOW five AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) QUALIFY count(*) OVER five = 5
), pairs AS (SELECT a.r, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.r = b.r AND a.g = b.g AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
stretches AS (SELECT r, q, min(i) AS s, count(*) + 4 + q AS l FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pairs) GROUP BY r, q, k),
long AS (SELECT * FROM stretches WHERE l >= greatest(6, 4 * q)),
runs AS (SELECT * FROM long x WHERE NOT EXISTS (SELECT 1 FROM long y WHERE y.r = x.r AND y.q < x.q AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
told AS (
  SELECT r, count(*) AS n_runs, first(s ORDER BY l DESC, s, q) AS start, first(l ORDER BY l DESC, s, q) AS length, first(q ORDER BY l DESC, s, q) AS period,
    string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines
  FROM runs GROUP BY r
), lost AS (SELECT DISTINCT w.r, w.i FROM words w JOIN runs x ON w.r = x.r AND w.i >= x.s + x.q AND w.i < x.s + x.l),
rest AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS t FROM words ANTI JOIN lost USING (r, i) GROUP BY r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(rest.t, '')) AS collapsed_sha256
FROM changed LEFT JOIN told USING (r) LEFT JOIN rest USING (r)
"""
