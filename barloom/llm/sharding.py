"""Rendezvous sharding of stable record keys over weighted shards, in DataFrame expressions only.

Each (key, shard) pair has a hash ``u`` in (0, 1); a key goes to the shard
with the smallest ``-ln(u) / weight``.  A shard's share is proportional to its
weight, and a shard that is added takes rows only into itself: the scores of
the other shards do not change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dense_rank_in

#: 52 bits of an MD5 digest, so that u is an exact double strictly between 0 and 1.
HASH_HEX, HASH_SPAN = 13, 2.0**52


def unit_hash(key: Column, shard: int) -> Column:
    """Hash of (key, shard) strictly between 0 and 1."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"/{shard}"))
    digits = F.conv(F.substring(F.md5(text), 1, HASH_HEX), 16, 10).cast("double")
    return (digits + F.lit(0.5)) / F.lit(HASH_SPAN)


def rendezvous(key: Column, weights: list[float], names: list[int] | None = None) -> Column:
    """Number of the shard that ``key`` belongs to; ties go to the lower number.

    A null key counts as the empty string.  Weights of 0 keep a shard empty;
    negative or all-zero weights are an error.  ``names`` are the stable
    numbers of the shards (0, 1, ... by default): hashes depend on them, not
    on a shard's place in the list.
    """
    names = list(range(len(weights))) if names is None else names
    if any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must not be negative, and one must be positive")
    scored = [
        F.struct((-F.log(unit_hash(key, s)) / F.lit(float(w))).alias("score"), F.lit(s).alias("shard"))
        for s, w in zip(names, weights)
        if w > 0
    ]
    return (F.least(*scored) if len(scored) > 1 else scored[0])["shard"]


def shard_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, weights: list[float] | None = None, cells: int = 4096
) -> DataFrame:
    """Shard, place inside the shard, and the shard with one shard more.

    Null ids hash as the empty key, null texts have size 1 and CRC 0, repeated
    ids share a shard (equal rows take neighbouring slots), other columns are
    ignored, an empty table gives an empty result.  Places are counted in
    ``cells`` hash cells per shard, so no task sorts a whole shard; the text
    itself is not shuffled.
    """
    weights = weights or [1.0] * shards
    base = df.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(F.col(text_col), "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = base.withColumns({"shard": rendezvous(F.col("doc_id"), weights)})
    grown = rendezvous(F.col("doc_id"), [*weights, weights[-1]])
    placed = placed.withColumn("grown_shard", grown)
    # the cell hash must not follow the shard hash, and is one that SQL engines share
    cell = F.conv(F.substring(F.md5(F.concat(F.lit("cell/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10)
    out = dense_rank_in(
        placed, "shard", [F.col("doc_id"), F.col("size"), F.col("text_crc32")], F.pmod(cell.cast("long"), F.lit(cells)), "slot"
    )
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: Reflected CRC-32 of the text's bytes by table, then the same places as above.
SQL = """
WITH RECURSIVE crc_table(i, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_table WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM crc_table WHERE k = 8),
base AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), crcs AS (
  SELECT doc_id, size, CAST(xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, size - 1), lambda i: ('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)),
    lambda a, b: xor(a >> 8, t[CAST(xor(a & 255, b) + 1 AS BIGINT)])), 4294967295::BIGINT) AS BIGINT) AS text_crc32
  FROM base, crc
), scored AS (
  SELECT doc_id, size, text_crc32, s,
    -ln((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || CAST(s AS VARCHAR)), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496) AS score
  FROM crcs, (SELECT range AS s FROM range(17))
), placed AS (
  SELECT doc_id, size, text_crc32, CAST(arg_min(s, score) FILTER (s < 16) AS INTEGER) AS shard, CAST(arg_min(s, score) AS INTEGER) AS grown_shard,
    ('0x' || substr(md5('cell/' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 4096 AS cell
  FROM scored GROUP BY ALL
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY cell, doc_id) - 1 AS BIGINT) AS slot, grown_shard
FROM placed
"""
