"""Language identification by compression with per-language raw-content zstandard dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bound of the training sample: excerpts per language, and characters of an excerpt (from the middle of a text).
EXCERPTS, EXCERPT_CHARS = 1000, 512
#: Texts are compressed in blocks, so that a long text does not become its own dictionary.
BLOCK = 1024
#: Texts shorter than this many bytes use the strategy that finds matches in very short inputs.
SHORT = 256
#: A prediction whose score is below this is rejected: no language compresses the text clearly best.
MARGIN = 0.005


def in_training(id_col: Column) -> Column:
    """Rows that may be learnt from; the others are held out."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3 != 1


def learn(df: DataFrame, text_col: str, lang_col: str, keep: Column, excerpts: int = EXCERPTS) -> dict[str, bytes]:
    """Raw dictionary content per language from a bounded sample of labelled rows.

    Rows are sampled by a hash of the text, so every language fills its bound
    and copies of one text count once; what reaches the driver is at most
    ``excerpts * EXCERPT_CHARS`` characters per language.
    """
    rows = df.where(keep & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    span = 1 << 40
    # about four times the bound by a hash threshold, then the exact bound
    limit = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(span, span * 4 * excerpts // n))])
    hashed = rows.withColumn("h", F.xxhash64("text")).where(F.pmod("h", F.lit(span)) < limit[F.col("lang")])
    middle = F.greatest(F.lit(1), (F.length("text") / 2).cast("int") - EXCERPT_CHARS // 2)
    some = hashed.select("lang", "h", F.lower(F.substring("text", middle, F.lit(EXCERPT_CHARS))).alias("part")).dropDuplicates(["lang", "h"])
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "part"))).where(F.col("r") <= excerpts)
    out: dict[str, list[str]] = {}
    for r in some.orderBy("lang", "r").collect():
        out.setdefault(r["lang"], []).append(r["part"])
    return {k: "\n".join(v).encode() for k, v in sorted(out.items())}


def _parameters(strategy: int) -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters(
        strategy=strategy, min_match=4, window_log=20, hash_log=18, chain_log=18, search_log=3, target_length=16,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )


class Classifier:
    """Compressors of all languages; sizes of a text under each."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = sorted(dictionaries)
        self.compressors = {}
        for strategy in (zstandard.STRATEGY_GREEDY, zstandard.STRATEGY_DFAST):
            row = []
            for k in self.languages:
                own = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                own.precompute_compress(compression_params=_parameters(strategy))
                row.append(zstandard.ZstdCompressor(dict_data=own, compression_params=_parameters(strategy)))
            row.append(zstandard.ZstdCompressor(compression_params=_parameters(strategy)))
            self.compressors[strategy] = row

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes per language, then without any dictionary."""
        data = text.lower().encode()
        row = self.compressors[zstandard.STRATEGY_DFAST if len(data) < SHORT else zstandard.STRATEGY_GREEDY]
        return [sum(len(c.compress(data[i : i + BLOCK])) for i in range(0, len(data), BLOCK)) for c in row]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the smallest wins, ties by name; the score is the part saved against the runner-up."""
        if text is None or not self.languages or not any(c.isalpha() for c in text):
            return "und", 0.0
        *own, plain = self.sizes(text)
        ranked = sorted(zip(own, self.languages))
        second = ranked[1][0] if len(ranked) > 1 else max(plain, ranked[0][0])
        return ranked[0][1], 1.0 - ranked[0][0] / second


def identify(
    df: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", margin: float = MARGIN, prefix: str = ""
) -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` (0 to 1) and ``lang_rejected``.

    Whole texts are compressed.  A null text or one without a letter is
    ``und`` with score 0 and rejected, as is everything when nothing was
    learnt.  A narrow margin keeps its best guess but is rejected.  Other
    columns pass through; ``prefix`` avoids clashes of the three new names.
    """
    sent = df.sparkSession.sparkContext.broadcast(dictionaries)  # bounded: see EXCERPTS

    @F.pandas_udf("struct<lang:string,score:double>")
    def classify(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Classifier(sent.value)
        for part in texts:
            yield pd.DataFrame([model.predict(t) for t in part], columns=["lang", "score"]).astype({"lang": object, "score": float})

    mark = prefix + "_lang_found"
    out = df.withColumn(mark, classify(F.col(text_col)))
    return out.withColumns({
        prefix + "lang_pred": F.col(mark + ".lang"), prefix + "score": F.col(mark + ".score"),
        prefix + "lang_rejected": (F.col(mark + ".lang") == "und") | (F.col(mark + ".score") < margin),
    }).drop(mark)


def classify_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", excerpts: int = EXCERPTS
) -> DataFrame:
    """Learn from the rows not held out, predict all: doc_id, held_out, lang_pred, score, lang_rejected.

    A null id is neither learnt from nor held out; repeated rows are all kept.
    """
    keep = in_training(F.col(id_col))
    model = learn(df, text_col, lang_col, keep, excerpts)
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(~keep, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score", "lang_rejected")
