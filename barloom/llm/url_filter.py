"""URL judging: host/path rules first, then a weighted vocabulary found by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (action, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: One of these terms rejects a url.
STRICT = ("porn", "xxx", "viagra", "casino", "escort", "spam-farm", "cheap-pills", "free-bets")
#: So many different ones of these reject a url.
SOFT = ("adult", "bet", "bets", "bingo", "bonus", "cheap", "dating", "discount", "farm", "free", "gambling", "jackpot", "loan", "pills", "poker", "sex", "slots", "spam", "win")
SOFT_HITS = 2


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits; a tie goes to the longer host; null if none fits."""
    rule = action = None
    for act, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        action = F.when(fits, F.lit(act)) if action is None else action.when(fits, F.lit(act))
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, action)


def vocabulary(strict=STRICT, soft=SOFT) -> ahocorasick.Automaton:
    """Automaton over both lists; a term in both counts as strict."""
    found = ahocorasick.Automaton()
    for kind, terms in ((False, soft), (True, strict)):
        for t in terms:
            found.add_word(t.lower(), (kind, t.lower()))
    found.make_automaton()
    return found


def term_hits(url: str | None, found: ahocorasick.Automaton) -> tuple[int, int]:
    """(distinct strict, distinct soft) terms that stand between non-alphanumerics (ASCII) in the url."""
    if not url:
        return 0, 0
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url)
    plain = lambda i: not (0 <= i < len(text)) or not (text[i].isascii() and text[i].isalnum())
    strict, soft = set(), set()
    for end, (kind, term) in found.iter(text):
        if plain(end - len(term)) and plain(end + 1):
            (strict if kind else soft).add(term)
    return len(strict), len(soft)


def judge_urls(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_hits: int = SOFT_HITS
) -> DataFrame:
    """Host, path, rule and verdict of every row, with the counts of vocabulary terms.

    A rule's verdict holds; without a rule one strict or ``soft_hits`` distinct
    soft terms block.  Null urls and urls without ``://`` have an empty host
    and path, so no rule fits; the vocabulary still reads what there is (a null
    has no terms).  Rows with equal or null ids are kept as they are; other
    columns are ignored.
    """

    @F.pandas_udf("struct<strict:int,soft:int>")
    def hits(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = vocabulary(strict, soft)
        for part in urls:
            yield pd.DataFrame([term_hits(u, found) for u in part], columns=["strict", "soft"]).astype("int32")

    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"))
    rows = rows.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url")), "_hits": hits("_url")})
    rule, action = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("_hits.strict") > 0) | (F.col("_hits.soft") >= soft_hits), "block").otherwise("allow")
    return rows.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(action, own).alias("verdict"),
        F.col("_hits.strict").alias("n_strict"), F.col("_hits.soft").alias("n_soft"),
    )


def _sql() -> str:
    def distinct(terms) -> str:
        one = "CAST(regexp_matches(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z0-9]){0}($|[^a-z0-9])') AS INTEGER)"
        return " + ".join(one.format(t) for t in terms)

    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    fits = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
    rule = " ".join(f"WHEN {fits.format(h, p)} THEN '{h + p}'" for _, h, p in ordered)
    action = " ".join(f"WHEN {fits.format(h, p)} THEN '{a}'" for a, h, p in ordered)
    return f"""
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    CAST({distinct(STRICT)} AS INTEGER) AS n_strict, CAST({distinct([t for t in SOFT if t not in STRICT])} AS INTEGER) AS n_soft
  FROM pages
)
SELECT page_id, host, path, CASE {rule} END AS rule,
  coalesce(CASE {action} END, CASE WHEN n_strict > 0 OR n_soft >= {SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft
FROM parts
"""


SQL = _sql()
