"""Prompt, answer and chat-record text as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import LABELS, trend_name, yes_no

# Texts of the stored chat format.
SYSTEM_PROMPT = """Tu es un analyste spécialisé dans le trading crypto.

Tu analyses uniquement les informations de marché fournies.
Tu ne dois jamais inventer une donnée absente.

Tu privilégies :
- la structure de marché,
- le contexte multi-timeframe,
- le momentum,
- la volatilité,
- le volume,
- la gestion du risque,
- et NO_TRADE lorsqu'aucun avantage clair n'existe.

Tu produis une analyse conditionnelle.
Tu ne passes jamais d'ordre."""
MARKER = "\nAnalyse cette situation."
TASK = "Analyse cette situation.\n\nRéponds avec exactement les sections :\n\nBIAS\nCONTEXT\nDECISION\nRISK"
DECISION_TASK = (
    "\n\nChoisis la décision correspondant le mieux à cette situation.\n\nRéponds uniquement avec :\n\n"
    "DECISION: NO_TRADE\n\nou\n\nDECISION: LONG_BIAS\n\nou\n\nDECISION: SHORT_BIAS"
)
LABEL_TASK = (
    "\n\nPour ce benchmark, classe uniquement cette situation.\n\nRéponds avec EXACTEMENT un seul des trois labels suivants "
    "et rien d'autre :\n\nNO_TRADE\nLONG_BIAS\nSHORT_BIAS"
)
SENTENCES = {
    "rsi_high": "Le RSI indique une extension haussière importante.",
    "rsi_low": "Le RSI indique une extension baissière importante.",
    "rsi_up": "Le momentum RSI reste positif.",
    "rsi_down": "Le momentum RSI reste négatif.",
    "rsi_flat": "Le RSI reste relativement neutre.",
    "vol_high": "Le volume est nettement supérieur à sa moyenne récente.",
    "vol_low": "Le volume est inférieur à sa moyenne récente.",
    "vol_mid": "Le volume reste proche de sa moyenne récente.",
    "breakout": "Le prix clôture au-dessus du plus haut précédent des dernières 24 heures.",
    "breakdown": "Le prix clôture sous le plus bas précédent des dernières 24 heures.",
    "atr_high": "La volatilité mesurée par l'ATR est élevée.",
    "atr_low": "La volatilité mesurée par l'ATR est faible.",
}
ANSWERS = {
    "LONG_BIAS": (
        "LONG_BIAS\nLe contexte autorise la recherche d'un scénario long, mais uniquement après confirmation.",
        "Référence de risque : stop maximal autour de 1 ATR et objectif minimal autour de 1.5 ATR. "
        "Ne pas poursuivre le prix si l'entrée devient trop étendue.",
    ),
    "SHORT_BIAS": (
        "SHORT_BIAS\nLe contexte autorise la recherche d'un scénario short, mais uniquement après confirmation.",
        "Référence de risque : stop maximal autour de 1 ATR et objectif minimal autour de 1.5 ATR. "
        "Ne pas poursuivre le prix après une extension importante.",
    ),
    "NO_TRADE": (
        "NO_TRADE\nAucun avantage directionnel suffisamment clair n'est validé dans ce contexte.",
        "Préserver le capital et attendre une configuration offrant un meilleur rapport entre confirmation, invalidation "
        "et rendement potentiel.",
    ),
}
# Fixed layout: one prompt section per tuple; (caption, column, kind, digits, suffix).
PROMPT = [
    ("PRICE", [("Close", "close", "num", 2, "")]),
    ("TREND", [("1H", "trend_1h", "trend", 0, ""), ("4H", "4h_trend", "trend", 0, ""), ("1D", "1d_trend", "trend", 0, "")]),
    ("MOVING AVERAGES", [
        ("EMA20", "ema20", "num", 2, ""), ("EMA50", "ema50", "num", 2, ""), ("EMA200", "ema200", "num", 2, ""),
        ("Distance EMA20", "distance_ema20_pct", "num", 3, "%"), ("Distance EMA50", "distance_ema50_pct", "num", 3, "%"),
        ("Distance EMA200", "distance_ema200_pct", "num", 3, "%"),
    ]),
    ("MOMENTUM", [("RSI14", "rsi14", "num", 2, "")]),
    ("VOLATILITY", [
        ("ATR14", "atr14_pct", "num", 3, "%"), ("Volatility 24H", "volatility_24h", "num", 5, ""),
        ("Volatility 72H", "volatility_72h", "num", 5, ""),
    ]),
    ("VOLUME", [("Volume ratio / SMA20", "volume_ratio", "num", 3, "")]),
    ("PRICE STRUCTURE", [
        ("Previous 24H high", "prev_high_24h", "num", 2, ""), ("Previous 24H low", "prev_low_24h", "num", 2, ""),
        ("Distance 24H high", "distance_high_24h_pct", "num", 3, "%"), ("Distance 24H low", "distance_low_24h_pct", "num", 3, "%"),
        ("24H breakout", "breakout_24h", "flag", 0, ""), ("24H breakdown", "breakdown_24h", "flag", 0, ""),
    ]),
    ("RETURNS", [(f"{n}H", f"return_{n}h", "pct", 3, "%") for n in (1, 3, 6, 24)]),
]


def number_text(x: Column, digits: int) -> Column:
    """Rounded number without trailing zeros but with one decimal; 'None' for null."""
    fixed = F.round(x, digits).cast(f"decimal(30,{digits})").cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", ".0")
    return F.coalesce(trimmed, F.lit("None"))


def _shown(col: str, kind: str, digits: int) -> Column:
    x = F.col(col)
    if kind == "trend":
        return trend_name(x)
    if kind == "flag":
        return yes_no(x)
    return number_text(x * 100 if kind == "pct" else x, digits)


def user_prompt(symbol: Column, timeframe: str = "1H") -> Column:
    parts = [F.concat(symbol, F.lit(f" | {timeframe}"))]
    for title, lines in PROMPT:
        shown = [F.concat(F.lit(f"{c}: "), _shown(col, kind, dg), F.lit(sfx)) for c, col, kind, dg, sfx in lines]
        parts.append(F.concat_ws("\n", F.lit(title), *shown))
    return F.concat_ws("\n\n", *parts, F.lit(TASK))


def context_comments() -> Column:
    """Rule sentences of a row, in fixed order."""
    t1, t4, td = (trend_name(F.col(c)) for c in ("trend_1h", "4h_trend", "1d_trend"))
    s = {k: F.lit(v) for k, v in SENTENCES.items()}
    same = F.concat(F.lit("Les tendances 1H, 4H et 1D sont alignées "), F.lower(t1), F.lit("."))
    mixed = F.concat(F.lit("Le contexte multi-timeframe est mixte : 1H="), t1, F.lit(", 4H="), t4, F.lit(", 1D="), td, F.lit("."))
    rsi, vol, atr = F.col("rsi14"), F.col("volume_ratio"), F.col("atr14_pct")
    return F.array_compact(
        F.array(
            F.when((t1 == t4) & (t4 == td), same).otherwise(mixed),
            F.when(rsi >= 70, s["rsi_high"]).when(rsi <= 30, s["rsi_low"]).when(rsi >= 55, s["rsi_up"]).when(rsi <= 45, s["rsi_down"])
            .otherwise(s["rsi_flat"]),
            F.when(vol >= 1.5, s["vol_high"]).when(vol <= 0.7, s["vol_low"]).otherwise(s["vol_mid"]),
            F.when(F.col("breakout_24h") == 1, s["breakout"]).when(F.col("breakdown_24h") == 1, s["breakdown"]),
            F.when(atr >= 1.5, s["atr_high"]).when(atr <= 0.5, s["atr_low"]),
        )
    )


def assistant_answer(score: Column, decision: Column) -> Column:
    bias = F.when(score >= 2, "HAUSSIER").when(score <= -2, "BAISSIER").otherwise("NEUTRE")
    bullets = F.array_join(F.transform(context_comments(), lambda c: F.concat(F.lit("- "), c)), "\n")
    text, risk = F.lit(ANSWERS["NO_TRADE"][0]), F.lit(ANSWERS["NO_TRADE"][1])
    for label in ("LONG_BIAS", "SHORT_BIAS"):
        text = F.when(decision == label, ANSWERS[label][0]).otherwise(text)
        risk = F.when(decision == label, ANSWERS[label][1]).otherwise(risk)
    part = lambda title, body: F.concat(F.lit(f"{title}\n"), body)
    return F.concat_ws("\n\n", part("BIAS", bias), part("CONTEXT", bullets), part("DECISION", text), part("RISK", risk))


def chat_record(system: Column, user: Column, assistant: Column) -> Column:
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", system), turn("user", user), turn("assistant", assistant))


def without_answer(messages: Column) -> Column:
    return F.filter(messages, lambda m: m["role"] != "assistant")


def first_content(messages: Column, role: str) -> Column:
    return F.get(F.filter(messages, lambda m: m["role"] == role), 0)["content"]


def rewritten_prompt(user: Column, task: str = DECISION_TASK) -> Column:
    """Text before the marker, trimmed, with another instruction appended."""
    cut = F.when(user.contains(MARKER), F.regexp_replace(F.substring_index(user, MARKER, 1), r"\s+$", "")).otherwise(user)
    return F.concat(cut, F.lit(task))


def parse_decision(text: Column, labels: Sequence[str] = LABELS) -> Column:
    """Stated decision, else the only label mentioned, else INVALID."""
    stated = F.upper(F.regexp_extract(text, r"(?i)DECISION\s*:\s*(" + "|".join(labels) + ")", 1))
    found = F.filter(F.array(*[F.lit(x) for x in labels]), lambda x: F.contains(F.upper(text), x))
    return F.when(stated != "", stated).when(F.size(found) == 1, F.get(found, 0)).otherwise("INVALID")


def conversations_to_chat(df: DataFrame, *, id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One nested record per conversation (the record is the output format)."""
    turns = F.array_sort(F.collect_list(F.struct(F.col(turn), F.col("role"), F.col("text").alias("content"))))
    return df.groupBy(id).agg(F.transform(turns, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
