"""Price structure: fractal pivots, breaks, zigzags, stop references."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.asof import Right, asof_join
from ..plans.blocks import SCAN_BLOCK, BlockFrame, epoch_us, shift_time, with_position
from ..plans.turns import folded_turns
from ..session import materialise
from .bars import HOUR, resample_ohlcv
from .indicators import flag, snapshots, true_range

SIDES = ("high", "low")
# Fixed names: class of a new pivot against the one before (above, below, equal).
CLASSES = {"high": ("HH", "LH", "EH"), "low": ("HL", "LL", "EL")}


def _class(side: str, now: Column, before: Column) -> Column:
    above, below, equal = CLASSES[side]
    return F.when(before.isNull(), "FIRST").when(now > before, above).when(now < before, below).otherwise(equal)


def fractal_pivots(
    bars: DataFrame,
    *,
    series: Sequence[str],
    left: int = 2,
    right: int = 2,
    at: str = "timestamp",
    known: str = "known_at",
    size: int = SCAN_BLOCK,
) -> DataFrame:
    """Last confirmed swing high and low at every bar.

    Also leaves ``_now_*`` / ``_was_*`` (the last pivot including / before this
    bar) and ``_prev_close`` for the break rules.

    A pivot is the only extreme of ``left + 1 + right`` bars and appears at the
    bar ``right`` later, when it is known.  ``series`` are the columns state
    never crosses (keys, plus ``seg`` to restart at gaps); needs ``pos``.
    """
    bf = BlockFrame(bars, series, before=left + right, size=size)
    p = F.col(bf.pos)
    news = {}
    for side, pick in (("high", F.max), ("low", F.min)):
        x = bf.lag(side, right)
        older = pick(side).over(bf.frame(-(left + right), -(right + 1)))
        newer = pick(side).over(bf.frame(-(right - 1), 0))
        strict = (x > older) & (x > newer) if side == "high" else (x < older) & (x < newer)
        news[f"_new_{side}"] = F.when(
            (p >= left + right) & strict,
            F.struct(
                x.alias("price"), bf.lag(at, right).alias("at"), F.col(known).alias("known"), p.alias("pos"),
                F.col("close").alias("close"),
            ),
        )
    news["_prev_close"] = bf.lag("close")
    rows = bf.with_columns(news).own()
    specs = {f"_now_{s}": ("last2", F.col(f"_new_{s}"), True) for s in SIDES}
    specs |= {f"_was_{s}": ("last", F.col(f"_new_{s}"), False) for s in SIDES}
    rows = BlockFrame(rows, series, size=size).scan(specs)
    out = {}
    for s in SIDES:
        now, prior = F.col(f"_now_{s}.now"), F.col(f"_now_{s}.prior")
        out |= {
            f"swing_{s}_price": now["price"],
            f"swing_{s}_at": now["at"],
            f"swing_{s}_confirmed_at": now["known"],
            f"{s}_structure": F.when(now.isNull(), "NONE").otherwise(_class(s, now["price"], prior["price"])),
            f"pivot_{s}_confirmed": F.col(f"_new_{s}").isNotNull(),
            f"{s}_distance_pct": now["price"] / F.col("close") - 1,
            f"_now_{s}": now,
        }
    return rows.withColumns(out).drop(*[f"_new_{s}" for s in SIDES])


def _fired(cond: Column, since: Column, last: Column) -> Column:
    """First true row since ``since``."""
    return cond & (last.isNull() | (last < since))


def breaks_beyond(
    bars: DataFrame, *, series: Sequence[str], left: int = 2, right: int = 2, at: str = "timestamp",
    known: str = "known_at", size: int = SCAN_BLOCK,
) -> DataFrame:
    """Break = first close beyond the last confirmed pivot, once per pivot.

    A pivot confirmed on a bar is tested on that same bar.  A break against
    the running regime is a change of character.
    """
    rows = fractal_pivots(bars, series=series, left=left, right=right, at=at, known=known, size=size)
    close, p = F.col("close"), F.col("pos")
    up, down = flag(close > F.col("_now_high.price")), flag(close < F.col("_now_low.price"))
    rows = rows.withColumns({"_up": up, "_down": down})
    rows = BlockFrame(rows, series, size=size).scan(
        {f"_last{d}": ("last", F.when(F.col(d), p), False) for d in ("_up", "_down")}
    )
    rows = rows.withColumns(
        {
            "bos_up": _fired(F.col("_up"), F.col("_now_high.pos"), F.col("_last_up")),
            "bos_down": _fired(F.col("_down"), F.col("_now_low.pos"), F.col("_last_down")),
        }
    )
    direction = F.when(F.col("bos_down"), -1).when(F.col("bos_up"), 1)
    rows = BlockFrame(rows, series, size=size).scan(
        {"_regime": ("last", direction, True), "_regime_was": ("last", direction, False)}
    )
    was = F.coalesce("_regime_was", F.lit(0))
    rows = rows.withColumns(
        {
            "choch_up": F.col("bos_up") & (was < 0),
            "choch_down": F.col("bos_down") & (was > 0),
            "structure_regime": F.coalesce("_regime", F.lit(0)),
            "last_swing_high": F.col("swing_high_price"),
            "last_swing_low": F.col("swing_low_price"),
        }
    )
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


BREAK_FIELDS = [
    "event_type", "event_direction", "broken_level", "level_pivot_at", "level_confirmed_at", "break_at",
    "trend_direction", "active_high", "active_low", "break_distance_pct", "event_fired",
]


def breaks_crossing(
    bars: DataFrame, *, series: Sequence[str], left: int = 2, right: int = 2, known: str = "known_at",
    size: int = SCAN_BLOCK,
) -> DataFrame:
    """Break = close crossing a level that was confirmed on an earlier bar.

    A level already violated at its confirmation is never armed; each level
    fires once.  Needs the previous close on the other side.
    """
    rows = fractal_pivots(bars, series=series, left=left, right=right, known=known, size=size)
    close, p = F.col("close"), F.col("pos")
    prev = F.col("_prev_close")
    h, l = F.col("_was_high"), F.col("_was_low")
    rows = rows.withColumns(
        {
            "_up": flag((h["close"] < h["price"]) & (prev <= h["price"]) & (close > h["price"])),
            "_down": flag((l["close"] > l["price"]) & (prev >= l["price"]) & (close < l["price"])),
        }
    )
    rows = BlockFrame(rows, series, size=size).scan(
        {f"_last{d}": ("last", F.when(F.col(d), p), False) for d in ("_up", "_down")}
    )

    def first_since(d: str, s: str) -> Column:
        last, since = F.col(f"_last{d}"), F.col(f"_was_{s}.pos")
        return F.col(d) & (last.isNull() | (last <= since))

    rows = rows.withColumns({"_bull": first_since("_up", "high"), "_bear": first_since("_down", "low")})
    both = F.raise_error(F.lit("bullish and bearish break on one bar"))
    direction = F.when(F.col("_bull") & F.col("_bear"), both.cast("int")).when(F.col("_bull"), 1).when(F.col("_bear"), -1)
    rows = rows.withColumns({"_dir": direction}).withColumns(
        {
            "_hit_high": F.when(F.col("_bull"), p),
            "_hit_low": F.when(F.col("_bear"), p),
        }
    )
    rows = BlockFrame(rows, series, size=size).scan(
        {
            "_trend": ("last", F.col("_dir"), True),
            "_trend_was": ("last", F.col("_dir"), False),
            "_used_high": ("last", F.col("_hit_high"), True),
            "_used_low": ("last", F.col("_hit_low"), True),
        }
    )
    fired = F.col("_dir").isNotNull()
    level = F.when(F.col("_dir") == 1, F.col("_was_high")).when(F.col("_dir") == -1, F.col("_was_low"))
    side = F.when(F.col("_dir") == 1, "BULLISH_").otherwise("BEARISH_")
    kind = F.when(F.coalesce("_trend_was", F.lit(0)) == -F.col("_dir"), "CHOCH").otherwise("BOS")
    out = {
        "event_type": F.when(fired, F.concat(side, kind)).otherwise("NONE"),
        "event_direction": F.coalesce("_dir", F.lit(0)),
        "broken_level": level["price"],
        "level_pivot_at": level["at"],
        "level_confirmed_at": level["known"],
        "break_at": F.when(fired, F.col(known)),
        "trend_direction": F.coalesce("_trend", F.lit(0)),
        "break_distance_pct": close / level["price"] - 1,
        "event_fired": fired,
    }
    for s in SIDES:
        now = F.col(f"_now_{s}")
        armed = now["close"] < now["price"] if s == "high" else now["close"] > now["price"]
        used = F.coalesce(F.col(f"_used_{s}") > now["pos"], F.lit(False))
        out[f"active_{s}"] = F.when(flag(armed) & ~used, now["price"])
    rows = rows.withColumns(out)
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


ZIGZAG_PCT_SCHEMA = "confirmation_at timestamp_ntz, pivot_at timestamp_ntz, kind string, label string, price double"


def _label(kind: str, price: float, before: float | None) -> str:
    if before is None:
        return "FIRST"
    above, below, equal = CLASSES["high" if kind == "HIGH" else "low"]
    return above if price > before else below if price < before else equal


def zigzag_pct_step(pdf: pd.DataFrame, state: dict | None, f: float, at: str) -> tuple[pd.DataFrame, dict]:
    """One pass of the percentage zigzag over bars sorted by time.

    The running extreme takes in the current bar before the reversal is
    tested, and must be older than the bar.
    """
    st = dict(state) if state else {"mode": None, "high": None, "low": None}
    events = []
    stamps = pdf[at].astype("datetime64[us]").astype("int64").tolist()
    for t, h, l, c in zip(stamps, pdf["high"].tolist(), pdf["low"].tolist(), pdf["close"].tolist()):
        mode = st["mode"]
        if mode is None:
            st |= {"mode": "SEEK", "hi": h, "lo": l, "hi_at": t, "lo_at": t}
            continue
        if mode == "SEEK":
            rose, fell = c >= st["lo"] * (1 + f), c <= st["hi"] * (1 - f)
            if rose != fell:
                st |= {"mode": "UP", "hi": h, "hi_at": t} if rose else {"mode": "DOWN", "lo": l, "lo_at": t}
                continue
        if mode in ("SEEK", "UP") and h > st["hi"]:
            st |= {"hi": h, "hi_at": t}
        if mode in ("SEEK", "DOWN") and l < st["lo"]:
            st |= {"lo": l, "lo_at": t}
        if mode == "UP" and c <= st["hi"] * (1 - f) and st["hi_at"] < t:
            events.append((t, st["hi_at"], "HIGH", _label("HIGH", st["hi"], st["high"]), st["hi"]))
            st |= {"high": st["hi"], "mode": "DOWN", "lo": l, "lo_at": t}
        elif mode == "DOWN" and c >= st["lo"] * (1 + f) and st["lo_at"] < t:
            events.append((t, st["lo_at"], "LOW", _label("LOW", st["lo"], st["low"]), st["lo"]))
            st |= {"low": st["lo"], "mode": "UP", "hi": h, "hi_at": t}
    out = pd.DataFrame(events, columns=["confirmation_at", "pivot_at", "kind", "label", "price"])
    for c in ("confirmation_at", "pivot_at"):
        out[c] = pd.to_datetime(out[c], unit="us")
    return out, st


def zigzag_pct(
    bars: DataFrame, *, series: Sequence[str], pct: float = 1.0, at: str = "timestamp", size: int = SCAN_BLOCK
) -> DataFrame:
    """Zigzag events by a fixed percentage reversal of the close.

    ``at`` is the bar's end stamp; ``series`` the columns state never crosses.
    """
    if not 0 < pct < 100:
        raise ValueError("pct must be between 0 and 100")
    f, names = pct / 100.0, list(series)
    types = dict(bars.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in names) + ", " + ZIGZAG_PCT_SCHEMA

    def step(pdf: pd.DataFrame, state: dict | None) -> tuple[pd.DataFrame, dict]:
        out, end = zigzag_pct_step(pdf, state, f, at)
        for i, c in enumerate(names):
            out.insert(i, c, pdf[c].iloc[0])
        return out, end

    def searching(top: tuple | None, bottom: tuple | None) -> dict | None:
        return top and {"mode": "SEEK", "hi": top[1], "hi_at": top[0], "lo": bottom[1], "lo_at": bottom[0], "high": None, "low": None}

    def following(side: int, mark: int, price: float, ref: float | None) -> dict:
        of = {"mode": "UP", "hi": price, "hi_at": mark} if side > 0 else {"mode": "DOWN", "lo": price, "lo_at": mark}
        return of | {"high": None, "low": None}

    events, several = folded_turns(
        bars.select(*names, "pos", at, "high", "low", "close"), keys=names, pos="pos", mark=epoch_us(F.col(at)),
        thresholds=(F.col("high") * (1 - f), F.col("low") * (1 + f)), ref=None, turn_first=False, search_own=False,
        searching=searching, following=following, step=step, schema=schema, size=size,
    )
    if not several:
        return events.drop("_chunk")
    # the first event of its kind in a chunk is classed against the last one of the chunks before
    events = materialise(events, "zigzag")
    ends = events.groupBy(*names, "_chunk", "kind").agg(F.max_by("price", "confirmation_at").alias("_last"))
    order = Window.partitionBy(*names, "kind").orderBy("_chunk")
    ends = ends.select(*names, "_chunk", "kind", F.lag("_last").over(order).alias("_before"))
    named = F.lit(None)
    for kind, side in (("HIGH", "high"), ("LOW", "low")):
        named = F.when(F.col("kind") == kind, _class(side, F.col("price"), F.col("_before"))).otherwise(named)
    first = (F.col("label") == "FIRST") & F.col("_before").isNotNull()
    out = events.join(ends, [*names, "_chunk", "kind"]).withColumn("label", F.when(first, named).otherwise(F.col("label")))
    return out.select(*names, *[c.split()[0] for c in ZIGZAG_PCT_SCHEMA.split(", ")])


ZIGZAG_ATR_FIELDS = [
    "zz_event", "zz_confirmed", "zz_pivot_at", "zz_confirmed_at", "zz_pivot_price", "zz_reversal_atr",
    "zz_reversal_pct", "zz_last_high", "zz_last_low", "zz_direction", "zz_age_bars",
]
ZIGZAG_ATR_SCHEMA = (
    "pos long, zz_event string, zz_pivot_pos long, zz_pivot_price double, zz_reversal_atr double, "
    "zz_reversal_pct double, zz_last_high double, zz_last_low double, zz_direction string, zz_age_bars long"
)


def zigzag_step(pdf: pd.DataFrame, state: dict | None, k: float) -> tuple[pd.DataFrame, dict]:
    """One pass of the ATR zigzag over bars sorted by ``pos`` (column ``atr``).

    An extreme keeps the ATR of its own bar; the reversal is tested on the
    close before the current bar may move the extreme.
    """
    st = dict(state) if state else {"mode": "SEEK", "up": None, "dn": None, "last_high": None, "last_low": None, "at": None}
    rows = []
    cols = (pdf[c].tolist() for c in ("pos", "high", "low", "close", "atr"))
    for i, h, l, c, a in zip(*cols):
        event = (None, None, None, None)
        kind = "NONE"
        if a is not None and a == a and a > 0:
            top, bottom = [h, i, a], [l, i, a]
            if st["mode"] == "SEEK":
                if st["up"] is None or h > st["up"][0]:
                    st["up"] = top
                if st["dn"] is None or l < st["dn"][0]:
                    st["dn"] = bottom
                if c >= st["dn"][0] + k * st["dn"][2]:
                    st |= {"mode": "UP", "up": top}
                elif c <= st["up"][0] - k * st["up"][2]:
                    st |= {"mode": "DOWN", "dn": bottom}
            else:
                rising = st["mode"] == "UP"
                side = "up" if rising else "dn"
                price, where, frozen = st[side]
                turn = (price - c) if rising else (c - price)
                reversed_ = c <= price - k * frozen if rising else c >= price + k * frozen
                if i > where and reversed_:
                    kind = "HIGH" if rising else "LOW"
                    event = (where, price, turn / frozen, turn / price)
                    st["last_high" if rising else "last_low"] = price
                    st |= {"mode": "DOWN", "dn": bottom} if rising else {"mode": "UP", "up": top}
                    st["at"] = i
                elif (rising and h > price) or (not rising and l < price):
                    st[side] = top if rising else bottom
        age = None if st["at"] is None else i - st["at"]
        rows.append((i, kind, *event, st["last_high"], st["last_low"], st["mode"], age))
    names = [c.split()[0] for c in ZIGZAG_ATR_SCHEMA.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    for c in ("zz_pivot_pos", "zz_age_bars"):
        out[c] = out[c].astype("Int64")
    for c in ("zz_pivot_price", "zz_reversal_atr", "zz_reversal_pct", "zz_last_high", "zz_last_low"):
        out[c] = out[c].astype(float)
    return out, st


def zigzag_atr(
    bars: DataFrame,
    step: int,
    *,
    keys: Sequence[str] = ("symbol",),
    atr_period: int = 14,
    reversal_atr: float = 2.0,
    size: int = SCAN_BLOCK,
) -> DataFrame:
    """One row per bar: zigzag state by k times the ATR frozen at the extreme.

    State restarts at every gap.  Bar positions inside a run stand for time,
    so pivot times are computed from them without a join.
    """
    seg = [*keys, "seg"]
    placed = with_position(bars, keys=keys, ts="timestamp", step=step, reset=True)
    bf = BlockFrame(placed, seg, before=atr_period + 1)
    bf.with_columns({"_tr": true_range(bf.lag("close"))})
    bf.with_columns({"atr": bf.rolling(F.avg("_tr"), atr_period, first=1)})
    rows = bf.own().select(*seg, "pos", "high", "low", "close", "atr")
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in seg) + ", " + ZIGZAG_ATR_SCHEMA

    def run(pdf: pd.DataFrame, state: dict | None) -> tuple[pd.DataFrame, dict]:
        out, end = zigzag_step(pdf, state, reversal_atr)
        for i, c in enumerate(seg):
            out.insert(i, c, pdf[c].iloc[0])
        return out, end

    def searching(top: tuple | None, bottom: tuple | None) -> dict | None:
        found = {"up": top and [top[1], top[0], top[2]], "dn": bottom and [bottom[1], bottom[0], bottom[2]]}
        return {"mode": "SEEK", **found, "last_high": None, "last_low": None, "at": None}

    def following(side: int, mark: int, price: float, ref: float) -> dict:
        own = {"mode": "UP", "up": [price, mark, ref], "dn": None} if side > 0 else {"mode": "DOWN", "dn": [price, mark, ref], "up": None}
        return own | {"last_high": None, "last_low": None, "at": None}

    sound = lambda c: F.when((F.col("atr") > 0) & ~F.isnan("atr"), c)
    out, several = folded_turns(
        rows, keys=seg, pos="pos", mark=F.col("pos"), ref=F.col("atr"), turn_first=True, search_own=True,
        thresholds=(sound(F.col("high") - F.lit(reversal_atr) * F.col("atr")), sound(F.col("low") + F.lit(reversal_atr) * F.col("atr"))),
        searching=searching, following=following, step=run, schema=schema, size=size,
    )
    if several:
        # what was confirmed in the chunks before
        out = materialise(out, "zigzag")
        carried = ("zz_last_high", "zz_last_low", "_at")
        ends = out.withColumn("_at", F.col("pos") - F.col("zz_age_bars")).groupBy(*seg, "_chunk").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(f"_{c}") for c in carried])
        past = Window.partitionBy(*seg).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*seg, "_chunk", *[F.last(f"_{c}", ignorenulls=True).over(past).alias(f"_{c}") for c in carried])
        out = out.join(ends, [*seg, "_chunk"])
        out = out.withColumns({c: F.coalesce(c, f"_{c}") for c in carried[:2]} | {"zz_age_bars": F.coalesce("zz_age_bars", F.col("pos") - F.col("__at"))})
        out = out.drop(*[f"_{c}" for c in carried])
    out = out.drop("_chunk")
    close_of = lambda p: F.timestamp_micros(
        epoch_us(F.col("seg")) + p * step * 1_000_000
    ).cast("timestamp_ntz")
    hit = F.col("zz_event") != "NONE"
    out = out.withColumns(
        {
            "timestamp": close_of(F.col("pos")),
            "known_at": close_of(F.col("pos") + 1),
            "zz_confirmed": hit,
            "zz_pivot_at": close_of(F.col("zz_pivot_pos")),
            "zz_confirmed_at": F.when(hit, close_of(F.col("pos") + 1)),
        }
    )
    return out.drop("zz_pivot_pos")


SWING_FIELDS = [
    f"{p}{s}{q}"
    for s in SIDES
    for p, q in (
        ("swing_", "_price"), ("swing_", "_at"), ("swing_", "_confirmed_at"), ("", "_structure"),
        ("pivot_", "_confirmed"), ("", "_distance_pct"),
    )
]


def _runs(bars: DataFrame, step: int, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return with_position(bars, keys=keys, ts="timestamp", step=step, reset=True), [*keys, "seg"]


def swing_snapshots(bars: DataFrame, timeframes: dict[str, int], *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    def build(b: DataFrame, step: int) -> DataFrame:
        placed, seg = _runs(b, step, keys)
        return fractal_pivots(placed, series=seg)

    hide = {f"pivot_{s}_confirmed": False for s in SIDES}
    return snapshots(bars, build, SWING_FIELDS, timeframes=timeframes, keys=keys, impulses=hide)


def break_snapshots(bars: DataFrame, timeframes: dict[str, int], *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    def build(b: DataFrame, step: int) -> DataFrame:
        placed, seg = _runs(b, step, keys)
        return breaks_crossing(placed, series=seg)

    hide = {"event_fired": False, "event_type": "NONE", "event_direction": 0}
    hide |= {c: None for c in ("broken_level", "level_pivot_at", "level_confirmed_at", "break_at", "break_distance_pct")}
    return snapshots(bars, build, BREAK_FIELDS, timeframes=timeframes, keys=keys, impulses=hide)


def zigzag_snapshots(bars: DataFrame, timeframes: dict[str, int], *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    hide = {"zz_confirmed": False, "zz_event": "NONE"}
    hide |= {c: None for c in ("zz_pivot_at", "zz_confirmed_at", "zz_pivot_price", "zz_reversal_atr", "zz_reversal_pct")}
    out = snapshots(
        bars, lambda b, s: zigzag_atr(b, s, keys=keys), ZIGZAG_ATR_FIELDS,
        timeframes=timeframes, keys=keys, impulses=hide, context=(),
    )
    return out.withColumns({f"zz_event_{tf}": F.coalesce(f"zz_event_{tf}", F.lit("NONE")) for tf in timeframes})


STRUCTURE_EVENTS = ["pivot_high_confirmed", "pivot_low_confirmed", "bos_up", "bos_down", "choch_up", "choch_down"]
STRUCTURE_STATE = ["last_swing_high", "last_swing_low", "swing_high_at", "swing_low_at", "high_structure", "low_structure"]


def end_stamped(bars: DataFrame, step: int, *, base: int = HOUR, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars stamped at their end; the base timeframe is only re-stamped."""
    if step == base:
        out = bars.select(*keys, shift_time(F.col("timestamp"), step).alias("timestamp"), "open", "high", "low", "close")
    else:
        out = resample_ohlcv(bars, step, base=base, keys=keys, label="right").drop("volume", "bar_count")
    return out.withColumn("known_at", F.col("timestamp"))


def structure_table(bars: DataFrame, timeframes: dict[str, int], *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Base bars with every timeframe's structure as of their close.

    States persist, events show only on the bar that confirmed them.
    """
    out = bars.select(*keys, "timestamp", "close", shift_time(F.col("timestamp"), HOUR).alias("known_at"))
    cols = [*STRUCTURE_STATE, *STRUCTURE_EVENTS, "structure_regime"]
    rights = []
    for tf, step in timeframes.items():
        placed = with_position(end_stamped(bars, step, keys=keys), keys=keys, ts="timestamp", step=step, reset=False)
        made = breaks_beyond(placed, series=list(keys))
        src = made.select(*keys, F.col("known_at").alias(f"{tf}_available_at"), *[F.col(c).alias(f"{tf}_{c}") for c in cols])
        rights.append(Right(src, f"{tf}_available_at"))
    out = asof_join(out, *rights, left_on="known_at", keys=keys)
    for tf in timeframes:
        fresh = F.col(f"{tf}_available_at") == F.col("known_at")
        out = out.withColumns(
            {f"{tf}_{e}": F.coalesce(F.col(f"{tf}_{e}") & fresh, F.lit(False)) for e in STRUCTURE_EVENTS}
            | {
                f"{tf}_dist_swing_{s}_pct": (F.col("close") / F.col(f"{tf}_last_swing_{s}") - 1) * 100 for s in SIDES
            }
        )
    return out


def structure_events(table: DataFrame, tf: str, *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Wide event flags of one timeframe as event rows."""
    c = lambda x: F.col(f"{tf}_{x}")
    ts, dbl = F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("double")
    kinds = [
        ("pivot_high_confirmed", "high", c("high_structure"), c("swing_high_at"), c("last_swing_high")),
        ("pivot_low_confirmed", "low", c("low_structure"), c("swing_low_at"), c("last_swing_low")),
        ("bos_up", "break_up", F.lit("BOS↑"), ts, dbl),
        ("bos_down", "break_down", F.lit("BOS↓"), ts, dbl),
        ("choch_up", "change_up", F.lit("CHoCH↑"), ts, dbl),
        ("choch_down", "change_down", F.lit("CHoCH↓"), ts, dbl),
    ]
    items = [
        F.when(
            c(name),
            F.struct(F.lit(kind).alias("kind"), label.alias("label"), at.alias("pivot_at"), price.alias("price")),
        )
        for name, kind, label, at, price in kinds
    ]
    return (
        table.withColumn("_e", F.explode(F.array_compact(F.array(*items))))
        .select(*keys, "timestamp", c("available_at").alias("known_at"), "_e.*")
    )


def confirmed_levels(
    bars: DataFrame, method: str, step: int, *, keys: Sequence[str] = ("symbol",), pct: float = 1.0
) -> DataFrame:
    """Pivot events (confirmed_at, pivot_at, kind, price); pivots restart at gaps.

    Levels already confirmed stay usable across a gap by the later as-of join.
    """
    placed = with_position(end_stamped(bars, step, keys=keys), keys=keys, ts="timestamp", step=step, reset=True)
    seg = [*keys, "seg"]
    if method == "zigzag":
        z = zigzag_pct(placed, series=seg, pct=pct)
        return z.select(*keys, F.col("confirmation_at").alias("confirmed_at"), "pivot_at", "kind", "price")
    piv = fractal_pivots(placed, series=seg)
    items = [
        F.when(
            F.col(f"pivot_{s}_confirmed"),
            F.struct(
                F.col("known_at").alias("confirmed_at"),
                F.col(f"swing_{s}_at").alias("pivot_at"),
                F.lit(s.upper()).alias("kind"),
                F.col(f"swing_{s}_price").alias("price"),
            ),
        )
        for s in SIDES
    ]
    return piv.withColumn("_e", F.explode(F.array_compact(F.array(*items)))).select(*keys, "_e.*")


def stop_references(
    candidates: DataFrame,
    bars: DataFrame,
    levels: DataFrame,
    *,
    method: str,
    timeframe: str,
    keys: Sequence[str] = ("symbol",),
    buffer_bps: float = 5.0,
    min_pct: float = 0.1,
    max_pct: float = 5.0,
) -> DataFrame:
    """Stop of each candidate from the last confirmed pivot on its far side."""
    opens = bars.select(*keys, F.col("timestamp").alias("known_at"), F.col("open").alias("entry_open"))
    out = candidates.join(opens, [*keys, "known_at"], "left")
    rights = []
    for s in SIDES:
        side = levels.filter(F.col("kind") == s.upper()).select(
            *keys,
            F.col("confirmed_at").alias(f"{s}_confirmed_at"),
            F.col("pivot_at").alias(f"{s}_pivot_at"),
            F.col("price").alias(f"{s}_price"),
        )
        rights.append(Right(side, f"{s}_confirmed_at"))
    out = asof_join(out, *rights, left_on="known_at", keys=keys)
    short = F.col("side") == "SHORT"
    pick = lambda c: F.when(short, F.col(f"high_{c}")).otherwise(F.col(f"low_{c}"))
    out = out.withColumns(
        {
            "stop_reference": F.when(short, "HIGH").otherwise("LOW"),
            "stop_pivot_price": pick("price"),
            "stop_confirmed_at": pick("confirmed_at"),
            "stop_pivot_at": pick("pivot_at"),
        }
    )
    delta, e = buffer_bps / 10_000, F.col("entry_open")
    stop = F.col("stop_pivot_price") * F.when(short, 1 + delta).otherwise(1 - delta)
    out = out.withColumn("stop_price", stop)
    gap = F.when(short, F.col("stop_price") - e).otherwise(e - F.col("stop_price"))
    hours = lambda a, b: (epoch_us(F.col(a)) - epoch_us(F.col(b))) / 3.6e9
    out = out.withColumns(
        {
            "distance_pct": gap / e * 100,
            "age_since_confirmation_h": hours("known_at", "stop_confirmed_at"),
            "age_since_formation_h": hours("known_at", "stop_pivot_at"),
            "confirmation_delay_h": hours("stop_confirmed_at", "stop_pivot_at"),
            "method": F.lit(method),
            "timeframe": F.lit(timeframe),
        }
    )
    d = F.col("distance_pct")
    status = (
        F.when(e.isNull() | (e <= 0), "ENTRY_OUTSIDE_SPLIT")
        .when(F.col("stop_confirmed_at").isNull() | F.col("stop_pivot_price").isNull(), "NO_CONFIRMED_PIVOT")
        .when(F.col("stop_confirmed_at") > F.col("known_at"), "FUTURE_CONFIRMATION")
        .when(d <= 0, "STOP_ALREADY_INVALID")
        .when(d < min_pct, "TOO_CLOSE")
        .when(d > max_pct, "TOO_FAR")
        .otherwise("VALID_REFERENCE")
    )
    return out.withColumn("status", status)
