"""Pivots, breaks, zigzags, structure tables, stop references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import observations as O
from ..operators import structure as S
from ..plans.blocks import with_position
from ..plans.quantiles import melt, quantiles
from ..session import stage
from .registry import cte, query
from .tables import HOUR, bars_1h, candidates

FRAMES = {"1h": HOUR, "4h": 4 * HOUR}
METHODS = [("fractal", "1h"), ("fractal", "4h"), ("zigzag", "1h"), ("zigzag", "4h")]

for _n, _src, _h in (("1", "bars", 1), ("4", "bars4", 4)):
    # gap-free runs of open-stamped bars
    cte(
        f"runs{_n}",
        f"""SELECT * EXCLUDE (grp), min(timestamp) OVER (PARTITION BY symbol, grp) AS seg,
        row_number() OVER (PARTITION BY symbol, grp ORDER BY timestamp) - 1 AS spos FROM (
        SELECT *, sum(brk) OVER (PARTITION BY symbol ORDER BY timestamp) AS grp FROM (
        SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp) = INTERVAL {_h} HOUR
        THEN 0 ELSE 1 END AS brk FROM {_src}))""",
    )


def _pivots(src: str, part: str, p: str, at: str) -> str:
    w = f"OVER (PARTITION BY {part} ORDER BY {p} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    s = f"(PARTITION BY {part} ORDER BY {p})"

    # the extreme of the window is precomputed so the lambda can capture it
    return f"""SELECT * EXCLUDE (max_high, min_low, l_high, l_low),
        CASE WHEN {p} >= 4 AND mid_high = max_high AND len(list_filter(l_high, lambda v: v = max_high)) = 1 THEN mid_high END AS ph,
        CASE WHEN {p} >= 4 AND mid_low = min_low AND len(list_filter(l_low, lambda v: v = min_low)) = 1 THEN mid_low END AS pl
        FROM (SELECT *, max(high) {w} AS max_high, min(low) {w} AS min_low, list(high) {w} AS l_high, list(low) {w} AS l_low,
        lag(high, 2) OVER {s} AS mid_high, lag(low, 2) OVER {s} AS mid_low, lag({at}, 2) OVER {s} AS mid_at FROM {src})"""


for _n in ("1", "4"):
    cte(f"piv{_n}", _pivots(f"runs{_n}", "symbol, seg", "spos", "timestamp"))
    cte(
        f"pivlist{_n}",
        f"""SELECT symbol, seg, spos, 'high' AS s, ph AS price, mid_at AS at, known_at AS conf,
        lag(ph) OVER (PARTITION BY symbol, seg ORDER BY spos) AS prior FROM piv{_n} WHERE ph IS NOT NULL
        UNION ALL SELECT symbol, seg, spos, 'low', pl, mid_at, known_at,
        lag(pl) OVER (PARTITION BY symbol, seg ORDER BY spos) FROM piv{_n} WHERE pl IS NOT NULL""",
    )
    _cls = """CASE WHEN {x}.price IS NULL THEN 'NONE' WHEN {x}.prior IS NULL THEN 'FIRST' WHEN {x}.price > {x}.prior THEN '{a}'
        WHEN {x}.price < {x}.prior THEN '{b}' ELSE '{e}' END"""
    cte(
        f"swings{_n}",
        f"""SELECT p.*, h.price AS swing_high_price, h.at AS swing_high_at, h.conf AS swing_high_confirmed_at,
        {_cls.format(x="h", a="HH", b="LH", e="EH")} AS high_structure, ph IS NOT NULL AS pivot_high_confirmed,
        h.price / close - 1 AS high_distance_pct,
        l.price AS swing_low_price, l.at AS swing_low_at, l.conf AS swing_low_confirmed_at,
        {_cls.format(x="l", a="HL", b="LL", e="EL")} AS low_structure, pl IS NOT NULL AS pivot_low_confirmed,
        l.price / close - 1 AS low_distance_pct
        FROM piv{_n} p
        ASOF LEFT JOIN (SELECT * FROM pivlist{_n} WHERE s = 'high') h ON h.symbol = p.symbol AND h.seg = p.seg AND p.spos >= h.spos
        ASOF LEFT JOIN (SELECT * FROM pivlist{_n} WHERE s = 'low') l ON l.symbol = p.symbol AND l.seg = p.seg AND p.spos >= l.spos""",
    )

_SWING = (
    "swing_high_price swing_high_at swing_high_confirmed_at high_structure pivot_high_confirmed high_distance_pct "
    "swing_low_price swing_low_at swing_low_confirmed_at low_structure pivot_low_confirmed low_distance_pct"
).split()
_SWING_D = ["swing_high_price", "high_distance_pct", "swing_low_price", "low_distance_pct"]


def _placed(bars, step):
    return with_position(bars, keys=["symbol"], ts="timestamp", step=step, reset=True)


@query("confirmed_swings_1h", f"SELECT symbol, timestamp, known_at, {', '.join(_SWING)} FROM swings1", " ".join(_SWING_D))
def _(spark, d):
    made = S.fractal_pivots(_placed(bars_1h(spark, d).drop("pos"), HOUR), series=["symbol", "seg"])
    return made.select("symbol", "timestamp", "known_at", *_SWING)


def _snapshot_sql(src: str, cols: list[str], masks: dict[str, str], extra: str = "close") -> str:
    """Hourly decision rows with the 4h row of ``src`` as of the close (4h tolerance)."""
    one = ", ".join(f"a.{c} AS {c}_1h" for c in cols)
    four = ", ".join(masks.get(c, "CASE WHEN m THEN {c} END").format(c=f"b_{c}") + f" AS {c}_4h" for c in cols)
    keep = ", ".join(f"b.{c} AS b_{c}" for c in cols)
    extra_sql = f"close_1h, CASE WHEN m THEN b_close END AS close_4h, " if extra else ""
    return f"""SELECT symbol, bar_open_1h, decision_at, decision_at AS known_at_1h, CASE WHEN m THEN b_known END AS known_at_4h,
      {extra_sql}{", ".join(f"{c}_1h" for c in cols)}, {four} FROM (
      SELECT a.symbol, a.timestamp AS bar_open_1h, a.known_at AS decision_at, a.close AS close_1h, {one},
      b.known_at AS b_known, b.close AS b_close, {keep},
      b.known_at IS NOT NULL AND a.known_at - b.known_at <= INTERVAL 4 HOUR AS m,
      coalesce(b.known_at = a.known_at, false) AS fresh
      FROM {src}1 a ASOF LEFT JOIN {src}4 b ON a.symbol = b.symbol AND a.known_at >= b.known_at)"""


_swing_mask = {c: "coalesce(m AND fresh AND {c}, false)" for c in ("pivot_high_confirmed", "pivot_low_confirmed")}


@query(
    "swing_snapshots",
    _snapshot_sql("swings", _SWING, _swing_mask),
    " ".join(f"{c}_{t}" for c in [*_SWING_D, "close"] for t in FRAMES),
)
def _(spark, d):
    return S.swing_snapshots(bars_1h(spark, d).drop("pos"), FRAMES)


def _machine(src: str, name: str) -> str:
    """Row-by-row statement of the crossing-break rules."""
    start = f"""SELECT symbol, seg, spos, close AS prev_close,
      ph AS hp, CASE WHEN ph IS NOT NULL THEN mid_at END AS hat, CASE WHEN ph IS NOT NULL THEN known_at END AS hconf, coalesce(close >= ph, true) AS hused,
      pl AS lp, CASE WHEN pl IS NOT NULL THEN mid_at END AS lat, CASE WHEN pl IS NOT NULL THEN known_at END AS lconf, coalesce(close <= pl, true) AS lused,
      0 AS trend, 'NONE' AS event_type, 0 AS dir, NULL::DOUBLE AS broken, NULL::TIMESTAMP AS bat, NULL::TIMESTAMP AS bconf
      FROM {src} WHERE spos = 0"""
    step = f"""SELECT symbol, seg, spos, close,
      coalesce(ph, hp), CASE WHEN ph IS NOT NULL THEN mid_at ELSE hat END, CASE WHEN ph IS NOT NULL THEN known_at ELSE hconf END,
      CASE WHEN ph IS NOT NULL THEN close >= ph ELSE hused OR bull END,
      coalesce(pl, lp), CASE WHEN pl IS NOT NULL THEN mid_at ELSE lat END, CASE WHEN pl IS NOT NULL THEN known_at ELSE lconf END,
      CASE WHEN pl IS NOT NULL THEN close <= pl ELSE lused OR bear END,
      CASE WHEN bull THEN 1 WHEN bear THEN -1 ELSE trend END,
      CASE WHEN bull THEN 'BULLISH_' || CASE WHEN trend = -1 THEN 'CHOCH' ELSE 'BOS' END
           WHEN bear THEN 'BEARISH_' || CASE WHEN trend = 1 THEN 'CHOCH' ELSE 'BOS' END ELSE 'NONE' END,
      CASE WHEN bull THEN 1 WHEN bear THEN -1 ELSE 0 END,
      CASE WHEN bull THEN hp WHEN bear THEN lp END, CASE WHEN bull THEN hat WHEN bear THEN lat END, CASE WHEN bull THEN hconf WHEN bear THEN lconf END
      FROM (SELECT p.symbol, p.seg, p.spos, p.close, p.ph, p.pl, p.mid_at, p.known_at, s.hp, s.hat, s.hconf, s.hused, s.lp, s.lat, s.lconf, s.lused, s.trend,
        coalesce(NOT s.hused AND s.prev_close <= s.hp AND p.close > s.hp, false) AS bull,
        coalesce(NOT s.lused AND s.prev_close >= s.lp AND p.close < s.lp, false) AS bear
        FROM {name} s JOIN {src} p ON p.symbol = s.symbol AND p.seg = s.seg AND p.spos = s.spos + 1)"""
    return f"{start} UNION ALL {step}"


for _n in ("1", "4"):
    cte(f"bmach{_n}", _machine(f"piv{_n}", f"bmach{_n}"))
    cte(
        f"breaks{_n}",
        f"""SELECT p.symbol, p.timestamp, p.known_at, p.close, event_type, dir AS event_direction, broken AS broken_level,
        bat AS level_pivot_at, bconf AS level_confirmed_at, CASE WHEN dir <> 0 THEN p.known_at END AS break_at,
        trend AS trend_direction, CASE WHEN NOT hused THEN hp END AS active_high, CASE WHEN NOT lused THEN lp END AS active_low,
        p.close / broken - 1 AS break_distance_pct, dir <> 0 AS event_fired
        FROM bmach{_n} JOIN piv{_n} p USING (symbol, seg, spos)""",
    )
_BREAK_D = ["broken_level", "active_high", "active_low", "break_distance_pct"]


@query("breaks_crossing_1h", "SELECT * FROM breaks1", "close " + " ".join(_BREAK_D))
def _(spark, d):
    made = S.breaks_crossing(_placed(bars_1h(spark, d).drop("pos"), HOUR), series=["symbol", "seg"])
    return made.select("symbol", "timestamp", "known_at", "close", *S.BREAK_FIELDS)


_break_mask = {
    "event_fired": "coalesce(m AND fresh AND {c}, false)",
    "event_type": "CASE WHEN m THEN CASE WHEN fresh THEN {c} ELSE 'NONE' END END",
    "event_direction": "CASE WHEN m THEN CASE WHEN fresh THEN {c} ELSE 0 END END",
} | {c: "CASE WHEN m AND fresh THEN {c} END" for c in ("broken_level", "level_pivot_at", "level_confirmed_at", "break_at", "break_distance_pct")}


@query(
    "break_snapshots",
    _snapshot_sql("breaks", S.BREAK_FIELDS, _break_mask),
    " ".join(f"{c}_{t}" for c in [*_BREAK_D, "close"] for t in FRAMES),
)
def _(spark, d):
    return S.break_snapshots(bars_1h(spark, d).drop("pos"), FRAMES)


# whole-series structure on end-stamped bars (no restart at gaps)
for _n, _src in (("1", "bars"), ("4", "bars4"), ("24", "bars24")):
    cte(f"ends{_n}", f"SELECT symbol, known_at AS timestamp, known_at, pos, open, high, low, close FROM {_src}")
    cte(f"epiv{_n}", _pivots(f"ends{_n}", "symbol", "pos", "timestamp"))
    _first = f"""SELECT symbol, pos, ph AS hp, NULL::DOUBLE AS hprior, CASE WHEN ph IS NOT NULL THEN mid_at END AS hat,
      pl AS lp, NULL::DOUBLE AS lprior, CASE WHEN pl IS NOT NULL THEN mid_at END AS lat, false AS hbroken, false AS lbroken,
      0 AS regime, false AS bos_up, false AS bos_down, false AS choch_up, false AS choch_down FROM epiv{_n} WHERE pos = 0"""
    _next = f"""SELECT symbol, pos, hp, hprior, hat, lp, lprior, lat, hbroken OR up, lbroken OR down,
      CASE WHEN down THEN -1 WHEN up THEN 1 ELSE regime END, up, down, up AND regime < 0, down AND regime > 0 FROM (
      SELECT *, coalesce(NOT hbroken AND close > hp, false) AS up, coalesce(NOT lbroken AND close < lp, false) AS down FROM (
      SELECT p.symbol, p.pos, p.close, coalesce(p.ph, s.hp) AS hp, CASE WHEN p.ph IS NOT NULL THEN s.hp ELSE s.hprior END AS hprior,
       CASE WHEN p.ph IS NOT NULL THEN p.mid_at ELSE s.hat END AS hat,
       coalesce(p.pl, s.lp) AS lp, CASE WHEN p.pl IS NOT NULL THEN s.lp ELSE s.lprior END AS lprior,
       CASE WHEN p.pl IS NOT NULL THEN p.mid_at ELSE s.lat END AS lat,
       s.hbroken AND p.ph IS NULL AS hbroken, s.lbroken AND p.pl IS NULL AS lbroken, s.regime
       FROM smach{_n} s JOIN epiv{_n} p ON p.symbol = s.symbol AND p.pos = s.pos + 1))"""
    cte(f"smach{_n}", f"{_first} UNION ALL {_next}")
    cte(
        f"struct{_n}",
        f"""SELECT p.symbol, p.timestamp AS available_at, p.close, hp AS last_swing_high, lp AS last_swing_low, hat AS swing_high_at, lat AS swing_low_at,
        CASE WHEN hp IS NULL THEN 'NONE' WHEN hprior IS NULL THEN 'FIRST' WHEN hp > hprior THEN 'HH' WHEN hp < hprior THEN 'LH' ELSE 'EH' END AS high_structure,
        CASE WHEN lp IS NULL THEN 'NONE' WHEN lprior IS NULL THEN 'FIRST' WHEN lp > lprior THEN 'HL' WHEN lp < lprior THEN 'LL' ELSE 'EL' END AS low_structure,
        ph IS NOT NULL AS pivot_high_confirmed, pl IS NOT NULL AS pivot_low_confirmed, bos_up, bos_down, choch_up, choch_down, regime AS structure_regime
        FROM smach{_n} JOIN epiv{_n} p USING (symbol, pos)""",
    )

_STATE = [*S.STRUCTURE_STATE, *S.STRUCTURE_EVENTS, "structure_regime"]


@query(
    "breaks_beyond_1h",
    f"SELECT symbol, available_at, close, {', '.join(_STATE)} FROM struct1",
    "close last_swing_high last_swing_low",
)
def _(spark, d):
    ends = S.end_stamped(bars_1h(spark, d), HOUR)
    placed = with_position(ends, keys=["symbol"], ts="timestamp", step=HOUR, reset=False)
    return S.breaks_beyond(placed, series=["symbol"]).select(
        "symbol", F.col("known_at").alias("available_at"), "close", *_STATE
    )


def _struct_join(tf: str, n: str) -> str:
    cols = ", ".join(
        f'coalesce(s."{c}" AND s.available_at = x.known_at, false) AS "{tf}_{c}"' if c in S.STRUCTURE_EVENTS else f's."{c}" AS "{tf}_{c}"'
        for c in _STATE
    )
    return f"""SELECT x.*, s.available_at AS "{tf}_available_at", {cols},
        (x.close / s.last_swing_high - 1) * 100 AS "{tf}_dist_swing_high_pct", (x.close / s.last_swing_low - 1) * 100 AS "{tf}_dist_swing_low_pct"
        FROM {{src}} x ASOF LEFT JOIN struct{n} s ON s.symbol = x.symbol AND x.known_at >= s.available_at"""


cte("st0", "SELECT symbol, timestamp, close, known_at FROM bars")
cte("st1", _struct_join("1h", "1").replace("{src}", "st0"))
cte("st4", _struct_join("4h", "4").replace("{src}", "st1"))
cte("structure_table", _struct_join("1d", "24").replace("{src}", "st4"))
_ALL = {"1h": HOUR, "4h": 4 * HOUR, "1d": 24 * HOUR}
_ST_D = " ".join(f"{t}_{c}" for t in _ALL for c in ("last_swing_high", "last_swing_low", "dist_swing_high_pct", "dist_swing_low_pct"))


def structure(spark, d):
    return stage(spark, d, "structure", lambda: S.structure_table(bars_1h(spark, d), _ALL))


@query("structure_table", "SELECT * FROM structure_table", "close " + _ST_D)
def _(spark, d):
    return structure(spark, d)


def _event_sql(tf: str) -> str:
    parts = []
    for flag, kind, label, at, price in (
        ("pivot_high_confirmed", "high", f'"{tf}_high_structure"', f'"{tf}_swing_high_at"', f'"{tf}_last_swing_high"'),
        ("pivot_low_confirmed", "low", f'"{tf}_low_structure"', f'"{tf}_swing_low_at"', f'"{tf}_last_swing_low"'),
        ("bos_up", "break_up", "'BOS↑'", "NULL::TIMESTAMP", "NULL::DOUBLE"),
        ("bos_down", "break_down", "'BOS↓'", "NULL::TIMESTAMP", "NULL::DOUBLE"),
        ("choch_up", "change_up", "'CHoCH↑'", "NULL::TIMESTAMP", "NULL::DOUBLE"),
        ("choch_down", "change_down", "'CHoCH↓'", "NULL::TIMESTAMP", "NULL::DOUBLE"),
    ):
        parts.append(
            f"""SELECT symbol, timestamp, "{tf}_available_at" AS known_at, '{kind}' AS kind, {label} AS label, {at} AS pivot_at, {price} AS price
            FROM structure_table WHERE "{tf}_{flag}" """
        )
    return " UNION ALL ".join(parts)


@query("structure_event_rows", _event_sql("4h"), "price")
def _(spark, d):
    return S.structure_events(structure(spark, d), "4h")


@query(
    "market_structure_range",
    f"""SELECT * FROM ({_event_sql("1h")}) WHERE timestamp >= TIMESTAMP '2024-01-08' AND timestamp <= TIMESTAMP '2024-01-20'
        ORDER BY timestamp, symbol, kind LIMIT 200""",
    "price",
)
def _(spark, d):
    """Range scan of structure events, first rows by time (API listing)."""
    t = F.col("timestamp")
    span = structure(spark, d).filter(t.between(F.lit("2024-01-08").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz")))
    return S.structure_events(span, "1h").orderBy("timestamp", "symbol", "kind").limit(200)


# fixed-percentage zigzag as a recursive state machine
def _zz_pct(src: str, part: str, p: str, name: str, f: float) -> str:
    key = part.split(", ")
    on = " AND ".join(f"b.{k} = s.{k}" for k in key)
    ks = ", ".join(f"b.{k}" for k in key)
    return f"""SELECT {part}, {p}, 'SEEK' AS mode, high AS hi, low AS lo, timestamp AS hi_at, timestamp AS lo_at,
      NULL::DOUBLE AS phigh, NULL::DOUBLE AS plow, NULL::VARCHAR AS kind, NULL::VARCHAR AS label, NULL::DOUBLE AS price, NULL::TIMESTAMP AS pivot_at
      FROM {src} WHERE {p} = 0
      UNION ALL
      SELECT {part}, {p},
       CASE WHEN go_up OR ev_low THEN 'UP' WHEN go_down OR ev_high THEN 'DOWN' ELSE mode END,
       CASE WHEN go_up OR ev_low THEN high ELSE nhi END, CASE WHEN go_down OR ev_high THEN low ELSE nlo END,
       CASE WHEN go_up OR ev_low THEN ts ELSE nhi_at END, CASE WHEN go_down OR ev_high THEN ts ELSE nlo_at END,
       CASE WHEN ev_high THEN nhi ELSE phigh END, CASE WHEN ev_low THEN nlo ELSE plow END,
       CASE WHEN ev_high THEN 'HIGH' WHEN ev_low THEN 'LOW' END,
       CASE WHEN ev_high THEN CASE WHEN phigh IS NULL THEN 'FIRST' WHEN nhi > phigh THEN 'HH' WHEN nhi < phigh THEN 'LH' ELSE 'EH' END
            WHEN ev_low THEN CASE WHEN plow IS NULL THEN 'FIRST' WHEN nlo > plow THEN 'HL' WHEN nlo < plow THEN 'LL' ELSE 'EL' END END,
       CASE WHEN ev_high THEN nhi WHEN ev_low THEN nlo END, CASE WHEN ev_high THEN nhi_at WHEN ev_low THEN nlo_at END
      FROM (SELECT *, mode = 'UP' AND close <= nhi * (1 - {f}::DOUBLE) AND nhi_at < ts AS ev_high,
                      mode = 'DOWN' AND close >= nlo * (1 + {f}::DOUBLE) AND nlo_at < ts AS ev_low
       FROM (SELECT *, CASE WHEN high > hi AND (mode = 'UP' OR (mode = 'SEEK' AND NOT go_up AND NOT go_down)) THEN high ELSE hi END AS nhi,
              CASE WHEN high > hi AND (mode = 'UP' OR (mode = 'SEEK' AND NOT go_up AND NOT go_down)) THEN ts ELSE hi_at END AS nhi_at,
              CASE WHEN low < lo AND (mode = 'DOWN' OR (mode = 'SEEK' AND NOT go_up AND NOT go_down)) THEN low ELSE lo END AS nlo,
              CASE WHEN low < lo AND (mode = 'DOWN' OR (mode = 'SEEK' AND NOT go_up AND NOT go_down)) THEN ts ELSE lo_at END AS nlo_at
        FROM (SELECT {ks}, b.{p}, b.timestamp AS ts, b.high, b.low, b.close, s.mode, s.hi, s.lo, s.hi_at, s.lo_at, s.phigh, s.plow,
               s.mode = 'SEEK' AND b.close >= s.lo * (1 + {f}::DOUBLE) AND NOT b.close <= s.hi * (1 - {f}::DOUBLE) AS go_up,
               s.mode = 'SEEK' AND b.close <= s.hi * (1 - {f}::DOUBLE) AND NOT b.close >= s.lo * (1 + {f}::DOUBLE) AS go_down
              FROM {name} s JOIN {src} b ON {on} AND b.{p} = s.{p} + 1)))"""


for _n in ("1", "4", "24"):
    cte(f"zz{_n}", _zz_pct(f"ends{_n}", "symbol", "pos", f"zz{_n}", 0.01))
    cte(
        f"zzev{_n}",
        f"""SELECT z.symbol, e.timestamp AS confirmation_at, pivot_at, kind, label, price FROM zz{_n} z JOIN ends{_n} e USING (symbol, pos) WHERE kind IS NOT NULL""",
    )
cte("zigzag_events", " UNION ALL ".join(f"SELECT '{t}' AS timeframe, * FROM zzev{n}" for t, n in (("1h", "1"), ("4h", "4"), ("1d", "24"))))


def zigzag_events(spark, d):
    def build():
        out = None
        for tf, step in _ALL.items():
            ends = S.end_stamped(bars_1h(spark, d), step)
            placed = with_position(ends, keys=["symbol"], ts="timestamp", step=step, reset=False)
            made = S.zigzag_pct(placed, series=["symbol"], pct=1.0).withColumn("timeframe", F.lit(tf))
            out = made if out is None else out.unionByName(made)
        return out

    return stage(spark, d, "zigzag_events", build)


@query("zigzag_pct_events", "SELECT * FROM zigzag_events", "price")
def _(spark, d):
    return zigzag_events(spark, d)


@query(
    "zigzag_range",
    """SELECT * FROM zigzag_events WHERE timeframe = '4h' AND confirmation_at >= TIMESTAMP '2024-01-05' AND confirmation_at <= TIMESTAMP '2024-01-25'
       ORDER BY confirmation_at, symbol LIMIT 100""",
    "price",
)
def _(spark, d):
    """Range listing of zigzag events of one timeframe."""
    at = F.col("confirmation_at")
    return (
        zigzag_events(spark, d)
        .filter((F.col("timeframe") == "4h") & at.between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-25").cast("timestamp_ntz")))
        .orderBy("confirmation_at", "symbol").limit(100)
    )


def _zz_atr(n: str) -> str:
    w = "OVER (PARTITION BY symbol, seg ORDER BY spos ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"
    cte(
        f"zatr{n}",
        f"""SELECT symbol, seg, spos, timestamp, known_at, high, low, close, CASE WHEN spos >= 14 THEN avg(tr) {w} END AS atr FROM (
        SELECT *, CASE WHEN spos > 0 THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM (
        SELECT *, lag(close) OVER (PARTITION BY symbol, seg ORDER BY spos) AS pc FROM runs{n}))""",
    )
    return f"""SELECT symbol, seg, spos, 'SEEK' AS mode, NULL::DOUBLE AS hi, NULL::BIGINT AS hi_i, NULL::DOUBLE AS hi_a, NULL::DOUBLE AS lo, NULL::BIGINT AS lo_i, NULL::DOUBLE AS lo_a,
      NULL::DOUBLE AS last_high, NULL::DOUBLE AS last_low, NULL::BIGINT AS last_i, 'NONE' AS ev, NULL::BIGINT AS piv, NULL::DOUBLE AS price, NULL::DOUBLE AS ratr, NULL::DOUBLE AS rpct
      FROM zatr{n} WHERE spos = 0
      UNION ALL
      SELECT symbol, seg, spos,
        CASE WHEN seek_up OR ev_low THEN 'UP' WHEN seek_dn OR ev_high THEN 'DOWN' ELSE mode END,
        CASE WHEN seek_up OR ev_low OR grow_hi THEN high ELSE hi END, CASE WHEN seek_up OR ev_low OR grow_hi THEN spos ELSE hi_i END, CASE WHEN seek_up OR ev_low OR grow_hi THEN atr ELSE hi_a END,
        CASE WHEN seek_dn OR ev_high OR grow_lo THEN low ELSE lo END, CASE WHEN seek_dn OR ev_high OR grow_lo THEN spos ELSE lo_i END, CASE WHEN seek_dn OR ev_high OR grow_lo THEN atr ELSE lo_a END,
        CASE WHEN ev_high THEN hi ELSE last_high END, CASE WHEN ev_low THEN lo ELSE last_low END, CASE WHEN ev_high OR ev_low THEN spos ELSE last_i END,
        CASE WHEN ev_high THEN 'HIGH' WHEN ev_low THEN 'LOW' ELSE 'NONE' END, CASE WHEN ev_high THEN hi_i WHEN ev_low THEN lo_i END,
        CASE WHEN ev_high THEN hi WHEN ev_low THEN lo END, CASE WHEN ev_high THEN (hi - close) / hi_a WHEN ev_low THEN (close - lo) / lo_a END,
        CASE WHEN ev_high THEN (hi - close) / hi WHEN ev_low THEN (close - lo) / lo END
      FROM (SELECT *,
          CASE WHEN mode = 'SEEK' THEN seek_grow_hi ELSE mode = 'UP' AND live AND NOT ev_high AND high > hi END AS grow_hi,
          CASE WHEN mode = 'SEEK' THEN seek_grow_lo ELSE mode = 'DOWN' AND live AND NOT ev_low AND low < lo END AS grow_lo
        FROM (SELECT *, mode = 'SEEK' AND live AND close >= slo + 2 * slo_a AS seek_up,
           mode = 'SEEK' AND live AND NOT close >= slo + 2 * slo_a AND close <= shi - 2 * shi_a AS seek_dn,
           mode = 'UP' AND live AND spos > hi_i AND close <= hi - 2 * hi_a AS ev_high,
           mode = 'DOWN' AND live AND spos > lo_i AND close >= lo + 2 * lo_a AS ev_low
         FROM (SELECT *, live AND (hi IS NULL OR high > hi) AS seek_grow_hi, live AND (lo IS NULL OR low < lo) AS seek_grow_lo,
            CASE WHEN hi IS NULL OR high > hi THEN high ELSE hi END AS shi, CASE WHEN hi IS NULL OR high > hi THEN atr ELSE hi_a END AS shi_a,
            CASE WHEN lo IS NULL OR low < lo THEN low ELSE lo END AS slo, CASE WHEN lo IS NULL OR low < lo THEN atr ELSE lo_a END AS slo_a
          FROM (SELECT b.symbol, b.seg, b.spos, b.high, b.low, b.close, b.atr, coalesce(b.atr > 0, false) AS live,
             s.mode, s.hi, s.hi_i, s.hi_a, s.lo, s.lo_i, s.lo_a, s.last_high, s.last_low, s.last_i
             FROM zmach{n} s JOIN zatr{n} b ON b.symbol = s.symbol AND b.seg = s.seg AND b.spos = s.spos + 1))))"""


for _n, _h in (("1", 1), ("4", 4)):
    cte(f"zmach{_n}", _zz_atr(_n))
    cte(
        f"zigs{_n}",
        f"""SELECT symbol, timestamp, known_at, close, ev AS zz_event, ev <> 'NONE' AS zz_confirmed, seg + piv * INTERVAL {_h} HOUR AS zz_pivot_at,
        CASE WHEN ev <> 'NONE' THEN known_at END AS zz_confirmed_at, price AS zz_pivot_price, ratr AS zz_reversal_atr, rpct AS zz_reversal_pct,
        last_high AS zz_last_high, last_low AS zz_last_low, mode AS zz_direction, spos - last_i AS zz_age_bars
        FROM zmach{_n} JOIN zatr{_n} USING (symbol, seg, spos)""",
    )
_ZZ_D = "zz_pivot_price zz_reversal_atr zz_reversal_pct zz_last_high zz_last_low"


@query("zigzag_atr_1h", f"SELECT symbol, timestamp, known_at, {', '.join(S.ZIGZAG_ATR_FIELDS)} FROM zigs1", _ZZ_D)
def _(spark, d):
    return S.zigzag_atr(bars_1h(spark, d).drop("pos"), HOUR).select("symbol", "timestamp", "known_at", *S.ZIGZAG_ATR_FIELDS)


_zig_mask = {
    "zz_confirmed": "coalesce(m AND fresh AND {c}, false)",
    "zz_event": "CASE WHEN m AND fresh THEN {c} ELSE 'NONE' END",
} | {c: "CASE WHEN m AND fresh THEN {c} END" for c in ("zz_pivot_at", "zz_confirmed_at", "zz_pivot_price", "zz_reversal_atr", "zz_reversal_pct")}


@query(
    "zigzag_snapshots",
    _snapshot_sql("zigs", S.ZIGZAG_ATR_FIELDS, _zig_mask, extra=""),
    " ".join(f"{c}_{t}" for c in _ZZ_D.split() for t in FRAMES),
)
def _(spark, d):
    return S.zigzag_snapshots(bars_1h(spark, d).drop("pos"), FRAMES)


# levels whose pivots restart at gaps but stay usable afterwards
for _n, _h in (("1", 1), ("4", 4)):
    cte(f"endruns{_n}", f"SELECT symbol, known_at AS timestamp, known_at, seg + INTERVAL {_h} HOUR AS seg, spos, high, low, close FROM runs{_n}")
    cte(f"zzr{_n}", _zz_pct(f"endruns{_n}", "symbol, seg", "spos", f"zzr{_n}", 0.01))
    cte(
        f"levels{_n}",
        f"""SELECT 'zigzag' AS method, '{_h}h' AS timeframe, symbol, e.timestamp AS confirmed_at, pivot_at, kind, price
        FROM zzr{_n} z JOIN endruns{_n} e USING (symbol, seg, spos) WHERE kind IS NOT NULL
        UNION ALL SELECT 'fractal', '{_h}h', symbol, known_at, mid_at + INTERVAL {_h} HOUR, 'HIGH', ph FROM piv{_n} WHERE ph IS NOT NULL
        UNION ALL SELECT 'fractal', '{_h}h', symbol, known_at, mid_at + INTERVAL {_h} HOUR, 'LOW', pl FROM piv{_n} WHERE pl IS NOT NULL""",
    )
cte("levels", "SELECT * FROM levels1 UNION ALL SELECT * FROM levels4")


def levels(spark, d):
    def build():
        out = None
        for method, tf in METHODS:
            made = S.confirmed_levels(bars_1h(spark, d).drop("pos"), method, FRAMES[tf])
            made = made.withColumns({"method": F.lit(method), "timeframe": F.lit(tf)})
            out = made if out is None else out.unionByName(made)
        return out

    return stage(spark, d, "levels", build)


@query("confirmed_levels", "SELECT * FROM levels", "price")
def _(spark, d):
    return levels(spark, d)


cte("mt", "SELECT DISTINCT method, timeframe FROM levels")
cte(
    "stop_refs",
    """SELECT *, CASE WHEN entry_open IS NULL OR entry_open <= 0 THEN 'ENTRY_OUTSIDE_SPLIT'
      WHEN stop_confirmed_at IS NULL OR stop_pivot_price IS NULL THEN 'NO_CONFIRMED_PIVOT'
      WHEN stop_confirmed_at > known_at THEN 'FUTURE_CONFIRMATION' WHEN distance_pct <= 0 THEN 'STOP_ALREADY_INVALID'
      WHEN distance_pct < 0.1 THEN 'TOO_CLOSE' WHEN distance_pct > 5.0 THEN 'TOO_FAR' ELSE 'VALID_REFERENCE' END AS status FROM (
     SELECT *, CASE WHEN side = 'SHORT' THEN stop_price - entry_open ELSE entry_open - stop_price END / entry_open * 100 AS distance_pct,
      epoch(known_at - stop_confirmed_at) / 3600 AS age_since_confirmation_h, epoch(known_at - stop_pivot_at) / 3600 AS age_since_formation_h,
      epoch(stop_confirmed_at - stop_pivot_at) / 3600 AS confirmation_delay_h FROM (
     SELECT c.event_id, c.symbol, c.timestamp AS signal_timestamp, c.known_at, c.side, c.split, c.method, c.timeframe, b.open AS entry_open,
      l.kind AS stop_kind, CASE WHEN c.side = 'SHORT' THEN 'HIGH' ELSE 'LOW' END AS stop_reference, l.price AS stop_pivot_price, l.confirmed_at AS stop_confirmed_at, l.pivot_at AS stop_pivot_at,
      l.price * CASE WHEN c.side = 'SHORT' THEN 1 + 0.0005::DOUBLE ELSE 1 - 0.0005::DOUBLE END AS stop_price
     FROM (SELECT * FROM cand, mt) c
     ASOF LEFT JOIN levels l ON l.symbol = c.symbol AND l.method = c.method AND l.timeframe = c.timeframe
       AND l.kind = CASE WHEN c.side = 'SHORT' THEN 'HIGH' ELSE 'LOW' END AND c.known_at >= l.confirmed_at
     LEFT JOIN bars b ON b.symbol = c.symbol AND b.timestamp = c.known_at))""",
)
_REF = (
    "event_id symbol signal_timestamp known_at side split method timeframe entry_open stop_reference stop_pivot_price "
    "stop_confirmed_at stop_pivot_at stop_price distance_pct age_since_confirmation_h age_since_formation_h confirmation_delay_h status"
).split()
_REF_D = "entry_open stop_pivot_price stop_price distance_pct age_since_confirmation_h age_since_formation_h confirmation_delay_h"


def stop_references(spark, d):
    def build():
        cands = candidates(spark, d).select("event_id", "symbol", F.col("timestamp").alias("signal_timestamp"), "known_at", "side", "split")
        bars, lv, out = bars_1h(spark, d), levels(spark, d), None
        for method, tf in METHODS:
            mine = lv.filter((F.col("method") == method) & (F.col("timeframe") == tf))
            made = S.stop_references(cands, bars, mine, method=method, timeframe=tf).select(*_REF)
            out = made if out is None else out.unionByName(made)
        return out

    return stage(spark, d, "stop_references", build)


@query("stop_references", f"SELECT {', '.join(_REF)} FROM stop_refs", _REF_D)
def _(spark, d):
    return stop_references(spark, d)


@query(
    "stop_status_counts",
    "SELECT method, timeframe, side, status, count(*) AS n FROM stop_refs GROUP BY ALL",
)
def _(spark, d):
    return stop_references(spark, d).groupBy("method", "timeframe", "side", "status").agg(F.count(F.lit(1)).alias("n"))


_QS = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


@query(
    "stop_distance_quantiles",
    "SELECT method, timeframe, side, feature, count(x) AS n, "
    + ", ".join(f"quantile_cont(x, {q}::DOUBLE) AS {k}" for k, q in _QS.items())
    + """ FROM (SELECT method, timeframe, side, 'distance_pct' AS feature, CASE WHEN status IN ('VALID_REFERENCE', 'TOO_CLOSE', 'TOO_FAR') THEN distance_pct END AS x FROM stop_refs
        UNION ALL SELECT method, timeframe, side, 'age_since_confirmation_h', age_since_confirmation_h FROM stop_refs
        UNION ALL SELECT method, timeframe, side, 'age_since_formation_h', age_since_formation_h FROM stop_refs
        UNION ALL SELECT method, timeframe, side, 'confirmation_delay_h', confirmation_delay_h FROM stop_refs)
        WHERE x IS NOT NULL GROUP BY ALL""",
    " ".join(_QS),
)
def _(spark, d):
    refs = stop_references(spark, d)
    plausible = F.col("status").isin("VALID_REFERENCE", "TOO_CLOSE", "TOO_FAR")
    refs = refs.withColumn("distance_pct", F.when(plausible, F.col("distance_pct")))
    cols = ["distance_pct", "age_since_confirmation_h", "age_since_formation_h", "confirmation_delay_h"]
    long = melt(refs, ["method", "timeframe", "side"], cols)
    return quantiles(long, ["method", "timeframe", "side", "feature"], "x", _QS)


def observation_parts(spark, d):
    """The four snapshot tables of one grid."""
    from .features import indicator_rows

    bars = bars_1h(spark, d).drop("pos")
    make = {
        "swing_snapshots": lambda: S.swing_snapshots(bars, FRAMES),
        "break_snapshots": lambda: S.break_snapshots(bars, FRAMES),
        "zigzag_snapshots": lambda: S.zigzag_snapshots(bars, FRAMES),
    }
    return [indicator_rows(spark, d), *[stage(spark, d, n, f) for n, f in make.items()]]


cte("swing_snap", _snapshot_sql("swings", _SWING, _swing_mask))
cte("break_snap", _snapshot_sql("breaks", S.BREAK_FIELDS, _break_mask))
cte("zig_snap", _snapshot_sql("zigs", S.ZIGZAG_ATR_FIELDS, _zig_mask, extra=""))


def observations(spark, d):
    def build():
        merged = O.merge_snapshots(observation_parts(spark, d), ["symbol", "decision_at", "bar_open_1h"])
        return O.normalise(merged, FRAMES)

    return stage(spark, d, "observations", build)


def _code_sql(c: str, col: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in O.CATEGORIES[c].items()) + " END"


def _norm_sql() -> str:
    out = ["i.symbol", "i.decision_at"]
    for tf in FRAMES:
        m = f"i.known_at_{tf} IS NOT NULL"
        out.append(f"({m})::INT AS context_available_{tf}")
        for c in [*O.CONTINUOUS, *O.LEVELS, *O.FLAGS, *O.NUMBERS, *O.CATEGORIES]:
            x, target = f'"{c}_{tf}"', f"{c}_{tf}"
            if c in O.LEVELS:
                x, target = f"{x} / i.close_{tf} - 1", f"{c}_distance_to_close_{tf}"
            elif c in O.CATEGORIES:
                x, target = _code_sql(c, x), f"{target}_code"
            elif c in O.FLAGS:
                x = f"{x}::INT"
            x = f"CASE WHEN {m} THEN round(CAST({x} AS FLOAT)::DOUBLE, 4) END"
            out.append(f"{x} AS {target}")
            if c in O.MASKED:
                out.append(f"({x} IS NOT NULL)::INT AS {target}_available")
    return f"""SELECT {", ".join(out)} FROM ind_snap i JOIN swing_snap s USING (symbol, decision_at) JOIN break_snap b USING (symbol, decision_at) JOIN zig_snap z USING (symbol, decision_at)"""


@query("normalised_observations", _norm_sql())
def _(spark, d):
    """Four snapshots merged 1:1, coded, scaled and masked (floats to 4 decimals)."""
    made = observations(spark, d)
    names, digest = O.feature_schema(made)
    out = O.project(made, names, digest)
    return out.withColumns({n: F.round(F.col(n).cast("double"), 4) for n, t in out.dtypes if t == "float"})
