"""Rules of the operators on hand-made bars."""

import numpy as np
import pandas as pd
import pytest
from helpers import START, bars_from, frame, random_bars
from pyspark.sql import functions as F

from barloom.functions import scalar as V
from barloom.functions import text as X
from barloom.operators import bars as B
from barloom.operators import events as E
from barloom.operators import indicators as I
from barloom.operators import labels as L
from barloom.operators import observations as O
from barloom.operators import quality as Q
from barloom.operators import sampling as H
from barloom.operators import screens as S
from barloom.operators import structure as ST
from barloom.plans import transfer
from barloom.plans.blocks import with_position
from barloom.session import materialise
from barloom.sources import candles as C

HOUR = 3600


def placed(spark, pdf, reset=True, size=32_768):
    df = with_position(frame(spark, pdf), keys=["symbol"], ts="timestamp", step=HOUR, reset=reset, size=size)
    return df.withColumn("known_at", F.col("timestamp") + F.expr("INTERVAL 1 HOUR"))


def test_incomplete_bars_are_dropped(spark):
    pdf = random_bars(16, symbols=("a",), gaps=(5,))
    got = B.resample_ohlcv(frame(spark, pdf), 4 * HOUR).orderBy("timestamp").toPandas()
    assert [t.hour for t in got.timestamp] == [0, 8, 12]
    first = pdf[pdf.timestamp < START + pd.Timedelta(hours=4)]
    assert got.high[0] == first.high.max() and got.close[0] == first.close.iloc[-1] and got.open[0] == first.open.iloc[0]
    assert (got.known_at == got.timestamp + pd.Timedelta(hours=4)).all()


def test_tick_bars_stay_hash_aggregated(spark):
    ticks = frame(spark, pd.DataFrame({"symbol": "a", "timestamp": [START] * 3, "event_id": [2, 1, 3], "price": [5.0, 4.0, 6.0], "volume": 1.0}))
    made = B.ticks_to_bars(ticks, HOUR)
    row = made.collect()[0]
    assert (row.open, row.close, row.n_ticks) == (4.0, 6.0, 3)  # ties by event id
    assert "SortAggregate" not in made._jdf.queryExecution().executedPlan().toString()


def test_upsert_keeps_last_load_and_closed_bars(spark):
    pdf = random_bars(6, symbols=("a",))[["symbol", "timestamp", "close"]].assign(known_at=lambda d: d.timestamp + pd.Timedelta(hours=1))
    old, new = frame(spark, pdf.iloc[:4]), frame(spark, pdf.iloc[3:].assign(close=-1.0))
    got = B.upsert_bars(old, new, key=["symbol", "timestamp"], closed_at="known_at", as_of=F.lit("2024-01-01 05:00:00").cast("timestamp_ntz"))
    assert [r.close for r in got.orderBy("timestamp").collect()] == [*pdf.close[:3], -1.0, -1.0]


def test_segment_indicators_match_pandas_and_restart_at_gaps(spark):
    pdf = random_bars(90, symbols=("a",), gaps=(50,))
    got = I.segment_indicators(frame(spark, pdf), HOUR, block=16).orderBy("timestamp").toPandas()
    for _, x in pdf.groupby(pdf.timestamp.diff().ne(pd.Timedelta(hours=1)).cumsum()):
        g = got[got.timestamp.isin(x.timestamp)]
        c = x.close.reset_index(drop=True)
        e12, e26 = (c.ewm(span=n, adjust=False, min_periods=n).mean() for n in (12, 26))
        macd = e12 - e26
        hist = (macd - macd.ewm(span=9, adjust=False, min_periods=9).mean()) / c
        np.testing.assert_allclose(g.macd_hist.to_numpy(float), hist.to_numpy(float), rtol=1e-8, atol=1e-12)
        np.testing.assert_allclose(g.bb20_z.to_numpy(float), ((c - c.rolling(20).mean()) / c.rolling(20).std(ddof=0)).to_numpy(float), rtol=1e-8)
        d = c.diff().fillna(0).to_numpy()
        up, dn = np.clip(d, 0, None), np.clip(-d, 0, None)
        u, v = up[1:15].mean(), dn[1:15].mean()
        for i in range(14, len(c)):
            if i > 14:
                u, v = (13 * u + up[i]) / 14, (13 * v + dn[i]) / 14
            assert g.rsi14.iloc[i] == pytest.approx(100 - 100 / (1 + u / v))
        assert g.rsi14.iloc[:14].isna().all()


def test_flat_prices_and_zero_volume(spark):
    pdf = bars_from([100.0] * 40, [100.0] * 40, [100.0] * 40).assign(volume=0.0)
    got = I.segment_indicators(frame(spark, pdf), HOUR).orderBy("timestamp").toPandas().iloc[-1]
    assert got.rsi14 == 50 and pd.isna(got.bb20_z) and pd.isna(got.relative_volume20) and pd.isna(got.rolling_vwap20_distance)


def test_features_do_not_change_when_rows_are_appended(spark):
    pdf = random_bars(130, symbols=("a",))
    full = I.feature_table(frame(spark, pdf)).orderBy("timestamp").toPandas()
    part = I.feature_table(frame(spark, pdf.iloc[:100])).orderBy("timestamp").toPandas()
    cols = ["ema20", "rsi14", "atr14", "volatility_72h", "prev_high_24h", "4h_rsi14", "1d_close", "trend_1h", "breakout_24h"]
    pd.testing.assert_frame_equal(full[cols].iloc[:100], part[cols], check_dtype=False)


def test_pivot_ties_and_confirmation_delay(spark):
    highs = [10, 11, 15, 12, 11, 13, 14, 14, 12, 11]
    got = ST.fractal_pivots(placed(spark, bars_from(highs)), series=["symbol", "seg"]).orderBy("timestamp").toPandas()
    assert got.pivot_high_confirmed.tolist() == [i == 4 for i in range(10)]  # 15 at bar 2, seen at bar 4; the tie at 14 is no pivot
    assert got.swing_high_price.isna().iloc[:4].all() and (got.swing_high_price.iloc[4:] == 15).all()
    gap = ST.fractal_pivots(placed(spark, bars_from(highs, skip_at=4)), series=["symbol", "seg"]).toPandas()
    assert not gap.pivot_high_confirmed.any()


def test_structure_does_not_depend_on_block_size(spark):
    pdf = random_bars(160, symbols=("a", "b"), gaps=(77,))
    for fn, series in ((ST.breaks_crossing, ["symbol", "seg"]), (ST.breaks_beyond, ["symbol"])):
        base = placed(spark, pdf, reset=series != ["symbol"])
        a, b = (fn(base, series=series, size=s).toPandas().sort_values(["symbol", "timestamp"]).reset_index(drop=True) for s in (7, 4096))
        pd.testing.assert_frame_equal(a[sorted(a)], b[sorted(b)])
    z = [ST.zigzag_pct(placed(spark, pdf, reset=False), series=["symbol"], pct=2.0, size=s).toPandas() for s in (11, 4096)]
    k = ["symbol", "confirmation_at"]
    pd.testing.assert_frame_equal(*[x.sort_values(k).reset_index(drop=True) for x in z])
    y = [ST.zigzag_atr(frame(spark, pdf), HOUR, size=s).toPandas() for s in (13, 4096)]
    pd.testing.assert_frame_equal(*[x.sort_values(["symbol", "timestamp"]).reset_index(drop=True) for x in y])


def test_zigzag_confirms_the_older_extreme(spark):
    closes = [100, 102, 105, 104, 103, 102, 99]
    pdf = bars_from(closes, closes, closes)
    got = ST.zigzag_pct(placed(spark, pdf, reset=False), series=["symbol"], pct=2.0).toPandas()
    assert got.kind.tolist() == ["HIGH"] and got.price.tolist() == [105.0]
    assert got.confirmation_at[0] == START + pd.Timedelta(hours=5) and got.pivot_at[0] == START + pd.Timedelta(hours=2)


def test_break_needs_a_real_cross_and_impulse_shows_once(spark):
    highs = [10, 11, 15, 12, 11, 12, 15, 16, 17, 18, 17, 16]
    closes = [9, 10, 12, 11, 10, 11, 15, 15, 16, 17, 16, 15]
    got = ST.breaks_crossing(placed(spark, bars_from(highs, [c - 1 for c in closes], closes)), series=["symbol", "seg"]).orderBy("timestamp").toPandas()
    assert got.event_type.tolist().count("BULLISH_BOS") == 1 and got.event_type[8] == "BULLISH_BOS"  # 15 == level is no break
    snap = ST.break_snapshots(frame(spark, random_bars(120, symbols=("a",))), {"1h": HOUR, "4h": 4 * HOUR}).toPandas()
    assert (snap.event_fired_4h <= (snap.decision_at == snap.known_at_4h)).all()
    assert snap[snap.decision_at != snap.known_at_4h].broken_level_4h.isna().all()


def _outcome(spark, path, side="LONG", target=110.0, stop=95.0):
    rows = pd.DataFrame(path, columns=["open", "high", "low", "close"]).astype(float)
    rows["timestamp"] = START + pd.to_timedelta(np.arange(len(rows)), unit="h")
    arr = frame(spark, rows).orderBy("timestamp").agg(F.array_sort(F.collect_list(F.struct("timestamp", "open", "high", "low", "close"))).alias("p"))
    made = L.bracket_outcome(
        F.col("p"), F.lit(side), F.get("p", 0)["open"], F.lit(target), F.lit(stop), horizon=len(path), fee_bps=5.0, slippage_bps=2.0, risk=F.lit(5.0)
    )
    return arr.select(*[v.alias(k) for k, v in made.items()]).collect()[0]


def test_stop_first_gap_fill_and_timeout(spark):
    both = _outcome(spark, [(100, 111, 94, 100)])
    assert (both.reason, both.exit_raw) == ("SL", 95.0)
    gap = _outcome(spark, [(100, 101, 99, 100), (90, 91, 89, 90)])
    assert (gap.reason, gap.exit_raw, gap.duration_bars) == ("SL_GAP", 90.0, 2)
    up = _outcome(spark, [(100, 101, 99, 100), (120, 121, 119, 120)])
    assert (up.reason, up.exit_raw) == ("TP_GAP", 120.0)
    late = _outcome(spark, [(100, 101, 99, 100), (100, 101, 99, 101)])
    assert late.reason == "TIME" and late.net_return == pytest.approx((101 * 0.9998 - 100.02) / 100.02 - 0.0005 * (1 + 101 * 0.9998 / 100.02))
    short = _outcome(spark, [(100, 106, 99, 100)], side="SHORT", target=90.0, stop=105.0)
    assert (short.reason, short.exit_raw) == ("SL", 105.0) and short.net_return < -0.05


def test_labels_see_only_the_future_and_ambiguity_is_null(spark):
    pdf = random_bars(80, symbols=("a",))
    base = placed(spark, pdf, reset=False).withColumn("atr14", F.lit(1.0))
    one = L.add_labels(base, block=16).orderBy("timestamp").toPandas()
    bump = pdf.copy()
    bump.loc[60, "high"] *= 3
    two = L.add_labels(placed(spark, bump, reset=False).withColumn("atr14", F.lit(1.0)), block=16).orderBy("timestamp").toPandas()
    cols = [c for c in one.columns if "12h" in c]
    pd.testing.assert_frame_equal(one[cols].iloc[60:], two[cols].iloc[60:])
    pd.testing.assert_frame_equal(one[cols].iloc[:48], two[cols].iloc[:48])
    assert (one.long_best_12h_pct.iloc[48:60] < two.long_best_12h_pct.iloc[48:60]).all()
    assert one.future_return_24h_pct.iloc[-24:].isna().all() and one.future_return_24h_pct.iloc[:-24].notna().all()
    assert one[one.long_ambiguous_12h].long_outcome_12h.isna().all()


def test_selection_matches_a_plain_walk_in_small_chunks(spark):
    rng = np.random.default_rng(2)
    n = 300
    pdf = pd.DataFrame({"k": "a", "id": [f"{i:04}" for i in range(n)], "timestamp": START + pd.to_timedelta(np.arange(n), unit="h"), "s": np.arange(n)})
    pdf["e"] = pdf.s + rng.integers(0, 12, n)
    got = E.select_non_overlapping(frame(spark, pdf), keys=["k"], start="s", end="e", order=["timestamp", "id"], size=17).toPandas().sort_values("s")
    busy, want = -1, []
    for s, e in zip(pdf.s, pdf.e):
        want.append("TAKEN" if s > busy else "SKIPPED_OVERLAP")
        busy = e if s > busy else busy
    assert got.portfolio_status.tolist() == want


@pytest.mark.parametrize("strict", [True, False])
def test_selection_over_many_chunks_and_keys(spark, strict, monkeypatch):
    rng = np.random.default_rng(5)
    rounds = []
    monkeypatch.setattr(transfer, "materialise", lambda df, name: (rounds.append(name), materialise(df, name))[1])
    parts = []
    for key, n, longest in (("a", 260, 5), ("b", 100, 40), ("c", 70, 1), ("d", 3, 5)):
        # starts of the second series go back and forth; trades of the third never overlap, so that its walk visits every chunk
        s = np.arange(n) + (rng.integers(0, 9, n) if key == "b" else 0)
        parts.append(pd.DataFrame({"k": key, "id": [f"{i:04}" for i in range(n)], "timestamp": START + pd.to_timedelta(np.arange(n), unit="h"), "s": s, "e": s + rng.integers(0, longest, n)}))
    got = E.select_non_overlapping(frame(spark, pd.concat(parts)), keys=["k"], start="s", end="e", order=["timestamp", "id"], strict=strict, size=4).toPandas()
    for part in parts:
        busy, want = None, []
        for s, e in zip(part.s, part.e):
            free = busy is None or (s > busy if strict else s >= busy)
            want.append("TAKEN" if free else "SKIPPED_OVERLAP")
            busy = e if free else busy
        own = got[got.k == part.k.iloc[0]]
        assert own.sort_values("id").portfolio_status.tolist() == want
    assert len(rounds) == 1 + 7  # 65 chunks


def test_equity_and_chain(spark):
    pdf = pd.DataFrame({"k": "a", "timestamp": START + pd.to_timedelta(np.arange(30), unit="h"), "net_return": np.random.default_rng(1).normal(0, 0.05, 30), "side": "LONG", "net_r": 0.1})
    path = E.equity_path(frame(spark, pdf), keys=["k"], r="net_return", order=["timestamp"], size=4)
    got = path.orderBy("timestamp").toPandas()
    eq = (1 + pdf.net_return).cumprod()
    np.testing.assert_allclose(got.equity_after, eq)
    np.testing.assert_allclose(got.drawdown, eq / np.maximum.accumulate(np.r_[1.0, eq])[1:] - 1, atol=1e-12)
    assert Q.chain_audit(path, keys=["k"], order=["timestamp"]).agg(F.sum("violations")).collect()[0][0] == 0
    broken = path.withColumn("equity_before", F.when(F.col("trade_no") == 5, 9.0).otherwise(F.col("equity_before")))
    found = {r["check"]: r.violations for r in Q.chain_audit(broken, keys=["k"], order=["timestamp"]).collect()}
    assert found["own_step"] == 1 and found["broken_chain"] == 1
    with pytest.raises(Exception, match="lower alloc"):
        E.equity_path(frame(spark, pdf.assign(net_return=-1.5)), keys=["k"], r="net_return", order=["timestamp"]).collect()


def test_checks_fail_closed(spark):
    pdf = random_bars(5, symbols=("a",))
    dup = frame(spark, pd.concat([pdf, pdf.iloc[:1]]))
    with pytest.raises(ValueError, match="duplicate_key"):
        Q.require(Q.check_keys(dup, ["symbol", "timestamp"]))
    bad = pdf.copy()
    bad.loc[2, "high"] = 1.0
    found = {r["check"]: r.violations for r in Q.count_where(frame(spark, bad), Q.ohlc_checks()).collect()}
    assert found["high_too_low"] == 1 and found["not_positive"] == 0
    with pytest.raises(ValueError):
        V.guard_columns(["rsi14", "future_return_4h_pct"], E.BLOCKED_PATTERNS)
    with pytest.raises(Exception, match="unknown category"):
        spark.createDataFrame([("XX",)], ["c"]).select(V.codes(F.col("c"), {"HH": 1})).collect()


def test_snapshot_merge_rejects_disagreement(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], ["decision_at", "x"])
    b = spark.createDataFrame([(1, 1.0, 5), (2, 2.0, 6)], ["decision_at", "x", "y"])
    assert O.merge_snapshots([a, b], ["decision_at"]).count() == 2
    for other in (b.filter("decision_at = 1"), b.withColumn("x", F.lit(9.0))):
        with pytest.raises(Exception, match="do not agree"):
            O.merge_snapshots([a, other], ["decision_at"]).collect()


def test_split_and_folds_keep_the_purge(spark):
    pdf = random_bars(400, symbols=("a",))[["symbol", "timestamp"]].assign(event_id=lambda d: d.index.astype(str))
    pdf["known_at"] = pdf.timestamp + pd.Timedelta(hours=1)
    pdf["label_available_at"] = pdf.known_at + pd.Timedelta(hours=12)
    got = H.chrono_split(frame(spark, pdf)).toPandas()
    ends = got.groupby("split").timestamp.agg(["min", "max"])
    assert ends.loc["validation", "min"] - ends.loc["train", "max"] > pd.Timedelta(hours=24)
    assert got[got.split == "test"].timestamp.min() == pdf.timestamp[340]
    uses = H.walk_forward(frame(spark, pdf)).toPandas()
    for _, g in uses.groupby("fold"):
        first = g[g.role == "future"].known_at.min()
        past = g[g.role == "past"]
        assert (past.known_at < first - pd.Timedelta(hours=24)).all() and (past.label_available_at < first).all()
    assert (uses[uses.role == "future"].groupby("fold").size() == 40).all()


def test_sources_refuse_bad_input(spark, tmp_path):
    mixed = spark.createDataFrame([("f", 1_704_067_200_000), ("f", 1_704_067_200_000_000)], ["file", "t"])
    with pytest.raises(Exception, match="mixed epoch units"):
        C.normalise_epoch(mixed, "t", "file").collect()
    (tmp_path / "c.csv").write_text("timestamp,open,high,low,close,volume\n1704067200000,1,2,1,x,3\n")
    with pytest.raises(Exception, match="not a number"):
        C.read_candles_csv(spark, str(tmp_path / "c.csv")).collect()
    df = spark.createDataFrame([("a", "2024-01", 1)], ["symbol", "month", "x"])
    C.write_table(df, str(tmp_path / "u"), partition_by=["symbol", "month"])
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        C.write_table(df, str(tmp_path / "u"))
    with pytest.raises(FileNotFoundError):
        C.read_universe(spark, str(tmp_path / "u"), "2024-01", "2024-02")


def test_text_rules(spark):
    df = spark.createDataFrame([("Decision :  short_bias",), ("go LONG_BIAS",), ("LONG_BIAS NO_TRADE",), ("?",)], ["t"])
    assert [r[0] for r in df.select(X.parse_decision(F.col("t"))).collect()] == ["SHORT_BIAS", "LONG_BIAS", "INVALID", "INVALID"]
    n = spark.createDataFrame([(0.00042, 101.5, 100.0)], ["a", "b", "c"])
    assert list(n.select(X.number_text(F.col("a"), 5), X.number_text(F.col("b"), 2), X.number_text(F.col("c"), 2)).collect()[0]) == ["0.00042", "101.5", "100.0"]
    raw = ['{"action":"WAIT"}', '{"action":"OPEN_LONG","sl":1,"tp":"2"}', '{"action":"WAIT","action":"HOLD"}', "x", '{"action":"MOVE_SL","sl":NaN}', "[1]"]
    got = S.screen_actions(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], ["i", "raw"]), "raw").orderBy("i").collect()
    assert [r.contract for r in got] == ["VALID", "NUMBER", "NOT_ONE_OBJECT", "NOT_ONE_OBJECT", "NOT_ONE_OBJECT", "NOT_ONE_OBJECT"]


def test_held_position_rules(spark):
    cols = "action string, sl double, tp double, qty double, price double, equity double, spread_bps double, liquidity double, quote_age_s double, side string, entry_price double, pos_sl double, pos_tp double"
    base = (None, 100.0, 10_000.0, 1.0, 1e6, 0.0, "LONG", 100.0, 95.0, 110.0)
    rows = [("MOVE_SL", 96.0, None, *base), ("MOVE_SL", 90.0, None, *base), ("MOVE_SL", 101.0, None, *base), ("WAIT", None, None, *base), ("CLOSE", None, None, *base)]
    got = S.screen_orders(spark.createDataFrame(rows, cols)).collect()
    assert [r.code for r in got] == ["ACCEPTED_PREVIEW", "STOP_WIDENING", "PROTECTION_CROSSES_MARKET", "ILLEGAL_TRANSITION", "ACCEPTED"]
