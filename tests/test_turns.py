"""Zigzags over many chunks equal one pass, and need few rounds."""

import numpy as np
import pandas as pd
from helpers import bars_from, frame, random_bars
from pyspark.sql import functions as F

from barloom.operators import structure as ST
from barloom.operators.bars import HOUR
from barloom.plans import turns
from barloom.plans.blocks import with_position


def placed(spark, pdf):
    return with_position(frame(spark, pdf), keys=["symbol"], ts="timestamp", step=HOUR, reset=False)


def pct(spark, pdf, size, by):
    got = ST.zigzag_pct(placed(spark, pdf), series=["symbol"], pct=by, size=size).toPandas()
    return got.sort_values(["symbol", "confirmation_at"]).reset_index(drop=True)


def atr(spark, pdf, size, by):
    got = ST.zigzag_atr(frame(spark, pdf), HOUR, size=size, reversal_atr=by).toPandas()
    return got.sort_values(["symbol", "timestamp"]).reset_index(drop=True)


def mixed(seed):
    """A walk with ties, a long search in a flat part, a trend, and bars without range."""
    rng = np.random.default_rng(seed)
    moves = np.concatenate((rng.normal(0, 0.05, 60), rng.normal(0, 2, 150), np.full(60, 1.5), rng.normal(0, 2, 100), np.full(50, -1.0)))
    close = np.round(np.maximum(200 + np.cumsum(moves), 20), 0)
    high, low = close + rng.integers(0, 3, len(close)), close - rng.integers(0, 3, len(close))
    flat = bars_from(close.tolist(), close.tolist(), close.tolist())
    made = bars_from(high.tolist(), low.tolist(), close.tolist())
    return pd.concat((made, flat.assign(symbol="b")), ignore_index=True)


def test_zigzag_in_chunks_equals_one_pass(spark):
    pdf = mixed(1)
    assert len(pct(spark, pdf, 4096, 2.0)) > 20
    for by, size in ((2.0, 17), (12.0, 23)):
        pd.testing.assert_frame_equal(pct(spark, pdf, size, by), pct(spark, pdf, 4096, by))
    for by, size in ((2.0, 17), (9.0, 23)):
        pd.testing.assert_frame_equal(atr(spark, pdf, size, by), atr(spark, pdf, 4096, by))


def test_gaps_restart_and_many_series(spark):
    pdf = random_bars(150, symbols=("a", "b", "c"), gaps=(40, 41, 90))
    pd.testing.assert_frame_equal(atr(spark, pdf, 20, 2.0), atr(spark, pdf, 4096, 2.0))


def test_a_trend_takes_rounds_by_the_logarithm_of_its_chunks(spark, monkeypatch):
    made = []
    write = turns.materialise
    monkeypatch.setattr(turns, "materialise", lambda df, name: made.append(write(df, name)) or made[-1])
    n = 320
    up = [100.0 + i for i in range(n)]
    pdf = bars_from(up, up, up)
    got = pct(spark, pdf, 5, 1.0)
    assert got.empty and len(made) <= 3 + np.ceil(np.log2(n / 5))
    # a trend is one piece for each side
    assert made[-1].agg(F.max(F.size("up") + F.size("down"))).first()[0] <= 4
    fallen = bars_from([*up, 50.0], [*up, 50.0], [*up, 50.0])
    got = pct(spark, fallen, 5, 1.0)
    assert got.kind.tolist() == ["HIGH"] and got.price.tolist() == [up[-1]]


def test_pieces_say_what_a_walk_finds():
    rng = np.random.default_rng(3)
    for turn_first in (True, False):
        for _ in range(60):
            n = int(rng.integers(1, 25))
            close = rng.integers(90, 110, n).astype(float)
            high, low = close + rng.integers(0, 4, n), close - rng.integers(0, 4, n)
            gap = rng.integers(1, 9, n)
            rise, fall = high - gap, low + gap
            height, closes, limit, reached = turns.exits(high, low, close, rise, fall, turn_first)
            for s in (0, 1):
                table = turns.pieces(height[s], closes[s], reached[s], reached[1 - s], turn_first)
                assert all(a[2] != b[2] for a, b in zip(table, table[1:]))
                for x in range(85, 115):
                    for width in (1, 5, 12):
                        state = (s, (2 * (s == 0) - 1) * x, (2 * (s == 0) - 1) * x - width, None)
                        for i in range(n):
                            side, top, thr, _ = state
                            turn, beyond = closes[side][i] <= thr, height[side][i] > top
                            if turn and (turn_first or not beyond):
                                side = 1 - side
                            elif not beyond:
                                continue
                            state = (side, height[side][i], limit[side][i], (side, i))
                        x0 = (2 * (s == 0) - 1) * x
                        met = next((p[2] for p in table if x0 < p[0] or x0 - width >= p[1]), None)
                        assert met == state[3]


def test_no_bars_and_no_direction(spark):
    pdf = bars_from([100.0] * 30, [100.0] * 30, [100.0] * 30)
    assert pct(spark, pdf, 4, 1.0).empty
    nothing = placed(spark, pdf).where(F.lit(False))
    assert ST.zigzag_pct(nothing, series=["symbol"], pct=1.0, size=4).count() == 0
    assert (atr(spark, pdf, 4, 2.0).zz_direction == "SEEK").all()
