"""Plan patterns against pandas / numpy, with blocks far smaller than the data."""

import numpy as np
import pandas as pd
import pytest
from helpers import frame, random_bars
from pyspark.sql import functions as F

from barloom.plans.asof import Right, asof_join
from barloom.plans.blocks import BlockFrame, Ewm, span, with_position
from barloom.plans.neighbours import nearest
from barloom.plans.quantiles import quantiles
from barloom.plans.ranks import rank_by_hash, rank_by_score

HOUR = 3600


def test_positions_across_chunks_and_gaps(spark):
    pdf = random_bars(60, gaps=(7, 8, 30))
    for reset in (False, True):
        got = with_position(frame(spark, pdf), keys=["symbol"], ts="timestamp", step=HOUR, reset=reset, size=8).toPandas()
        got = got.sort_values(["symbol", "timestamp"]).reset_index(drop=True)
        for _, g in got.groupby("symbol"):
            if reset:
                run = g.timestamp.diff().ne(pd.Timedelta(hours=1)).cumsum()
                assert (g.groupby(run).cumcount() == g.pos).all()
                assert (g.groupby(run).timestamp.transform("min") == g.seg).all()
            else:
                assert g.pos.tolist() == list(range(len(g)))


def test_frames_and_averages_match_pandas_across_blocks(spark):
    pdf = random_bars(150)
    placed = with_position(frame(spark, pdf), keys=["symbol"], ts="timestamp", step=HOUR, reset=False)
    bf = BlockFrame(placed, ["symbol"], before=11, after=3, size=16)
    bf.with_columns(
        {
            "sma": bf.rolling(F.avg("close"), 10), "top": bf.rolling(F.max("high"), 10, shift=1), "next": F.lead("close", 3).over(bf.row),
            "delta": F.abs(F.col("close") - bf.lag("close")),
        }
    )
    got = bf.ewm(
        {"ema": Ewm("close", span(12)), "slow": Ewm("close", span(200)), "wilder": Ewm("delta", 1 / 14, start=1, min_periods=14)}
    ).toPandas().sort_values(["symbol", "timestamp"])
    assert len(got) == len(pdf)
    for s, g in got.groupby("symbol"):
        x = pdf[pdf.symbol == s].set_index("timestamp")
        want = {
            "sma": x.close.rolling(10).mean(), "top": x.high.rolling(10).max().shift(1), "next": x.close.shift(-3),
            "ema": x.close.ewm(span=12, adjust=False).mean(), "slow": x.close.ewm(span=200, adjust=False).mean(),
            "wilder": x.close.diff().abs().ewm(alpha=1 / 14, adjust=False, min_periods=14).mean(),
        }
        for c, w in want.items():
            np.testing.assert_allclose(g[c].to_numpy(float), w.to_numpy(float), rtol=1e-10, err_msg=c)


def test_averages_equal_one_pass_bit_by_bit(spark):
    # prices that repeat: one pass comes back to the same doubles, so rounding shows in distinct counts
    pdf = pd.concat([random_bars(60, symbols=("a",))] * 8, ignore_index=True)
    pdf["timestamp"] = pdf.timestamp.iloc[0] + pd.to_timedelta(np.arange(len(pdf)), unit="h")
    placed = with_position(frame(spark, pdf), keys=["symbol"], ts="timestamp", step=HOUR, reset=False)
    specs = {"fast": Ewm("close", 1 / 14), "slow": Ewm("close", span(200)), "seeded": Ewm("close", 1 / 14, start=14, seed="volume")}
    got = BlockFrame(placed, ["symbol"], size=50).ewm(specs).toPandas().sort_values("pos")
    for out, s in specs.items():
        want, e = [], None
        for p, (x, v) in enumerate(zip(pdf.close, pdf.volume)):
            e = (v if s.seed else x) if p == s.start else None if p < s.start else e + (x - e) * s.alpha
            want.append(e)
        assert [None if np.isnan(x) else x for x in got[out].astype(float)] == want, out


def test_scans_match_pandas_across_blocks(spark):
    pdf = random_bars(90, symbols=("a",))
    pdf["mark"] = np.where(np.arange(90) % 7 == 3, pdf.close, np.nan)
    df = with_position(frame(spark, pdf), keys=["symbol"], ts="timestamp", step=HOUR, reset=False)
    df = df.withColumn("mark", F.when(~F.isnan("mark"), F.col("mark")))
    specs = {
        "last": ("last", F.col("mark"), True), "before": ("last", F.col("mark"), False), "total": ("sum", F.col("volume"), True),
        "peak": ("max", F.col("close"), False), "two": ("last2", F.col("mark"), True),
    }
    got = BlockFrame(df, ["symbol"], size=5).scan(specs).select("*", "two.now", "two.prior").toPandas().sort_values("timestamp")
    m = pdf.mark
    same = lambda a, b: np.testing.assert_allclose(np.asarray(a, float), np.asarray(b, float))
    same(got["last"], m.ffill())
    same(got["before"], m.shift(1).ffill())
    same(got["total"], pdf.volume.cumsum())
    same(got["peak"], pdf.close.cummax().shift(1))
    same(got["now"], m.ffill())
    same(got["prior"], m.dropna().shift(1).reindex(m.index).where(m.notna()).ffill())


@pytest.mark.parametrize("tolerance", [None, 5 * HOUR])
def test_asof_matches_pandas_across_buckets(spark, tolerance):
    left = random_bars(100, gaps=(5, 50))[["symbol", "timestamp", "close"]]
    right = random_bars(30, hours=3, gaps=(4, 5, 6), seed=1)[["symbol", "timestamp", "high"]].rename(columns={"timestamp": "seen"})
    right.loc[3, "high"] = np.nan
    r = frame(spark, right).withColumn("high", F.when(~F.isnan("high"), F.col("high")))
    got = asof_join(frame(spark, left), Right(r, "seen", tolerance), left_on="timestamp", bucket=8 * HOUR).toPandas()
    tol = None if tolerance is None else pd.Timedelta(seconds=tolerance)
    want = pd.merge_asof(left.sort_values("timestamp"), right.sort_values("seen"), left_on="timestamp", right_on="seen", by="symbol", tolerance=tol)
    key = ["symbol", "timestamp"]
    got, want = got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True)
    assert got.seen.astype("datetime64[ns]").equals(want.seen.astype("datetime64[ns]"))
    np.testing.assert_allclose(got.high.to_numpy(float), want.high.to_numpy(float))


def test_quantiles_are_exact_with_ties_and_few_rows(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": ["x"] * 900 + ["y"] * 300 + ["z"], "v": np.r_[rng.normal(size=600), np.full(300, 0.5), rng.exponential(size=300), 7.0]})
    got = quantiles(spark.createDataFrame(pdf), ["g"], "v", {"a": 0.01, "b": 0.5, "c": 0.937, "d": 1.0}, buckets=8, fine=4).toPandas().set_index("g")
    for g, x in pdf.groupby("g"):
        np.testing.assert_allclose(got.loc[g, ["a", "b", "c", "d"]].to_numpy(float), np.quantile(x.v, [0.01, 0.5, 0.937, 1.0]))
        assert got.loc[g, "n"] == len(x)


def test_ranks(spark):
    pdf = random_bars(80, symbols=("a",))
    pdf["score"] = np.round(pdf.close / 10)
    got = rank_by_score(frame(spark, pdf), ["symbol"], "score", ["timestamp"]).toPandas()
    want = pdf.sort_values(["score", "timestamp"], ascending=[False, True]).reset_index(drop=True)
    assert got.sort_values("_i").timestamp.tolist() == want.timestamp.tolist()
    ids = spark.range(500).withColumn("k", F.col("id") % 2)
    r1, r2 = rank_by_hash(ids, ["k"], "id", 1).toPandas(), rank_by_hash(ids, ["k"], "id", 2).toPandas()
    assert sorted(r1[r1.k == 0]._i) == list(range(250))
    assert r1.sort_values("id")._i.tolist() != r2.sort_values("id")._i.tolist()


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    p = rng.normal(size=(300, 3))
    pdf = pd.DataFrame(p, columns=["u", "v", "w"]).assign(g=np.where(np.arange(300) % 3 == 0, "m", "n"), id=[f"i{i}" for i in range(300)])
    df = spark.createDataFrame(pdf)
    got = nearest(df, df.filter("u < 1"), ["u", "v", "w"], by=["g"], id="id", cell_rows=16).toPandas().set_index("id").distance
    for g, x in pdf.groupby("g"):
        pts = x[x.u < 1]
        d = np.sqrt(((x[["u", "v", "w"]].to_numpy()[:, None] - pts[["u", "v", "w"]].to_numpy()[None]) ** 2).sum(2))
        d[x.id.to_numpy()[:, None] == pts.id.to_numpy()[None]] = np.inf
        np.testing.assert_allclose(got.loc[x.id].to_numpy(), d.min(axis=1))


def test_nearest_neighbours_with_tied_coordinates(spark):
    from barloom.plans import neighbours

    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"u": 1.0, "v": rng.integers(0, 4, 360).astype(float), "w": rng.normal(size=360), "g": np.where(np.arange(360) < 350, "m", "n"), "id": [f"i{i}" for i in range(360)]})
    df = spark.createDataFrame(pdf)
    points = df.filter("g = 'm' OR id = 'i350'").withColumn("w", F.when(F.col("id") == "i3", F.lit(None).cast("double")).otherwise(F.col("w")))
    got = nearest(df, points, ["u", "v", "w"], by=["g"], id="id", cell_rows=4).toPandas().set_index("id").distance
    assert len(got) == 360 and np.isnan(got["i350"])
    for g, x in pdf.groupby("g"):
        pts = x[(x.id != "i3") & ((x.g == "m") | (x.id == "i350"))]
        d = np.sqrt(((x[["u", "v", "w"]].to_numpy()[:, None] - pts[["u", "v", "w"]].to_numpy()[None]) ** 2).sum(2))
        d[x.id.to_numpy()[:, None] == pts.id.to_numpy()[None]] = np.inf
        want = d.min(axis=1)
        np.testing.assert_allclose(got.loc[x.id].to_numpy(), np.where(np.isinf(want), np.nan, want))
    cells, levels = neighbours._tree(points.where("w IS NOT NULL"), ["u", "v", "w"], ["g"], "id", 4)
    assert len(levels) == 2 and cells.groupBy("g", "_cell").count().agg(F.max("count")).first()[0] <= 4
    assert all(k.agg(F.max(F.size("_kids"))).first()[0] <= neighbours.FAN for k in levels)


def test_values_of_one_row_need_no_cross_join(spark):
    from barloom.operators.sampling import quartile_periods
    from barloom.plans.quantiles import quantiles
    from barloom.plans.single import with_values

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(50).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,cast(id as int)) AS timestamp", "cast(id as double) AS x")
        frames = [with_values(df, df.agg({"x": "max"})), quartile_periods(df), quantiles(df, [], "x", {"m": 0.5})]
        for f in frames:
            plan = f._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert frames[0].select("max(x)").distinct().collect() == [(49.0,)] and frames[2].first()["m"] == 24.5
        assert [r["n"] for r in frames[1].groupBy("period").count().withColumnRenamed("count", "n").collect()] and frames[1].count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
