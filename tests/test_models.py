"""Models with little or nothing to learn from."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators import models as M
from barloom.operators import stats as T

FEATURES = ["a", "b"]


def candidates(spark, n, outcomes=("SL", "TIME", "TP"), empty=()):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"event_id": [f"e{i}" for i in range(n)], "a": rng.normal(size=n), "b": rng.normal(size=n), "bias_score": rng.integers(2, 5, n)})
    pdf["side"] = [("LONG", "SHORT")[i % 2] for i in range(n)]
    pdf["event_outcome"] = [outcomes[i % len(outcomes)] for i in range(n)]
    pdf["net_return"] = 0.1 * pdf["a"] + 0.01
    kind = "event_id string, a double, b double, bias_score int, side string, event_outcome string, net_return double"
    df = spark.createDataFrame(pdf.values.tolist(), kind)
    return df.withColumns({c: M.F.lit(None).cast("double") for c in empty})


def test_without_rows_to_learn_from_ridge_predicts_null(spark):
    some = candidates(spark, 6)
    made = M.with_ridge(M.fit_ridge(some.limit(0), FEATURES), some, FEATURES)
    assert [r["ridge"] for r in made.collect()] == [None] * 6
    found = T.regression_metrics(made, "net_return", "ridge", ["side"]).collect()
    assert [(r["n"], r["mae_pct"], r["pearson"]) for r in found] == [(3, None, None)] * 2


def test_without_rows_to_learn_from_logistic_predicts_null(spark):
    some = candidates(spark, 6)
    made = M.with_probabilities(M.fit_logistic(some.limit(0), FEATURES), some, FEATURES)
    found = T.probability_metrics(made, ["side"]).collect()
    assert [(r["n"], r["log_loss"], r["brier_multiclass"], r["accuracy"]) for r in found] == [(3, None, None, None)] * 2


def test_without_rows_to_learn_from_boosted_predicts_null(spark):
    some = candidates(spark, 6)
    made = M.predicted_class(M.fit_boosted(some.limit(0), FEATURES), some, FEATURES)
    found = T.classification_report(made, "event_outcome", "predicted", labels=list(T.OUTCOMES)).collect()
    assert {(r["label"], r["support"], r["predicted"], r["invalid"]) for r in found} == {(c, 2, 0, 6) for c in T.OUTCOMES}


def test_folds_without_a_past_keep_their_rows(spark):
    rows = candidates(spark, 12)
    use = lambda df, fold, role: df.withColumns({"fold": M.F.lit(fold), "role": M.F.lit(role)})
    # fold 1 has no past, fold 2 has both, fold 3 has no rows at all
    uses = use(rows.filter("event_id < 'e3'"), 1, "future").unionByName(use(rows, 2, "past")).unionByName(use(rows.filter("event_id = 'e5'"), 2, "future"))
    found = {r["event_id"]: r for r in M.walk_forward_predictions(uses, FEATURES, folds=3).collect()}
    assert sorted(found) == ["e0", "e1", "e10", "e11", "e2", "e5"]
    first, second = found["e1"], found["e5"]
    assert (first["fold"], first["ridge"], first["p_sl"], first["prior_mean"]) == (1, None, None, None)
    assert second["fold"] == 2 and second["ridge"] is not None and second["p_sl"] + second["p_time"] + second["p_tp"] == pytest.approx(1)


@pytest.mark.parametrize("outcomes, empty", [(("TIME",), ()), (("SL", "TIME", "TP"), ("b",))])
def test_one_class_and_a_column_without_values(spark, outcomes, empty):
    past, rows = candidates(spark, 30, outcomes, empty), candidates(spark, 9)
    ridge = M.with_ridge(M.fit_ridge(past, FEATURES), rows, FEATURES).collect()
    assert all(np.isfinite(r["ridge"]) for r in ridge)
    p = M.with_probabilities(M.fit_logistic(past, FEATURES), rows, FEATURES).collect()
    assert len(p) == 9 and all(r["p_sl"] + r["p_time"] + r["p_tp"] == pytest.approx(1) for r in p)
    named = M.predicted_class(M.fit_boosted(past, FEATURES, trees=2), rows, FEATURES).collect()
    assert len(named) == 9 and {r["predicted"] for r in named} <= set(outcomes)


def test_one_row_to_learn_from(spark):
    past, rows = candidates(spark, 1), candidates(spark, 4)
    assert {round(r["ridge"], 9) for r in M.with_ridge(M.fit_ridge(past, FEATURES), rows, FEATURES).collect()} == {round(past.first()["net_return"], 9)}
    assert {r["p_sl"] for r in M.with_probabilities(M.fit_logistic(past, FEATURES), rows, FEATURES).collect()} == {1.0}
    assert {r["predicted"] for r in M.predicted_class(M.fit_boosted(past, FEATURES, trees=2), rows, FEATURES).collect()} == {"SL"}
