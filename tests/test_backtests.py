"""The walk-forward queries' folds and models."""

from strandline.operators import models
from strandline.plans import model_queries as Q


def test_boosted_folds_are_the_logistic_ones(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(models, "walk_forward", lambda df, date, features, years, make, kind: asked.append((years, make)))
    monkeypatch.setattr(models, "fold_scores", lambda *a: None)
    Q.lr_backtest(spark, "/root/testdata/sf0.001")
    Q.gbt_backtest(spark, "/root/testdata/sf0.001")
    (lr, _), (gbt, make) = asked
    assert gbt == lr == [2020, 2021]
    assert make(Q.FEATURES, 1.0).getStages()[-1].getMaxIter() == 20
