"""The registered forest queries train forests of the operator's default size."""

import time

from modelwatch.catalog import load
from modelwatch.operators import model

SF = "/root/testdata/sf0.01"


def test_registered_forests_have_the_default_size(spark, monkeypatch):
    sizes, fit = [], model.fit_forest

    def seen(rows, features, **options):
        sizes.append((options.get("num_trees", 100), options.get("max_depth", 10)))
        return fit(rows, features, **options)

    monkeypatch.setattr(model, "fit_forest", seen)
    for name, n_rows in (("rf_replay", 2), ("feature_importance", 5)):
        began = time.time()
        assert load().QUERIES[name](spark, SF).count() == n_rows
        print(name, round(time.time() - began, 1), "s")
    assert sizes == [(100, 10)] * 3
