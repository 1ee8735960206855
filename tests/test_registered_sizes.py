import pytest

from solvara.plans import catalogue


class Asked(Exception):
    pass


def test_model_queries_take_the_operators_sizes(monkeypatch):
    def stop(*_, **options):
        raise Asked(options)

    monkeypatch.setattr(catalogue, "_fitted", lambda spark, folder, fit: (fit(None), None))
    monkeypatch.setattr(catalogue.boosting, "fit", stop)
    monkeypatch.setattr(catalogue.logit, "fit", lambda *_: None)
    monkeypatch.setattr(catalogue.models, "sampled_shapley", stop)
    for name in ("m4_boosted_trees", "m13_sampled_shapley"):
        with pytest.raises(Asked) as asked:
            catalogue.QUERIES[name](None, "")
        assert asked.value.args == ({},)
