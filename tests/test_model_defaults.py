"""Model operators and the registered queries run at full size."""

import inspect

from ledgerlens.operators import models


def default(function, name):
    return inspect.signature(function).parameters[name].default


def test_rounds_and_trials(spark):
    for function in (models.learners, models.base_model_scores, models.focal_second_pass, models.fit_stack):
        assert default(function, "rounds") == 100
    assert models.ROUNDS == 100 and default(models.ablation, "rounds") == 50
    assert default(models.tune, "trials") == 20 and default(models.tune, "rounds") == (50, 100)
    assert {x.getMaxIter() for x in models.learners().values()} == {100}
