import copy

import numpy as np
import pytest

from foldline.operators import training
from foldline.operators.network import Model


def table(spark, n=300):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((n, 10))
    y = np.tanh(x @ rng.standard_normal((10, 10)) / 3)
    return spark.createDataFrame([(k, "val" if k % 5 == 0 else "train", x[k].tolist(), y[k].tolist()) for k in range(n)], "id long, split string, x array<double>, y array<double>")


@pytest.mark.parametrize("quantizer", ["fsq", "vq"])
def test_the_same_curve_on_one_and_four_tasks(spark, quantizer):
    from foldline.operators.network import QUANTIZERS

    kind = quantizer if quantizer in QUANTIZERS else next(q for q in QUANTIZERS if q != "fsq")
    examples, logs, models = table(spark), [], []
    first = Model.fresh(seed=4, quantizer=kind)
    for tasks in (1, 4):
        models.append(copy.deepcopy(first))
        logs.append(training.train_table(models[-1], examples, tasks, epochs=4, batch=48, lr=0.02, seed=9))
    for a, b in zip(*logs, strict=True):
        assert a["train_loss"] == pytest.approx(b["train_loss"], rel=1e-6) and a["val_loss"] == pytest.approx(b["val_loss"], rel=1e-6)
    assert logs[0][-1]["train_loss"] < logs[0][0]["train_loss"]
    for a, b in zip(models[0].encoder.weights + models[0].decoder.weights, models[1].encoder.weights + models[1].decoder.weights):
        np.testing.assert_allclose(a, b, rtol=1e-5, atol=1e-8)


def test_batches_hold_the_same_rows_however_they_lie():
    ids = np.arange(-500, 1500)
    whole = training.batch_of(ids, 3, 1, 7)
    assert (training.batch_of(ids[::-1], 3, 1, 7) == whole[::-1]).all() and (training.batch_of(ids, 3, 2, 7) != whole).any()
    assert np.bincount(whole).min() > 200


def test_too_few_rows(spark):
    with pytest.raises(ValueError):
        training.train_table(Model.fresh(), table(spark, 20), 2, batch=64)
