"""The guided sampler on functions whose best setting is known."""

import math
import random

import pytest

from quillmark.operators import models, tuning


def bowl(p):
    """Best at depth 7, learning rate 0.05, 700 iterations; 0 there."""
    return -(((p["depth"] - 7) / 6) ** 2 + (math.log(p["learning_rate"] / 0.05) / math.log(30)) ** 2 + ((p["iterations"] - 700) / 800) ** 2)


def test_guided_trials_beat_random_ones():
    space = models.space_of("catboost")
    guided = [tuning.study(space, bowl, 40, seed=s)[0][1] for s in range(20)]
    drawn = [tuning.study(space, bowl, 40, seed=s, startup=40)[0][1] for s in range(20)]
    assert sum(guided) > 0.6 * sum(drawn)  # both below 0: at most 0.6 of the distance is left
    batches = [tuning.study(space, bowl, 40, batch=4, seed=s)[0][1] for s in range(20)]
    assert sum(batches) > sum(drawn)


def test_choices_and_ranges():
    space = {"a": ("choice", "x", "y"), "b": ("int", 3, 5), "c": ("log", 1e-3, 1.0), "d": ("float", -1.0, 1.0)}
    found = tuning.study(space, lambda p: (p["a"] == "y") - p["d"], 60, seed=1)
    assert [s for _, s in found] == sorted((s for _, s in found), reverse=True) and len(found) == 60
    assert all(p["b"] in (3, 4, 5) and 1e-3 <= p["c"] <= 1 and -1 <= p["d"] <= 1 for p, _ in found)
    assert found[0][0]["a"] == "y" and found[0][0]["d"] < -0.8
    late = [p["a"] for p, _ in found[:30]]
    assert late.count("y") > 20


def test_same_seed_same_study():
    space = models.space_of("xgboost")
    score = lambda p: p["eta"]
    assert tuning.study(space, score, 15, seed=3) == tuning.study(space, score, 15, seed=3) != tuning.study(space, score, 15, seed=4)


def test_density_is_one_over_its_interval():
    rng = random.Random(0)
    density = tuning.Density([rng.uniform(0, 2) for _ in range(7)], 0.0, 2.0)
    steps = 20_000
    area = sum(density(2 * (i + 0.5) / steps) for i in range(steps)) * 2 / steps / math.sqrt(2 * math.pi)
    assert area == pytest.approx(1, abs=1e-3)
    assert all(0 <= density.draw(rng) <= 2 for _ in range(200))


def test_unknown_model():
    with pytest.raises(ValueError, match="no search space"):
        models.space_of("svm")
    assert models.laid_out("mlp", {"n_layers": 2, "n_units": 64, "epochs": 30}) == {"hidden_layers": [64, 64], "epochs": 30}
