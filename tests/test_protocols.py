"""Registered protocols do their whole job, on the smallest given tables."""

import os

import pytest
from pyspark.sql import functions as F

from hosttrace.checks import learning
from hosttrace.operators import models

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables not present")


def test_platform_leak_ends_by_its_rule(spark, monkeypatch):
    """Features go until platforms are told apart no better than by guessing, or six are left; not after some steps."""
    small, important = models.small_forest, models.impurity_importance
    monkeypatch.setattr(models, "small_forest", lambda: small(2, 4))
    # What tells platforms apart is kept to the last, so it takes many steps.
    monkeypatch.setattr(models, "impurity_importance", lambda *model: important(*model)[::-1])
    steps = sorted(learning.m32(spark, SF_DIR).collect(), key=lambda r: -r.n_features)
    _, test = learning._split(spark, SF_DIR)
    share = test.agg(F.avg((F.col("platform") == "windows").cast("int"))).first()[0]
    guess = max(share, 1 - share) + 0.03
    assert all(r.platform_accuracy > guess for r in steps[:-1])
    assert steps[-1].platform_accuracy <= guess or steps[-1].n_features == 6
    assert len(steps) > 8 and [r.n_features for r in steps] == list(range(32, 32 - len(steps), -1))
