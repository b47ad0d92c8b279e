"""Numbers in texts against the language's own formatting, which rounds the exact value."""

from __future__ import annotations

import random

import pytest

from panelcycle.functions.text import number, worded

FIXED = [0.125, 0.375, 2.5, 3.5, -2.5, 0.5, -0.5, 1.5, 1.005, 2.675, 1.115, 0.045, 99.995, 0.995, 9.5, -9.95, -0.001, 0.0, -0.0, 1e-300, 5e-324, 12345678.125, -1e9, 0.1 + 0.2]


@pytest.mark.parametrize("decimals", [0, 1, 2, 3])
@pytest.mark.parametrize("signed", [False, True])
def test_numbers_round_their_exact_value(spark, decimals, signed):
    rng = random.Random(decimals)
    values = FIXED + [rng.uniform(-300, 300) for _ in range(3000)] + [rng.randint(-4000, 4000) / 16 for _ in range(2000)] + [round(rng.uniform(-9, 9), 3) for _ in range(3000)]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    told = [r.t for r in frame.selectExpr(f"{number('x', decimals, signed)} AS t").collect()]
    assert told == [f"{v:{'+' if signed else ''}.{decimals}f}" for v in values]


def test_worded_texts(spark):
    frame = spark.createDataFrame([(0.125, 2.5, "it's"), (None, 1.0, "b")], "x double, y double, w string")
    told = frame.selectExpr(worded("a %.2f%% of %+.0f: %s", "x", "y", "w") + " AS t", worded("100%% sure") + " AS u", worded("it's %s", "w") + " AS v").collect()
    assert [r.t for r in told] == ["a 0.12% of +2: it's", None] and told[0].u == "100% sure" and told[0].v == "it's it's"
    with pytest.raises(ValueError):
        worded("a %s", "x", "y")
