"""Bands of the tolerance join: no allowed pair is lost, and few others meet."""

import math
import random

from plumbline.operators import grading as G


def near(g, p):
    return g == p or (
        math.isfinite(g) and math.isfinite(p) and abs(g - p) <= 2 * max(1e-2, 1e-9 * max(abs(g), abs(p)))
    )


def frame(spark, name, rows):
    schema = f"k int, {name} int, {name}_low double, {name}_high double"
    return spark.createDataFrame([(0, i, a, b) for i, (a, b) in enumerate(rows)], schema)


def test_no_near_pair_is_lost_at_the_edges(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 0.022, -0.022, 1e7, 1e7 - 0.02, 1e7 + 0.02, 1e308, -1e308, 5e-324, math.inf, -math.inf]
    for _ in range(300):
        value = rng.choice([-1, 1]) * 10 ** rng.uniform(-3, 16)
        width = 2 * max(1e-2, 1e-9 * abs(value))
        # At the tolerance, just within, just beyond, and at both sides of a band's edge.
        values += [value, value + width, value - width, value + width * 0.999, value - width * 1.001]
        edge = round(value / 0.022) * 0.022
        values += [edge, math.nextafter(edge, math.inf), edge - 0.02, edge + 0.02]
    gold = [(v, v) for v in values]
    pred = [(v, v) for v in values]
    met = G._met(frame(spark, "g", gold), frame(spark, "p", pred), ["k"]).select("g", "p").collect()
    found = {(r.g, r.p) for r in met}
    assert len(found) == len(met)
    want = {(i, j) for i, a in enumerate(values) for j, b in enumerate(values) if near(a, b)}
    assert want <= found
    # Those that meet beyond the tolerance are within three bands of it.
    assert all(abs(values[i] - values[j]) <= 3.3 * 2 * max(1e-2, 1.1e-9 * abs(values[i])) for i, j in found - want)


def test_many_columns_meet_few(spark):
    rng = random.Random(2)
    gold = [(rng.uniform(0, 1000), rng.uniform(1e6, 1e9)) for _ in range(400)]
    pred = [(a + 0.001, b * (1 + 1e-10)) for a, b in gold[:200]] + [(rng.uniform(0, 1000), rng.uniform(1e6, 1e9)) for _ in range(200)]
    met = {(r.g, r.p) for r in G._met(frame(spark, "g", gold), frame(spark, "p", pred), ["k"]).collect()}
    assert {(i, i) for i in range(200)} <= met and len(met) < 1000
    same_low = [(0.0, b) for _, b in gold]
    met = G._met(frame(spark, "g", same_low), frame(spark, "p", same_low), ["k"]).count()
    assert 400 <= met < 2000
