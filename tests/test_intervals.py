"""Range and nearest-point joins against all pairs."""

import random

import pytest

from cuelight.operators import intervals as I


@pytest.fixture
def table(spark):
    """Intervals of all lengths, one over everything, some with swapped or missing ends; a video with most of them."""
    rng = random.Random(6)
    rows = []
    for k in range(500):
        start = rng.randint(-5000, 400_000)
        rows.append((rng.choice(["v", "v", "v", "w", None]), start, start + rng.choice([0, 1, 900, 5000, 70_000]), k, f"t{k}"))
    rows += [("v", 0, 50_000_000, 900, "long"), ("w", 9000, 4000, 901, "swapped"), ("w", None, 10, 902, "open"), ("w", 10, None, 903, "open")]
    marks = []
    for k in range(80):
        lo = rng.randint(-10_000, 420_000)
        marks.append((rng.choice(["v", "w", "x", None]), k, lo, lo + rng.choice([0, 1000, 30_000, -5])))
    return rows, marks


@pytest.mark.parametrize("stretch", [500, 60_000])
def test_near_intervals(spark, table, stretch):
    rows, marks = table
    want = {}
    for video, k, lo, hi in marks:
        near = [(*sorted((a, b)), n) for v, a, b, n, _ in rows if v is not None and v == video and a is not None and b is not None and min(a, b) <= hi and max(a, b) >= lo and lo <= hi]
        want[k] = sorted(n for _, _, n in near)
    df = spark.createDataFrame(rows, "video_id string, start_ms long, end_ms long, cue int, text string")
    m = spark.createDataFrame(marks, "video_id string, cue int, lo long, hi long").selectExpr("*", "'clash' as text")
    got = I.with_near(m, df, ["cue"], "cues", stretch_ms=stretch).collect()
    assert {r.cue: sorted(c.cue for c in r.cues) for r in got} == want
    assert all(r.text == "clash" and [(c.start_ms, c.end_ms, c.cue) for c in r.cues] == sorted((c.start_ms, c.end_ms, c.cue) for c in r.cues) for r in got)
    assert all(c.text == ("swapped" if c.cue == 901 else "long" if c.cue == 900 else f"t{c.cue}") for r in got for c in r.cues)
    assert len(got) == len(marks) and any(len(v) > 3 for v in want.values())
    assert all(r.cues == [] for r in I.with_near(m, df.limit(0), ["cue"], "cues", stretch_ms=stretch).collect())


@pytest.mark.parametrize("stretch", [100, 60_000])
def test_first_point_past_a_mark(spark, table, stretch):
    rows, marks = table
    points = [(v, a) for v, a, *_ in rows if a is None or a < 50_000 or a > 390_000]  # a gap of many stretches
    df = spark.createDataFrame(points, "video_id string, p long")
    m = spark.createDataFrame(marks, "video_id string, k int, at long, other long")
    for before in (False, True):
        got = {r.k: (r.at, r.found) for r in I.first_past(m, df, ["k"], "at", "found", stretch_ms=stretch, before=before).collect()}
        for video, k, at, _ in marks:
            of = [p for v, p in points if v is not None and v == video and p is not None and (p < at if before else p > at)]
            assert got[k] == (at, (max if before else min)(of, default=None))
