from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cuelight import schemas
from cuelight.operators.subtitles import dialogue_windows, parse_subtitles

SRT = """1
00:00:01,000 --> 00:00:03,500
<i>- Where did you put it?</i>
- {\\an8}Under the stairs.

2
00:00:04,00 --> 00:00:05,000
[door slams]

3
00:01:00,000 --> 00:01:02,000
NURSE: (quietly) He left ♪ at noon.

4
00:00:10,500 --> 00:00:09,000
Backwards.

5
00:00:08,5 --> 00:00:09,250
STOP RIGHT THERE
"""


def test_parse(spark):
    files = spark.createDataFrame(
        [("a", "﻿" + SRT.replace("\n", "\r\n")), ("b", "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nhello there\n\n00:03.000 --> 00:04.000\nno hours"), ("c", ""), ("d", None)],
        schemas.SUBTITLE_FILE,
    )
    got = [tuple(r) for r in parse_subtitles(files).orderBy("video_id", "cue").collect()]
    assert got == [
        ("a", 0, 1000, 3500, "Where did you put it? Under the stairs."),
        ("a", 1, 60_000, 62_000, "He left at noon."),
        ("b", 0, 1000, 2000, "hello there"),
    ]


def windows_of(cues, duration=14_000, gap=3_000, most=6, stride=2):
    """The windows as they are defined, one cue after the other."""
    out, i = [], 0
    while i < len(cues):
        j = i
        while j + 1 < len(cues) and j + 1 < i + most and cues[j + 1][0] - cues[j][1] <= gap and cues[j + 1][1] - cues[i][0] <= duration:
            j += 1
        out.append((cues[i][0], cues[j][1], i, j))
        if j == len(cues) - 1:
            break
        i = min(i + stride, j + 1)
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(st.integers(0, 5000), st.integers(1, 6000)), max_size=14), min_size=1, max_size=8), st.integers(1, 4))
def test_windows(spark, steps, stride):
    videos = {}
    for k, video in enumerate(steps):
        at, cues = 0, []
        for pause, length in video:
            at += pause
            cues.append((at, at + length))
            at += length // 2
        videos[str(k)] = cues
    rows = [(v, k, s, e, f"t{k}") for v, cues in videos.items() for k, (s, e) in enumerate(cues)]
    got = {v: [] for v in videos}
    for r in dialogue_windows(spark.createDataFrame(rows, schemas.CUE), stride=stride).orderBy("video_id", "first_cue").collect():
        assert r.text == " ".join(f"t{k}" for k in range(r.first_cue, r.last_cue + 1))
        got[r.video_id].append((r.start_ms, r.end_ms, r.first_cue, r.last_cue))
    for v, cues in videos.items():
        assert got[v] == windows_of(cues, stride=stride)
