"""Commits of an index: what a reader sees when a batch breaks off, is done twice, is cancelled or compacted."""

import datetime

import pytest
from pyspark.sql import functions as F

from cuelight.operators import postings as P
from cuelight.streaming import ingest as I

BLOCK = "1\n00:00:01,000 --> 00:00:02,900\n{text}\n"


def files(spark, **bodies):
    at = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(v, None if b is None else BLOCK.format(text=b) if b else "", at) for v, b in bodies.items()], "video_id string, body string, modificationTime timestamp")


def said(spark, out):
    return {r.video_id: r.text for r in I.read_lines(spark, out).collect()}


@pytest.fixture
def titles(spark):
    return spark.createDataFrame([(f"v{k}", "t") for k in range(1, 9)], "video_id string, title_id string")


def test_a_batch_that_breaks_off_is_not_seen(spark, titles, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    I.index_batch(files(spark, v1="the old kettle", v2="a second one"), titles, out, 8)
    before = said(spark, out)
    assert before == {"v1": "the old kettle", "v2": "a second one"}

    def broken(*_):
        raise OSError("lost")

    # lines, postings and statuses are written, and the batch breaks off before its row of commits
    monkeypatch.setattr(I.C, "commit", broken)
    with pytest.raises(OSError):
        I.index_batch(files(spark, v1="a new lamp", v2=None), titles, out, 8)
    monkeypatch.undo()
    assert said(spark, out) == before
    assert {r.video_id: r.status for r in I.read_status(spark, out).collect()} == {"v1": "ok", "v2": "ok"}
    # or between lines and statuses
    monkeypatch.setattr(I.P, "write_postings", broken)
    with pytest.raises(OSError):
        I.index_batch(files(spark, v1="a new lamp"), titles, out, 8)
    monkeypatch.undo()
    assert said(spark, out) == before
    # the number of what broke off is written over
    I.index_batch(files(spark, v1="a new lamp", v2=None, v3=""), titles, out, 8)
    assert said(spark, out) == {"v1": "a new lamp"}
    assert {r.video_id: (r.status, r.note) for r in I.read_status(spark, out).collect()} == {"v1": ("ok", None), "v2": ("none", I.NO_TRACK), "v3": ("none", I.EMPTY_TRACK)}
    lines = I.read_lines(spark, out)
    plain = lambda df: sorted(map(str, df.select("video_id", "line_id", "len", "term", "stem", "places").collect()))
    assert plain(I.read_postings(spark, out)) == plain(P.build_postings(lines))
    assert P.corpus_of(I.read_sizes(spark, out)).first() == P.corpus_of(P.build_sizes(lines)).first()
    terms = spark.createDataFrame([("lamps",), ("kettle",)], "term string")
    assert [(r.term, r.tf) for r in P.hits_of(I.read_postings(spark, out, terms), terms).collect()] == [("lamps", 1)]
    I.compact(spark, out)
    assert said(spark, out) == {"v1": "a new lamp"} and I.C.commits(spark, out).count() == 1
    assert plain(I.read_postings(spark, out)) == plain(P.build_postings(lines)) and I.read_status(spark, out).count() == 3


def test_a_step_is_done_once(spark, titles, tmp_path):
    out = str(tmp_path / "out")
    I.index_batch(files(spark, v1="one"), titles, out, 8, "job", 0)
    again = I.index_batch(files(spark, v1="never read"), titles, out, 8, "job", 0)
    assert [(r.video_id, r.status) for r in again.collect()] == [("v1", "ok")]
    assert said(spark, out) == {"v1": "one"} and I.C.commits(spark, out).count() == 1
    assert I.read_status(spark, str(tmp_path / "none")).count() == 0


def test_a_cancelled_run_resumes_with_no_video_twice(spark, titles, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(1, 6):
        (folder / f"v{k}.srt").write_text(BLOCK.format(text=f"line {k}"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    whole = I.index_batch
    seen = []

    def counted(batch, *rest):
        seen.extend(r.video_id for r in batch.select("video_id").collect())
        done = whole(batch, *rest)
        if len(seen) == 4:
            I.cancel(spark, out, "job")
        return done

    monkeypatch.setattr(I, "index_batch", counted)
    run = lambda: I.run_indexing(spark, str(folder), titles, out, checkpoint, dim=8, files_per_batch=2, job="job")
    assert run() == "cancelled" and run() == "cancelled"
    assert len(said(spark, out)) == 4 and I.job_progress(spark, out, "job").first()["processed"] == 4
    I.resume(spark, out, "job")
    assert run() == "done" and run() == "done"
    assert sorted(seen) == [f"v{k}" for k in range(1, 6)] and len(said(spark, out)) == 5
    assert I.job_progress(spark, out, "job").select("indexed", "lines").first() == (5, 5)
    assert I.read_lines(spark, out).where(F.col("embedding").isNull()).count() == 0
