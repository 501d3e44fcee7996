import json

import pytest

from cuelight.functions import cut as C
from cuelight.operators import retrieval as R
from cuelight.sources.catalogue import read_catalogue
from cuelight.sources.subtitle_files import read_subtitles
from cuelight.streaming.ingest import read_lines, read_status, start_indexing

BLOCK = "{k}\n00:00:{k:02d},000 --> 00:00:{k:02d},900\nline number {k} here\n"


def test_catalogue(spark, tmp_path):
    page = {
        "Items": [
            {"Id": "b", "Name": "Boats", "Type": "Series", "ProviderIds": {"Tvdb": "7"}, "RunTimeTicks": 15_005_000},
            {"Id": "a", "Name": "Boats too", "Type": "Series", "ProviderIds": {"Tvdb": "7", "Imdb": "tt1"}},
            {"Id": "c", "Name": "Boats", "Type": "Movie", "ProviderIds": {"Tvdb": "7"}},
            {"Id": "d", "Name": "apples", "Type": "Movie"},
            {"Id": "e", "Name": "apples", "Type": "Folder"},
        ]
    }
    (tmp_path / "0.json").write_text(json.dumps(page))
    (tmp_path / "1.json").write_text(json.dumps({"Items": None}))
    got = read_catalogue(spark, str(tmp_path)).collect()
    assert [r.id for r in got] == ["d", "c", "a"]
    assert [r.id for r in read_catalogue(spark, str(tmp_path), term="BOAT").collect()] == ["c", "a"]


def test_indexing_is_incremental_and_repeats_nothing(spark, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    (files / "v1.srt").write_text("\n".join(BLOCK.format(k=k) for k in range(1, 6)))
    (files / "v2.vtt").write_text("WEBVTT\n\n" + BLOCK.format(k=1))
    (files / "v3.srt").write_text("nothing")
    (files / "v4.txt").write_text(BLOCK.format(k=1))
    assert {r.video_id for r in read_subtitles(spark, str(files)).collect()} == {"v1", "v2", "v3"}
    titles = spark.createDataFrame([(f"v{k}", "t") for k in range(1, 6)], "video_id string, title_id string")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        start_indexing(spark, str(files), titles, out, check, dim=16).awaitTermination()
        return {r.video_id: r["count"] for r in read_lines(spark, out).groupBy("video_id").count().collect()}

    first = run()
    assert first == {"v1": 1, "v2": 1}
    ids = {r.line_id for r in read_lines(spark, out).collect()}
    assert run() == first
    (files / "v5.srt").write_text(BLOCK.format(k=2))
    assert run() == first | {"v5": 1}
    assert ids < {r.line_id for r in read_lines(spark, out).collect()}
    status = {r.video_id: r.status for r in read_status(spark, out).collect()}
    assert status == {"v1": "ok", "v2": "ok", "v3": "none", "v5": "ok"}


def test_batch_search_in_blocks_is_the_search(spark, small):
    from cuelight.plans import views

    lines = views.vectors(spark, small)
    queries = lines.where("line_id % 9 = 0").selectExpr("line_id as query_id", "embedding")
    one = sorted(map(tuple, R.knn_batch(lines, queries, 7).select("query_id", "line_id", "rank").collect()))
    many = sorted(map(tuple, R.knn_batch(lines, queries, 7, block=3).select("query_id", "line_id", "rank").collect()))
    assert one == many and len(one) == 7 * queries.count()


def test_distinct_moments(spark):
    rows = [(1, k, k, "v", t) for k, t in enumerate([0, 19_999, 20_000, 5_000, 60_000, 41_000])] + [(1, 9, 9, "w", 0), (2, 0, 5, None, 3)]
    df = spark.createDataFrame(rows, "query_id long, pos int, line_id long, video_id string, start_ms long")
    got = [(r.query_id, r.line_id) for r in R.distinct_moments(df, 3).orderBy("query_id", "place").collect()]
    assert got == [(1, 0), (1, 2), (1, 4), (2, 5)]
    assert R.distinct_moments(df.limit(0), 3).count() == 0


@pytest.mark.parametrize("size, want", [(None, 1.0), (float("nan"), 1.0), (9.0, 3.0), (0.1, 0.5), (float("inf"), 1.0), (2.0, 2.0)])
def test_caption_size(spark, size, want):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(size,)], "s double")
    assert df.select(C.caption_size(F.col("s"))).first()[0] == want
