import pytest
from pyspark.sql import functions as F

from cuelight.operators import serving as S


def test_guards(spark):
    titles = spark.createDataFrame([("a", 0), ("b", 3)], "id string, line_count long")
    S.require_indexed(titles)
    S.require_indexed(titles, "b")
    with pytest.raises(S.NotIndexed):
        S.require_indexed(titles, "a")
    with pytest.raises(S.NoSuchItem):
        S.require_indexed(titles, "c")
    with pytest.raises(S.NotIndexed):
        S.require_indexed(titles.limit(0))
    with pytest.raises(S.NoSuchItem):
        S.get_item(titles, "zz")
    assert S.get_item(titles, "b").first().line_count == 3
    assert [S.limit_of(x) for x in (None, 3, 99)] == [8, 3, 25] and S.limit_of(None, S.CLIP_LIMIT) == 6


def test_texts(spark):
    df = spark.createDataFrame([(0, "0 B"), (1023, "1023 B"), (1536, "1.5 KB"), (5 << 20, "5.0 MB"), (3 << 30, "3.0 GB")], "n long, want string")
    assert df.where(S.size_text(F.col("n")) != F.col("want")).count() == 0
    url = spark.range(1).select(S.segment_url(F.lit("http://x//"), F.lit("a b"), F.lit("s"), F.lit(5), F.lit(100))).first()[0]
    assert url == "http://x/Videos/a+b/stream?mediaSourceId=s&startTimeTicks=5&maxWidth=100&videoBitRate=1500000&allowVideoStreamCopy=false"


def test_addresses(spark):
    base, none = F.lit("http://x/m//"), F.lit(None).cast("string")
    r = spark.range(1).select(
        S.stream_url(base, F.lit("a/b"), none, F.lit("k y")).alias("stream"), S.preview_url(base, F.lit("v"), F.lit(1500), F.lit("k"), audio=F.lit(None).cast("int")).alias("preview"),
        S.preview_url(base, F.lit("v"), F.lit(0), F.lit("k"), 320, F.lit(2), "d").alias("heard"), S.image_url(base, F.lit("i"), F.lit("k")).alias("image"),
    ).first()
    assert r.stream == "http://x/m/Videos/a%2Fb/stream?static=true&ApiKey=k+y" and r.image == "http://x/m/Items/i/Images/Primary?maxHeight=400&ApiKey=k"
    fixed = "static=false&container=mp4&videoCodec=h264&audioCodec=aac&allowVideoStreamCopy=true&allowAudioStreamCopy=true&enableAutoStreamCopy=true"
    assert r.preview == f"http://x/m/Videos/v/stream.mp4?{fixed}&maxWidth=640&startTimeTicks=15000000&deviceId=preview&ApiKey=k"
    assert r.heard == f"http://x/m/Videos/v/stream.mp4?{fixed}&maxWidth=320&startTimeTicks=0&deviceId=d&AudioStreamIndex=2&ApiKey=k"


def test_settings(monkeypatch):
    monkeypatch.setenv("SERVER", "http://e/")
    assert S.setting({}, "server", "SERVER") == "http://e" and S.setting({"server": "http://s//"}, "server", "SERVER") == "http://s"
    monkeypatch.delenv("SERVER")
    assert S.setting({}, "server", "SERVER") is None
