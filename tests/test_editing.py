from pyspark.sql import functions as F

from cuelight.operators import editing as E


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def arr(*xs):
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<int>")


def test_lists(spark):
    assert value(spark, E.insert_at(arr(1, 2), F.lit(9), F.lit(3))) == [1, 2, 3]
    assert value(spark, E.insert_at(arr(), F.lit(-2), F.lit(3))) == [3]
    assert value(spark, E.swap_neighbours(arr(1, 2, 3), F.lit(1))) == [1, 3, 2]
    assert value(spark, E.swap_neighbours(arr(1), F.lit(0))) == [1]


def test_edits(spark):
    edits = F.create_map(*map(F.lit, ("20", "b", "10", "a")))
    assert value(spark, E.canonical_edits(edits)) == '{"10":"a","20":"b"}'
    assert value(spark, E.canonical_edits(F.create_map(F.lit("1"), F.lit("x" * 301)))) is None
    assert value(spark, E.keep_real_edits(edits, F.create_map(F.lit("10"), F.lit("a")))) == {"20": "b"}


def test_failures_tell_no_secrets(spark):
    report = "\n".join(f"line {k}" for k in range(9)) + "\n\nGET /x?API_KEY=abc&t=1 'x-emby-token=q' failed\n"
    assert value(spark, E.explain_failure(F.lit(report))) == "line 4\nline 5\nline 6\nline 7\nline 8\nGET /x?API_KEY=REDACTED&t=1 'x-emby-token=REDACTED' failed"
    assert value(spark, E.explain_failure(F.lit(None).cast("string"))) == ""


def test_failure_classes(spark):
    rows = [
        ("http error 401 UNAUTHORIZED, timed out", None, "unauthorised"), ("tcp: Connection timed out", None, "late"), ("Server returned 403 Forbidden", "", "gone"), ("404 not found", None, "gone"),
        ("Failed to resolve hostname x", None, "unreachable"), ("/tmp/a: No such file or directory", None, "file_missing"), ("Fontconfig error", None, "no_font"), ("strange", None, "other"),
        ("", None, None), (None, "SIGSEGV", "crash"), ("timed out", "SIGKILL", "killed"),
    ]
    df = spark.createDataFrame(rows, "report string, signal string, want string")
    got = df.select("want", E.failure_class(F.col("report"), F.col("signal")).alias("kind"), E.explain_failure(F.col("report"), F.col("signal")).alias("words")).collect()
    assert [r.kind for r in got] == [r.want for r in got]
    assert got[-1].words == "The encoder was killed by SIGKILL before it finished." and got[7].words == "strange" and "401" in got[0].words and "resolve names" in got[9].words


def test_upkeep_of_edits_and_captions(spark):
    edits = F.create_map(*map(F.lit, ("20", "b", "10", "a", "99", "out of view")))
    shown = F.array(*map(F.lit, ("10", "20", "30")))
    assert value(spark, E.changed_lines(edits, shown)) == 2 and value(spark, E.put_back(edits, shown)) == {"99": "out of view"}
    caption = F.struct(F.lit("custom").alias("mode"), F.lit("mine").alias("text"), F.lit("big").alias("look"), edits.alias("lines"))
    clips = value(spark, E.clear_overrides(F.array(F.struct(F.lit(1).alias("id"), caption.alias("caption")))))
    assert (clips[0].id, clips[0].caption.mode, clips[0].caption.text, clips[0].caption.look, len(clips[0].caption.lines)) == (1, "inherit", "", None, 3)
