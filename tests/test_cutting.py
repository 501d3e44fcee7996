"""Operators over clips, captions, read models and index runs."""

from pyspark.sql import functions as F

from cuelight.functions import text as T
from cuelight.operators import cutting as K
from cuelight.operators import editing as E
from cuelight.operators import library as L

CUES = "array<struct<start_ms:long,end_ms:long,cue:int,text:string>>"


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def cues(*spans):
    return F.array(*[F.struct(F.lit(a).cast("long").alias("start_ms"), F.lit(b).cast("long").alias("end_ms"), F.lit(k).alias("cue"), F.lit(t).alias("text")) for k, (a, b, t) in enumerate(spans)])


def test_blanks_are_those_of_unicode(spark):
    r = one(
        spark,
        a=T.squeeze(F.lit("  a　 b﻿\t")),
        b=T.comparison_key(F.lit("\tThe Long’s Dinner. !")),
        c=T.clean_cue(F.lit(" - ANN: no\r\n﻿BOB J.: <i>yes</i> ♪ – and (a\nlaugh) so")),
        d=T.normalise_line(F.lit(" > 1) **the** one [with a kite](http://x) u/me edit 2: no")),
        e=T.usable(F.lit("one two three")),
        f=T.clean_cue(F.lit("DOOR SLAMS SHUT")),
    )
    assert (r.a, r.b, r.d, r.e, r.f) == ("a b", "the long's dinner", "the one with a kite", True, "")
    assert r.c == "ANN: no yes and so"


def test_lines_of_a_paste(spark):
    """Markers in each other, blocks, code, links and pictures, marks inside labels, headings, handles, and notes of edits."""
    lines = {
        "> - 1. the kite": "the kite", "#12 a  boat": "a boat", "2) - x": "x", "12.5 miles": "12.5 miles", "#hash tag": "hash tag", "3: two": "two",
        "see ```a\nb``` then `code` here": "see then code here", "![pic *of* `it`](u) and [**x**](y)!": "pic of it and x!", "a ` lone and [odd](": "a ` lone and [odd](",
        "`[in](code)` ok": "in ok", "~~gone~~ __kept__": "gone kept", "# # twice": "# twice", "**## head": "head", "by /u/some_one and r/shows now": "by and now",
        "text EDIT 2: more\nlines": "text", "text edit u/me: no": "text", "the editor: stays": "the editor: stays", "eta — later": "", "``` open": "` open", "": "", " \u00a0 ": "",
    }
    df = spark.createDataFrame(list(lines.items()), "line string, want string")
    assert [(r.line, r.got) for r in df.select("line", T.normalise_line(F.col("line")).alias("got")).collect()] == list(lines.items())


def test_caption_file(spark):
    c = cues((900, 1500, "früh {a}"), (4000, 12_000, "two\nlines\\"), (20_000, 21_000, "late"), (5000, 6000, "  "))
    start, end = F.lit(1000).cast("long"), F.lit(10_000).cast("long")
    file = lambda mode, meme: K.caption_file(K.caption_events(F.lit(mode), F.lit("mine"), c, start, end), F.lit(640), F.lit(360), F.lit(meme), F.lit(float("nan")), F.lit("auto"))
    r = one(spark, said=file("subtitle", False), own=file("custom", True), none=file("none", True))
    assert r.none is None and "PlayResX: 640\nPlayResY: 360\n" in r.said and "\nStyle: Default,DejaVu Sans,20," in r.said and ",2,38,38,13,1\n" in r.said
    assert r.said.endswith("Dialogue: 0,0:00:00.00,0:00:00.50,Default,,0,0,0,,früh \\{a\\}\nDialogue: 0,0:00:03.00,0:00:09.00,Default,,0,0,0,,two\\Nlines\\\\\n")
    assert r.own.endswith("Dialogue: 0,0:00:00.00,0:00:09.00,Default,,0,0,0,,MINE\n") and ",-1,0,0,0,100" in r.own and ",8,38,38,14,1\n" in r.own


def test_trim_actions_and_alternates(spark):
    c = cues((94_000, 96_500, "a"), (100_200, 103_000, "b"), (104_000, 106_500, "c"), (107_000, 109_800, "d"), (112_000, 114_000, "e"))
    lit = lambda x: F.lit(x).cast("long")
    m = F.array(*[F.struct(F.lit(t).alias("title")) for t in ("x", "y", "x", "y", "x")])
    r = one(
        spark,
        acts=K.trim_actions(c, lit(100_000), lit(110_000), lit(100_000), lit(110_000)),
        some=K.alternates_of_title(m, F.array(F.lit(9), F.lit(2), F.lit(1), F.lit(4))),
        none=K.alternates_of_title(m, F.array(F.lit(9))),
        picks=L.ordered_picks(F.array(F.lit(4), F.lit(1), F.lit(4))),
    )
    assert [(a.key, a.to) for a in r.acts] == [("add-before", 94_000), ("drop-first", 103_000), ("drop-last", 107_000), ("add-after", 114_000)]
    assert (r.some.title, r.some.places, r.some.chosen) == ("x", [0, 2, 4], [1, 2]) and r.none is None and r.picks == [1, 4]


def test_line_edits_and_spans(spark):
    df = spark.createDataFrame([("v", k, k * 60_000, k * 60_000 + 1000, f"line {k}") for k in range(5)], "video_id string, cue int, start_ms long, end_ms long, text string")
    edits = spark.createDataFrame([("v", {"60000": "", "120000": "new", "5": "no"}), ("w", {"0": "no"})], "video_id string, edits map<string,string>")
    assert [r.text for r in K.apply_line_edits(df, edits).orderBy("cue").collect()] == ["line 0", "", "new", "line 3", "line 4"]
    assert [r.cue for r in K.cues_between(df, "v", 500, 10**9).collect()] == [0, 1, 2]


def test_lists_of_clips(spark):
    a = F.array(F.lit(1), F.lit(2), F.lit(3))
    r = one(spark, put=E.replace_at(a, F.lit(1), F.lit(9)), out=E.remove_at(a, F.lit(0)), same=E.replace_at(a, F.lit(7), F.lit(9)), new=E.new_clip(F.lit("d"), F.array()))
    assert (r.put, r.out, r.same, r.new.alternate_index, r.new.caption_mode) == ([1, 9, 3], [2, 3], [1, 2, 3], None, "inherit")


def test_eviction_leaves_what_is_busy(spark):
    rows = [("s", f"f{k}", 1000, k * 2_000_000) for k in range(6)] + [("s", "x.part", 1000, -5), ("t", "g", 1000, 1)]
    files = spark.createDataFrame(rows, "shelf string, path string, size long, mtime_ms long")
    busy = spark.createDataFrame([("f1",)], "path string")
    assert sorted(r.path for r in L.eviction_plan(files, 4500, busy=busy).collect()) == ["f0", "f2", "f3"]
    assert L.eviction_plan(files).count() == 0 and L.eviction_plan(files.limit(0), 1).count() == 0
    assert [L.cache_cap(x) for x in (None, " ", "-5", "1.5", "12", "x")] == [L.CACHE_CAP] * 4 + [12, L.CACHE_CAP]


def test_patches_and_latest(spark):
    rows = spark.createDataFrame([(1, "queued", None), (2, "done", "a")], "id int, status string, file string")
    log = spark.createDataFrame([(1, 1, "running", None), (1, 3, None, "b"), (1, 2, "failed", "c"), (9, 1, "no", "no")], "id int, at int, status string, file string")
    got = {r.id: (r.status, r.file, r.updated_at) for r in L.apply_patches(rows, log, "id", ["status", "file"]).collect()}
    assert got == {1: ("failed", "b", 3), 2: ("done", "a", None)}
    assert {r.id: r.at for r in L.latest(log, "id", ["at"]).collect()} == {1: 3, 9: 1}
    assert L.with_defaults(rows, {"status": F.lit("no"), "width": F.lit(7)}).where("width = 7 and status <> 'no'").count() == 2
    assert L.remaining(rows, rows.where("id = 2"), "id").count() == 1 and L.remaining(rows, rows, "id", force=True).count() == 2


def test_cut_of_a_paste(spark):
    from cuelight.operators.building import build_cuts, saved_cuts

    embed = lambda text: F.array(F.lit(1.0), F.char_length(text).cast("double") / 50)
    lines = spark.createDataFrame([(k, "t", "v", k * 60_000, k * 60_000 + 4000, f"line number {k}") for k in range(9)], "line_id long, title_id string, video_id string, start_ms long, end_ms long, text string")
    pastes = spark.createDataFrame([(1, "the first scene of all\nlol\nand the second scene"), (2, "")], "doc_id long, text string")
    cuts = saved_cuts(build_cuts(pastes, lines.withColumn("embedding", embed(F.col("text"))), embed=embed)).collect()
    assert len(cuts) == 1 and [c.clip.description for c in cuts[0].clips] == ["the first scene of all", "and the second scene"]
    assert all(len(c.clip.alternates) == 6 and c.clip.alternate_index == 0 for c in cuts[0].clips)
    empty = build_cuts(pastes, lines.withColumn("embedding", embed(F.col("text"))).limit(0), embed=embed).collect()
    assert len(empty) == 2 and all(r.clip.alternates == [] and r.clip.alternate_index is None for r in empty)


def test_approximate_neighbours_have_their_recall(spark):
    from cuelight.plans import retrieval_queries as Q

    exact, near = ({(r.query_id, r.line_id) for r in q(spark, "/root/testdata/sf0.1").collect()} for q in (Q.knn_batch, Q.lsh_knn))
    assert len(exact & near) >= 0.9 * len(exact)
