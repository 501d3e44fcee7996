"""Clip, trim, caption and filmstrip queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.functions import cut as C
from cuelight.operators import cutting as K
from cuelight.operators import intervals as I
from cuelight.plans import views
from cuelight.plans.views import CUES_SQL


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as clips: a match and signed pads in milliseconds."""
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    start = (F.col("l_partkey") * 37) % 100_000
    return views.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("cut_id"),
        F.col("l_linenumber").alias("pos"),
        start.alias("start_ms"),
        (start + 200 + (F.col("l_suppkey") * 101) % 9000).alias("end_ms"),
        ((k * 131) % 4001 - 2000).alias("pad_before"),
        ((k * 173) % 4001 - 2000).alias("pad_after"),
    )


CLIPS_SQL = """
clips AS (
  SELECT l_orderkey AS cut_id, l_linenumber AS pos, (l_partkey * 37) % 100000 AS start_ms,
         (l_partkey * 37) % 100000 + 200 + (l_suppkey * 101) % 9000 AS end_ms,
         ((l_orderkey * 10 + l_linenumber) * 131) % 4001 - 2000 AS pad_before, ((l_orderkey * 10 + l_linenumber) * 173) % 4001 - 2000 AS pad_after
  FROM lineitem),
bounds AS (
  SELECT *, greatest(0, start_ms - pad_before) AS s,
         CASE WHEN end_ms + pad_after - greatest(0, start_ms - pad_before) < 250 THEN greatest(0, start_ms - pad_before) + 250 ELSE end_ms + pad_after END AS e
  FROM clips)
"""


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = C.clip_start(F.col("start_ms"), F.col("pad_before")), C.clip_end(F.col("start_ms"), F.col("end_ms"), F.col("pad_before"), F.col("pad_after"))
    return clips(spark, sf_dir).withColumn("s", s).withColumn("e", e)


def clip_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds(spark, sf_dir).select("cut_id", "pos", F.col("s").alias("clip_start"), F.col("e").alias("clip_end"), (F.col("e") - F.col("s")).alias("duration"))


def trim_window_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window an edge may move in, and the pads after both edges moved."""
    b = bounds(spark, sf_dir)
    lo, hi = C.window_start(F.col("start_ms")), C.window_end(F.col("end_ms"))
    a = C.clamp(F.col("s") - 1234, lo, F.col("e") - C.MIN_CLIP)
    z = C.clamp(F.col("e") + 987, F.col("s") + C.MIN_CLIP, hi)
    return b.select(
        "cut_id", "pos", lo.alias("window_start"), hi.alias("window_end"), (F.col("start_ms") - a).alias("pad_before"), (z - F.col("end_ms")).alias("pad_after")
    )


TRIM_SQL = f"""
WITH {CLIPS_SQL}
SELECT cut_id, pos, greatest(0, start_ms - 15000) AS window_start, end_ms + 15000 AS window_end,
       start_ms - greatest(greatest(0, start_ms - 15000), least(e - 250, s - 1234)) AS pad_before,
       greatest(s + 250, least(end_ms + 15000, e + 987)) - end_ms AS pad_after FROM bounds"""


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip around each cue of the conversations' videos."""
    return views.cues(spark, sf_dir).select(
        "video_id", "cue", (F.col("start_ms") + F.col("cue") * 37 - 180).alias("s"), (F.col("end_ms") + 2300 - F.col("cue") * 53).alias("e"), F.col("start_ms").alias("m_start"), F.col("end_ms").alias("m_end")
    )


def _with_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips with the cues in their reach."""
    lo, hi = K.reach(F.col("s"), F.col("e"), F.col("m_start"), F.col("m_end"))
    return K.with_cues(_marks(spark, sf_dir).withColumn("lo", lo).withColumn("hi", hi), views.cues(spark, sf_dir), ["cue"])


def snap_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _with_cues(spark, sf_dir).withColumn("points", K.boundaries(F.col("cues"), F.col("m_start"), F.col("m_end")))
    return c.select("video_id", "cue", C.snap(F.col("s"), F.col("points")).alias("start_ms"), C.snap(F.col("e"), F.col("points")).alias("end_ms"))


MARKS_SQL = f"""
{CUES_SQL},
marks AS (SELECT video_id, cue, start_ms + cue * 37 - 180 AS s, end_ms + 2300 - cue * 53 AS e, start_ms AS m_start, end_ms AS m_end FROM cues),
edges AS (SELECT video_id, start_ms AS p FROM cues UNION SELECT video_id, end_ms FROM cues)
"""


def _snap_sql(x: str) -> str:
    return f"coalesce((SELECT p FROM edges g WHERE g.video_id = m.video_id AND abs(p - {x}) < 400 ORDER BY abs(p - {x}), p LIMIT 1), {x})"


SNAP_SQL = f"WITH {MARKS_SQL} SELECT video_id, cue, {_snap_sql('s')} AS start_ms, {_snap_sql('e')} AS end_ms FROM marks m"


def next_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of cues on either side of each clip's start, however far."""
    points = K.edge_points(views.cues(spark, sf_dir))
    marks = _marks(spark, sf_dir).select("video_id", "cue", (F.col("s") + 1).alias("over"), (F.col("s") - 1).alias("under"))
    after = I.first_past(marks, points, ["cue"], "over", "after")
    return I.first_past(after, points, ["cue"], "under", "before", before=True).select("video_id", "cue", "after", "before")


BOUNDARY_SQL = f"""
WITH {MARKS_SQL}
SELECT m.video_id, m.cue, (SELECT min(p) FROM edges g WHERE g.video_id = m.video_id AND p > s + 1) AS "after",
       (SELECT max(p) FROM edges g WHERE g.video_id = m.video_id AND p < s - 1) AS "before" FROM marks m"""


def trim_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be done to each clip: a line added at either side, or dropped there, within reach."""
    c = _with_cues(spark, sf_dir)
    found = K.trim_actions(F.col("cues"), F.col("s"), F.col("e"), F.col("m_start"), F.col("m_end"))
    return c.select("video_id", "cue", F.explode(found).alias("a")).select("video_id", "cue", "a.key", "a.to")


ACTIONS_SQL = f"""
WITH {MARKS_SQL},
m AS (SELECT *, greatest(0, m_start - 15000) AS lo, m_end + 15000 AS hi FROM marks),
c AS (SELECT m.video_id, m.cue, any_value(s) AS s, any_value(e) AS e, any_value(lo) AS lo, any_value(hi) AS hi,
        arg_max(x.start_ms, struct_pack(a := x.start_ms, b := x.end_ms, c := x.cue)) FILTER (x.end_ms <= s + 150) AS before,
        arg_min(x.end_ms, struct_pack(a := x.start_ms, b := x.end_ms, c := x.cue)) FILTER (x.start_ms >= e - 150) AS after_,
        arg_min(x.end_ms, struct_pack(a := x.start_ms, b := x.end_ms, c := x.cue)) FILTER (x.end_ms > s + 150 AND x.start_ms < e - 150) AS first_,
        arg_max(x.start_ms, struct_pack(a := x.start_ms, b := x.end_ms, c := x.cue)) FILTER (x.end_ms > s + 150 AND x.start_ms < e - 150) AS last_,
        count(*) FILTER (x.end_ms > s + 150 AND x.start_ms < e - 150) AS n
      FROM m JOIN cues x USING (video_id) GROUP BY m.video_id, m.cue)
SELECT video_id, cue, 'add-before' AS key, before AS "to" FROM c WHERE before >= lo AND before <= e - 250
UNION ALL SELECT video_id, cue, 'drop-first', first_ FROM c WHERE n > 1 AND first_ >= lo AND first_ <= e - 250
UNION ALL SELECT video_id, cue, 'drop-last', last_ FROM c WHERE n > 1 AND last_ <= hi AND last_ >= s + 250
UNION ALL SELECT video_id, cue, 'add-after', after_ FROM c WHERE after_ <= hi AND after_ >= s + 250"""


def filmstrip_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = F.col("s"), F.col("e")
    at = s + (F.col("cut_id") * 7919) % 20_000
    return bounds(spark, sf_dir).select(
        "cut_id", "pos", C.tiles(s, e).alias("tiles"), F.round(C.tile_interval(s, e), 6).alias("interval_ms"), C.tile_at(s, e, at).alias("tile"), F.round(C.position_percent(s, e, at), 6).alias("percent")
    )


FILMSTRIP_SQL = f"""
WITH {CLIPS_SQL},
t AS (SELECT *, s + (cut_id * 7919) % 20000 AS x, CAST(greatest(1, least(96, floor(greatest(500, e - s) / 500 + 0.5))) AS INT) AS tiles FROM bounds)
SELECT cut_id, pos, tiles, round(greatest(500, e - s) / tiles, 6) AS interval_ms,
       CAST(greatest(0, least(tiles - 1, floor((x - s) / (greatest(500, e - s) / tiles)))) AS INT) AS tile,
       round(CASE WHEN e > s THEN greatest(0, least(100, (x - s) / (e - s) * 100)) ELSE 0 END, 6) AS percent FROM t"""


def alternates_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order, the matches of the supplier of its first chosen line, and where the chosen ones stand among them."""
    k = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_suppkey") % 3).alias("title")))).alias("m"))
    told = K.alternates_of_title(F.col("m"), F.array(F.lit(1), F.lit(0), F.lit(3)))
    k = k.select("l_orderkey", told.alias("a")).where("a is not null")
    return k.select("l_orderkey", "a.title", F.size("a.places").cast("long").alias("n_matches"), F.array_join(F.col("a.chosen").cast("array<string>"), ",").alias("chosen"))


ALTERNATES_SQL = """
WITH m AS (SELECT l_orderkey, list(l_suppkey % 3 ORDER BY l_linenumber, l_suppkey % 3) AS t FROM lineitem GROUP BY l_orderkey),
p AS (SELECT *, list_filter([1, 0, 3], lambda i: i < len(t)) AS picked FROM m),
q AS (SELECT *, t[picked[1] + 1] AS title FROM p WHERE len(picked) > 0),
r AS (SELECT *, list_filter(range(0, len(t)), lambda i: t[i + 1] = title) AS places FROM q)
SELECT l_orderkey, title, len(places) AS n_matches,
       array_to_string(list_transform(list_filter(picked, lambda i: list_contains(places, i)), lambda i: list_position(places, i) - 1), ',') AS chosen FROM r"""


def resolve_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption of each clip from its own and the cut's: mode and text unless inherited, look by precedence."""
    o = views.table(spark, sf_dir, "orders")
    i = F.col("o_orderkey")
    own = F.when(i % 4 == 0, "inherit").when(i % 4 == 1, "none").when(i % 4 == 2, "subtitle").otherwise("custom")
    cut_mode = F.when(F.col("o_orderstatus") == "F", "subtitle").otherwise("custom")
    size = F.when(i % 3 == 0, (i % 50) / 10).when(i % 3 == 1, F.lit(None))
    own_size, cut_size = F.when(i % 2 == 0, size), F.when(i % 5 == 0, (i % 70) / 10)
    placement = F.when(i % 6 == 0, "top"), F.when(i % 7 == 0, "bottom")
    told = K.resolve_caption(own, F.lit("own"), cut_mode, F.col("o_orderpriority"), (own_size, cut_size), placement)
    return o.select("o_orderkey", told.alias("c")).select("o_orderkey", "c.mode", "c.text", "c.size", "c.placement")


CAPTION_SQL = """
SELECT o_orderkey, CASE i % 4 WHEN 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'subtitle' ELSE 'custom' END WHEN 1 THEN 'none' WHEN 2 THEN 'subtitle' ELSE 'custom' END AS mode,
       CASE WHEN i % 4 = 0 THEN o_orderpriority ELSE 'own' END AS text,
       greatest(CAST(0.5 AS DOUBLE), least(CAST(3 AS DOUBLE), coalesce(CASE WHEN i % 2 = 0 AND i % 3 = 0 THEN (i % 50) / 10 END, CASE WHEN i % 5 = 0 THEN (i % 70) / 10 END, 1))) AS size,
       CASE WHEN i % 6 = 0 THEN 'top' WHEN i % 7 = 0 THEN 'bottom' ELSE 'auto' END AS placement
FROM (SELECT *, o_orderkey AS i FROM orders)"""


def line_edit_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues with their edits: text replaced, by nothing too; edits of no cue are ignored."""
    cues = views.cues(spark, sf_dir)
    edits = cues.where("cue % 3 = 0").groupBy("video_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("start_ms").cast("string"), F.when(F.col("cue") % 2 == 0, F.concat(F.lit("edited "), "text")).otherwise("")))).alias("edits")
    )
    return K.apply_line_edits(cues, edits).select("video_id", "cue", "start_ms", "text")


EDIT_SQL = f"""
WITH {CUES_SQL}
SELECT c.video_id, c.cue, c.start_ms, CASE WHEN e.video_id IS NULL THEN c.text WHEN e.cue % 2 = 0 THEN 'edited ' || e.text ELSE '' END AS text
FROM cues c LEFT JOIN (SELECT * FROM cues WHERE cue % 3 = 0) e ON e.video_id = c.video_id AND e.start_ms = c.start_ms"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _with_cues(spark, sf_dir)
    return c.select("video_id", "cue", F.explode(K.clip_events(F.col("cues"), F.col("s"), F.col("e"))).alias("x"))


def clip_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("video_id", "cue", F.col("x.cue").alias("of"), "x.start_ms", "x.end_ms")


EVENTS_SQL = f"""
{MARKS_SQL},
clip_cues AS (SELECT m.video_id, m.cue, x.cue AS "of", greatest(0, x.start_ms - s) AS start_ms, least(e - s, x.end_ms - s) AS end_ms, x.text
            FROM marks m JOIN cues x USING (video_id) WHERE x.end_ms > s AND x.start_ms < e)
"""
ASS_TIME = "(greatest(0, {0}) // 3600000) || ':' || lpad(CAST(greatest(0, {0}) // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(greatest(0, {0}) // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(greatest(0, {0}) // 10 % 100 AS VARCHAR), 2, '0')"


def ass_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where(K.drawable(F.col("x")))
    return e.select("video_id", "cue", F.col("x.cue").alias("of"), K.dialogue_line(F.col("x")).alias("line"))


ASS_SQL = f"""
WITH {EVENTS_SQL}
SELECT video_id, cue, "of", 'Dialogue: 0,' || {ASS_TIME.format('start_ms')} || ',' || {ASS_TIME.format('end_ms')} || ',Default,,0,0,0,,' ||
  regexp_replace(replace(replace(replace(text, '\\', '\\\\'), '{{', '\\{{'), '}}', '\\}}'), '\\r?\\n', '\\\\N', 'g') AS line
FROM clip_cues WHERE trim(text) <> '' AND end_ms > start_ms"""


def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds(spark, sf_dir).select("cut_id", "pos", K.strip_address(F.col("cut_id"), F.col("s"), F.col("e")).alias("key"))


def caption_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole caption files of clips by mode: nothing, what is said, or a text of its own, in two styles and three places."""
    c, k = _with_cues(spark, sf_dir), F.col("cue")
    mode = F.when(k % 3 == 0, "subtitle").when(k % 3 == 1, "custom").otherwise("none")
    events = K.caption_events(mode, F.concat(F.lit("own text "), k.cast("string")), F.col("cues"), F.col("s"), F.col("e"))
    place = F.when(k % 5 == 0, "top").when(k % 5 == 1, "bottom").otherwise("auto")
    text = K.caption_file(events, F.lit(854), F.lit(480), k % 6 == 4, (k % 40) / 10.0, place)
    return c.select("video_id", "cue", F.sha2(text, 256).alias("file_sha256"))


KEY_SQL = f"""
WITH {CLIPS_SQL}
SELECT cut_id, pos, sha1(concat_ws('|', cut_id, s, e, CAST(greatest(1, least(96, floor(greatest(500, e - s) / 500 + 0.5))) AS INT), 128, 72)) AS key FROM bounds"""


FILES_SQL = f"""
WITH {EVENTS_SQL},
k AS (SELECT video_id, cue, e - s AS span, cue % 6 = 4 AS meme, greatest(CAST(0.5 AS DOUBLE), least(CAST(3 AS DOUBLE), (cue % 40) / 10)) AS size,
        CASE cue % 5 WHEN 0 THEN true WHEN 1 THEN false ELSE cue % 6 = 4 END AS top FROM marks),
shown AS (
  SELECT video_id, cue, "of" AS o, start_ms, end_ms, text FROM clip_cues WHERE cue % 3 = 0 AND trim(text) <> '' AND end_ms > start_ms
  UNION ALL SELECT video_id, cue, 0, 0, span, 'own text ' || cue FROM k WHERE cue % 3 = 1 AND span > 0),
said AS (SELECT video_id, cue, string_agg('Dialogue: 0,' || {ASS_TIME.format('start_ms')} || ',' || {ASS_TIME.format('end_ms')} || ',Default,,0,0,0,,' ||
    regexp_replace(replace(replace(replace(CASE WHEN cue % 6 = 4 THEN upper(text) ELSE text END, '\\', '\\\\'), '{{', '\\{{'), '}}', '\\}}'), '\\r?\\n', '\\\\N', 'g'), chr(10) ORDER BY o) AS rows
  FROM shown GROUP BY video_id, cue)
SELECT k.video_id, k.cue, sha256(
  '[Script Info]' || chr(10) || 'ScriptType: v4.00+' || chr(10) || 'PlayResX: 854' || chr(10) || 'PlayResY: 480' || chr(10) || 'WrapStyle: 0' || chr(10) ||
  'ScaledBorderAndShadow: yes' || chr(10) || 'YCbCr Matrix: TV.709' || chr(10) || chr(10) || '[V4+ Styles]' || chr(10) || 'Format: {K.STYLE_COLUMNS}' || chr(10) ||
  'Style: Default,DejaVu Sans,' || CAST(floor(480 * CAST(CASE WHEN meme THEN 0.085 ELSE 0.055 END AS DOUBLE) * size + 0.5) AS INT) || ',&H00FFFFFF,&H00FFFFFF,&H00000000,&H00000000,' ||
  CASE WHEN meme THEN -1 ELSE 0 END || ',0,0,0,100,100,0,0,1,' || greatest(2, CAST(floor(480 * CAST(CASE WHEN meme THEN 0.006 ELSE 0.004 END AS DOUBLE) * size + 0.5) AS INT)) || ',0,' ||
  CASE WHEN top THEN 8 ELSE 2 END || ',51,51,' || CASE WHEN meme THEN 19 ELSE 17 END || ',1' || chr(10) || chr(10) || '[Events]' || chr(10) || 'Format: {K.EVENT_COLUMNS}' || chr(10) || rows || chr(10)) AS file_sha256
FROM k LEFT JOIN said USING (video_id, cue)"""


def cut_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cut's clips without a match skipped, its length, and the progress at which its last clip is done."""
    b = bounds(spark, sf_dir).where("end_ms - start_ms >= 300")
    return K.summary(b.select("cut_id", F.col("s").alias("start_ms"), F.col("e").alias("end_ms")))


SUMMARY_SQL = f"""
WITH {CLIPS_SQL},
g AS (SELECT cut_id, count(*) AS n_clips, CAST(sum(e - s) AS BIGINT) AS duration_ms FROM bounds WHERE end_ms - start_ms >= 300 GROUP BY cut_id),
h AS (SELECT *, CAST(floor(duration_ms / 1000 + 0.5) AS BIGINT) AS t FROM g)
SELECT cut_id, n_clips, duration_ms, CASE WHEN t >= 3600 THEN (t // 3600) || ':' || lpad(CAST(t // 60 % 60 AS VARCHAR), 2, '0') ELSE CAST(t // 60 AS VARCHAR) END || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') AS clock FROM h"""


QUERIES = {
    f.__name__: f
    for f in (
        clip_bounds, trim_window_padding, snap_nearest, next_boundary, trim_actions, filmstrip_plan, alternates_scope, resolve_caption,
        line_edit_apply, clip_events, ass_lines, cache_key, caption_files, cut_summary,
    )
}
SQL = {
    "clip_bounds": f"WITH {CLIPS_SQL} SELECT cut_id, pos, s AS clip_start, e AS clip_end, e - s AS duration FROM bounds",
    "trim_window_padding": TRIM_SQL,
    "snap_nearest": SNAP_SQL,
    "next_boundary": BOUNDARY_SQL,
    "trim_actions": ACTIONS_SQL,
    "filmstrip_plan": FILMSTRIP_SQL,
    "alternates_scope": ALTERNATES_SQL,
    "resolve_caption": CAPTION_SQL,
    "line_edit_apply": EDIT_SQL,
    "clip_events": f'WITH {EVENTS_SQL} SELECT video_id, cue, "of", start_ms, end_ms FROM clip_cues',
    "ass_lines": ASS_SQL,
    "cache_key": KEY_SQL,
    "caption_files": FILES_SQL,
    "cut_summary": SUMMARY_SQL,
}
