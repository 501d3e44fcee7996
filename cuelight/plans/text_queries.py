"""Subtitle, hint and paste queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.functions import text as T
from cuelight.operators import hints, splitting, subtitles
from cuelight.plans import views
from cuelight.plans.views import CUES_SQL, TEXT_LINES_SQL

# ---- subtitles ----------------------------------------------------------------


def _clock(ms, dot: str):
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat(
        pad(F.floor(ms / 3_600_000), 2), F.lit(":"), pad(F.floor(ms / 60_000) % 60, 2), F.lit(":"), pad(F.floor(ms / 1000) % 60, 2), F.lit(dot), pad(ms % 1000, 3)
    )


CLOCK_SQL = "lpad(CAST({0} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 1000 % 60 AS VARCHAR), 2, '0') || '{1}' || lpad(CAST({0} % 1000 AS VARCHAR), 3, '0')"


def subtitle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as subtitle files: every second one with a byte-order mark and returns."""
    c = views.cues(spark, sf_dir)
    block = F.concat(
        (F.col("cue") + 1).cast("string"), F.lit("\n"), _clock(F.col("start_ms"), ","), F.lit(" --> "), _clock(F.col("end_ms"), ","), F.lit("\n"),
        F.when(F.col("cue") % 3 == 0, F.lit("- <i>")).when(F.col("cue") % 3 == 1, F.lit("ANN: ")).otherwise(F.lit("[door] ")), F.replace("text", F.lit("\n"), F.lit(" ")),
    )
    files = c.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("cue", block.alias("b")))).alias("bs"))
    body = F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n")
    odd = F.col("video_id").cast("long") % 2 == 1
    return files.select("video_id", F.when(odd, F.concat(F.lit("﻿"), F.replace(body, F.lit("\n"), F.lit("\r\n")))).otherwise(body).alias("body"))


def srt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.parse_subtitles(subtitle_files(spark, sf_dir))


B = T.BLANK


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def squeeze_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{B}]+', ' ', 'g'))"


def clean_sql(x: str) -> str:
    """Words of the lines of a cue: each line is matched whole, and what follows label, music and dash is taken."""
    for opens, closes, times in T.PAIRS:
        x = f"regexp_replace({x}, '\\{opens}[^\\{closes}]{times}\\{closes}', ' ', 'g')"
    rest = f"regexp_extract(l, '(?s)\\A[{B}]*(?:{_quoted(T.SPEAKER)})?(.*)', 1)"
    said = f"regexp_extract(translate({rest}, '{T.MUSIC}', '  '), '(?s)\\A(?:[{B}]*[{T.DASHES}])?(.*)', 1)"
    return squeeze_sql(f"array_to_string(list_transform(regexp_split_to_array({x}, '{T.LINE_END}'), lambda l: {said}), ' ')")


def shout_sql(c: str) -> str:
    return f"CASE WHEN length({c}) > 2 AND {c} = upper({c}) AND regexp_matches({c}, '[A-Z]{{3}}') AND len(string_split({c}, ' ')) <= 4 THEN '' ELSE {c} END"


SRT_SQL = f"""
WITH {CUES_SQL},
raw AS (SELECT *, CASE cue % 3 WHEN 0 THEN '- <i>' WHEN 1 THEN 'ANN: ' ELSE '[door] ' END || replace(text, chr(10), ' ') AS said FROM cues),
blocks AS (SELECT video_id, cue, start_ms, end_ms, said FROM raw),
cleaned AS (SELECT video_id, cue, start_ms, end_ms, {clean_sql('said')} AS c FROM blocks WHERE end_ms > start_ms),
kept AS (SELECT video_id, cue AS block, start_ms, end_ms, {shout_sql('c')} AS text FROM cleaned)
SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY start_ms, block) - 1 AS INT) AS cue, start_ms, end_ms, text FROM kept WHERE text <> ''"""


def timecode_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.cues(spark, sf_dir)
    dot = F.when(F.col("cue") % 2 == 0, _clock(F.col("start_ms"), ",")).otherwise(_clock(F.col("start_ms"), "."))
    line = F.concat(dot, F.lit(" --> "), _clock(F.col("end_ms"), "."))
    return c.select("video_id", "cue", T.timecode_ms(line, 1).alias("start_ms"), T.timecode_ms(line, 5).alias("end_ms"))


def cue_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' markup and documents' text through the cue cleaning."""
    pages = views.table(spark, sf_dir, "pages")
    return pages.select("page_id", F.sha2(T.clean_cue(F.coalesce("html", F.lit(""))), 256).alias("text_sha256"))


def dialogue_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.dialogue_windows(views.cues(spark, sf_dir)).drop("text")


def dialogue_windows_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.dialogue_windows(views.cues(spark, sf_dir), 60_000, 30_000, 3, 2).drop("text")


def window_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = subtitles.dialogue_windows(views.cues(spark, sf_dir), 60_000, 30_000, 4, 1)
    return w.select("video_id", "first_cue", "text")


def windows_sql(duration: int, gap: int, most: int, stride: int, columns: str) -> str:
    return f"""
WITH RECURSIVE {CUES_SQL},
n AS (SELECT video_id, max(cue) AS top FROM cues GROUP BY video_id),
grow AS (
  SELECT video_id, cue AS first, cue AS last, start_ms, end_ms FROM cues
  UNION ALL
  SELECT g.video_id, g.first, c.cue, g.start_ms, c.end_ms FROM grow g JOIN cues c ON c.video_id = g.video_id AND c.cue = g.last + 1
  WHERE c.cue < g.first + {most} AND c.start_ms - g.end_ms <= {gap} AND c.end_ms - g.start_ms <= {duration}),
reach AS (SELECT video_id, first, max(last) AS last, arg_max(end_ms, last) AS end_ms, any_value(start_ms) AS start_ms FROM grow GROUP BY ALL),
walk AS (
  SELECT r.* FROM reach r WHERE first = 0
  UNION ALL
  SELECT r.* FROM walk w JOIN n USING (video_id) JOIN reach r ON r.video_id = w.video_id AND r.first = least(w.first + {stride}, w.last + 1) WHERE w.last < n.top)
SELECT {columns} FROM walk w"""


WINDOW_COLUMNS = "video_id, start_ms, end_ms, CAST(first AS INT) AS first_cue, CAST(last AS INT) AS last_cue"
WINDOW_TEXT = (
    "video_id, CAST(first AS INT) AS first_cue, (SELECT trim(regexp_replace(string_agg(c.text, ' ' ORDER BY c.cue), '\\s+', ' ', 'g')) "
    "FROM cues c WHERE c.video_id = w.video_id AND c.cue BETWEEN w.first AND w.last) AS text"
)

# ---- hints --------------------------------------------------------------------


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions with quoted names, seasons, episodes and positions worked in."""
    i = F.col("part_id")
    p = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), F.coalesce("p_name", F.lit("")).alias("name"))
    text = (
        F.when(i % 8 == 0, F.concat(F.lit('the one in "'), "name", F.lit('." where they talk')))
        .when(i % 8 == 1, F.concat(F.lit("opening scene of S"), (i % 7 + 1).cast("string"), F.lit("E"), (i % 5 + 1).cast("string"), F.lit(" with "), "name"))
        .when(i % 8 == 2, F.concat(F.lit("Season "), (i % 7 + 1).cast("string"), F.lit(", episode "), (i % 9 + 1).cast("string"), F.lit(" at the very end")))
        .when(i % 8 == 3, F.concat(F.lit("the s"), (i % 9 + 1).cast("string"), F.lit(" finale, happy ending")))
        .when(i % 8 == 4, F.concat(F.lit("a "), (i % 6 + 1).cast("string"), F.lit("x0"), (i % 6 + 1).cast("string"), F.lit(" cold open and the ending")))
        .when(i % 8 == 5, F.concat(F.lit("season three premiere in “"), "name", F.lit("”")))
        .when(i % 8 == 6, F.concat(F.lit("it's 10 minutes in, "), "name", F.lit(" scene")))
        .otherwise(F.concat(F.lit("season "), F.when(i % 3 == 0, "two").otherwise("ninety"), F.lit(" of "), "name"))
    )
    return p.select(F.col("part_id").alias("query_id"), text.alias("text"))


PROMPTS_SQL = """
prompts AS (
  SELECT i AS query_id, CASE i % 8
    WHEN 0 THEN 'the one in "' || name || '." where they talk'
    WHEN 1 THEN 'opening scene of S' || (i % 7 + 1) || 'E' || (i % 5 + 1) || ' with ' || name
    WHEN 2 THEN 'Season ' || (i % 7 + 1) || ', episode ' || (i % 9 + 1) || ' at the very end'
    WHEN 3 THEN 'the s' || (i % 9 + 1) || ' finale, happy ending'
    WHEN 4 THEN 'a ' || (i % 6 + 1) || 'x0' || (i % 6 + 1) || ' cold open and the ending'
    WHEN 5 THEN 'season three premiere in “' || name || '”'
    WHEN 6 THEN 'it''s 10 minutes in, ' || name || ' scene'
    ELSE 'season ' || CASE WHEN i % 3 = 0 THEN 'two' ELSE 'ninety' END || ' of ' || name END AS text
  FROM (SELECT p_partkey AS i, coalesce(p_name, '') AS name FROM part))
"""


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as an episode of one of six seasons."""
    k = F.col("p_partkey")
    return views.table(spark, sf_dir, "part").select(
        k.cast("string").alias("video_id"), F.coalesce("p_name", F.lit("")).alias("name"), (k % 6 + 1).cast("int").alias("season"), F.floor(k / 6).cast("int").alias("episode")
    )


EPISODES_SQL = """
episodes AS (
  SELECT CAST(p_partkey AS VARCHAR) AS video_id, coalesce(p_name, '') AS name, CAST(p_partkey % 6 + 1 AS INT) AS season, CAST(p_partkey // 6 AS INT) AS episode
  FROM part)
"""
def key_sql(c: str) -> str:
    return f"lower(regexp_replace(regexp_replace(translate({c}, '’‘', ''''''), '\\A[{B}]+', ''), '[.,!?;:{B}]+\\z', ''))"


SPANS_SQL = "regexp_extract_all({0}, '[\"“]([^\"“”]+)[\"”]', 1)"


def quoted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts(spark, sf_dir).select("query_id", F.array_join(T.quoted_spans(F.col("text")), "|").alias("spans"))


def season_episode_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hints.numbered_episode(prompts(spark, sf_dir), episodes(spark, sf_dir))


NUMBERED_SQL = f"""
WITH {PROMPTS_SQL}, {EPISODES_SQL},
forms AS (
  SELECT query_id, ord, TRY_CAST(regexp_extract(text, p, 1) AS INT) AS season, TRY_CAST(regexp_extract(text, p, 2) AS INT) AS episode
  FROM prompts, (VALUES (1, '(?i)\\bs(\\d{{1,2}})\\s*(?:ep(?:isode)?|e)\\s*(\\d{{1,2}})\\b'),
                        (2, '(?i)\\bseason\\s*(\\d{{1,2}})\\s*,?\\s*(?:ep(?:isode)?|e)\\s*(\\d{{1,2}})\\b'),
                        (3, '(?i)\\b(\\d{{1,2}})x(\\d{{1,2}})\\b')) AS f(ord, p) WHERE regexp_matches(text, p))
SELECT query_id, video_id, name || ' (S' || season || 'E' || episode || ')' AS label
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord, video_id) AS n FROM forms JOIN episodes USING (season, episode)) WHERE n = 1"""


def season_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hints.season_scope(prompts(spark, sf_dir), episodes(spark, sf_dir)).drop("season")


SEASON_SQL = f"""
WITH {PROMPTS_SQL}, {EPISODES_SQL},
asked AS (
  SELECT query_id, text, coalesce(
    TRY_CAST(nullif(regexp_extract(text, '(?i)\\bs(\\d{{1,2}})\\b', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(text, '(?i)\\bseason\\s*(\\d{{1,2}})\\b', 1), '') AS INT),
    CAST(nullif(list_position(['one','two','three','four','five','six','seven','eight','nine','ten'], lower(regexp_extract(text, '(?i)\\bseason\\s+([a-z]+)\\b', 1))), 0) AS INT)) AS season,
    CASE WHEN regexp_matches(text, '(?i)\\b(finale|final episode|last episode)\\b') THEN 'last' WHEN regexp_matches(text, '(?i)\\b(premiere|première|first episode)\\b') THEN 'first' END AS e
  FROM prompts),
ends AS (SELECT *, count(*) OVER s AS n, row_number() OVER (s ORDER BY episode, video_id) AS up, row_number() OVER (s ORDER BY episode DESC, video_id DESC) AS down
         FROM episodes WINDOW s AS (PARTITION BY season))
SELECT query_id, CASE WHEN e IS NULL THEN n ELSE 1 END AS n_videos, CASE WHEN e IS NOT NULL THEN video_id END AS video_id,
       CASE WHEN e IS NULL THEN 'season ' || season ELSE name || ' (S' || season || 'E' || episode || ')' END AS label
FROM asked JOIN ends USING (season) WHERE CASE WHEN e = 'last' THEN down ELSE up END = 1"""


def position_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts(spark, sf_dir).select("query_id", T.position_hint(F.col("text")).alias("when"))


POSITION_SQL = f"""
WITH {PROMPTS_SQL}, m AS (SELECT query_id, regexp_matches(text, '{T.OPENING}') AS o, regexp_matches(text, '{T.ENDING}') AS e FROM prompts)
SELECT query_id, CASE WHEN o AND NOT e THEN 'opening' WHEN e AND NOT o THEN 'ending' END AS "when" FROM m"""


def episode_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, e = prompts(spark, sf_dir), episodes(spark, sf_dir)
    return hints.quoted_episode(q, e).withColumn("how", F.lit("quoted")).unionByName(hints.unquoted_episode(q, e).withColumn("how", F.lit("prose")))


NAME_SQL = f"""
WITH {PROMPTS_SQL}, {EPISODES_SQL},
spans AS (SELECT query_id, i AS ord, {key_sql('s[i]')} AS key FROM (SELECT query_id, {SPANS_SQL.format('text')} AS s FROM prompts), unnest(range(1, len(s) + 1)) AS r(i)),
named AS (SELECT *, {key_sql('name')} AS key FROM episodes),
quoted AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord, season, episode, video_id) AS n FROM spans JOIN named USING (key) WHERE key <> ''),
prose AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(name) DESC, season, episode, video_id) AS n
  FROM prompts p JOIN episodes e ON contains(p.text, e.name)
  WHERE len(regexp_split_to_array(trim(name), '\\s+')) >= 2
    AND regexp_matches(p.text, '(^|[^A-Za-z0-9])' || regexp_escape(e.name) || '($|[^A-Za-z0-9])'))
SELECT query_id, video_id, name || ' (S' || season || 'E' || episode || ')' AS label, 'quoted' AS how FROM quoted WHERE n = 1
UNION ALL SELECT query_id, video_id, name || ' (S' || season || 'E' || episode || ')', 'prose' FROM prose WHERE n = 1"""


# ---- pasted text --------------------------------------------------------------


def split_lines_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents as descriptions, with whether each may be one."""
    lines = views.text_lines(spark, sf_dir).select("doc_id", "pos", T.normalise_line(F.col("line")).alias("text"))
    return lines.select("doc_id", "pos", F.sha2("text", 256).alias("text_sha256"), T.usable(F.col("text")).alias("usable"))


def _normal_sql(x: str) -> str:
    """Parts of the line with what each says, then the words between blanks and handles before the note of an edit."""
    link = "!?\\[([^\\]]*)\\]\\([^)]*\\)"
    body = f"regexp_replace({x}, '\\A([{B}]*({T.ITEM}))+', '')"
    parts = f"regexp_extract_all({body}, '(?s){T.CODE_BLOCK}|{T.CODE}|{T.LINK}|{T.BETWEEN}|.')"
    said = (
        f"CASE WHEN p[1:3] = '```' THEN ' ' WHEN p[1] = '`' AND length(p) > 1 THEN regexp_replace(p[2:-2], '{link}', '\\1', 'g') "
        f"WHEN regexp_full_match(p, '(?s){T.LINK}') THEN regexp_replace(regexp_extract(p, '\\[([^\\]]*)\\]', 1), '`([^`]*)`', '\\1', 'g') ELSE p END"
    )
    bare = f"regexp_replace(replace(translate(array_to_string(list_transform({parts}, lambda p: {said}), ''), '*_', ''), '~~', ''), '(?m)^[{B}]*#{{1,6}}', '', 'g')"
    words = f"array_to_string(list_filter(regexp_split_to_array({bare}, '(?:{T.HANDLE})|[{B}]+'), lambda w: w <> ''), ' ')"
    return f"rtrim(regexp_extract({words}, '(?s)\\A(.*?)(?:{T.EDIT}|\\z)', 1))"


USABLE_SQL = (
    "length(t) >= 8 AND NOT regexp_matches(t, '" + T.SCORE + "') AND NOT regexp_matches(t, '" + T.NOISE + f"') AND NOT regexp_matches(t, ':[{B}]*\\z') "
    f"AND len(list_filter(regexp_split_to_array(t, '[{B}]+'), lambda w: regexp_matches(w, '[A-Za-z0-9]'))) >= 3"
)
LINES_USABLE_SQL = f"""
WITH {TEXT_LINES_SQL}, n AS (SELECT doc_id, pos, {_normal_sql('line')} AS t FROM text_lines)
SELECT doc_id, pos, sha256(t) AS text_sha256, {USABLE_SQL} AS usable FROM n"""


def ordered_distinct_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sixty different lines of each source, by document and place."""
    from pyspark.sql import Window

    src = views.table(spark, sf_dir, "documents").select("doc_id", "source")
    lines = views.text_lines(spark, sf_dir).join(src, "doc_id").withColumn("key", T.distinct_key(F.col("line")))
    firsts = lines.groupBy("source", "key").agg(F.min(F.struct("doc_id", "pos", "line")).alias("f")).select("source", "f.*")
    w = Window.partitionBy("source").orderBy("doc_id", "pos")
    return firsts.withColumn("n", F.row_number().over(w)).where("n <= 60").select("source", "n", "doc_id", "pos")


DISTINCT_SQL = f"""
WITH {TEXT_LINES_SQL},
k AS (SELECT source, doc_id, pos, regexp_replace(lower(line), '[^a-z0-9 ]', '', 'g') AS key FROM text_lines JOIN documents USING (doc_id)),
f AS (SELECT source, key, min(struct_pack(doc_id := doc_id, pos := pos)) AS f FROM k GROUP BY ALL)
SELECT source, CAST(n AS INT) AS n, f.doc_id AS doc_id, f.pos AS pos FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY f.doc_id, f.pos) AS n FROM f) WHERE n <= 60"""


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(T.sentences(F.coalesce("text", F.lit("")))).alias("pos", "sentence"))


def split_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_descriptions(views.table(spark, sf_dir, "documents").select("doc_id", "text"))


def montage_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pasted passages to clips, over all documents as lines; a description without a match stays."""
    from cuelight.functions import vectors as V
    from cuelight.operators.building import build_cuts

    embed = lambda text: V.hash_embedding(text, 64)
    pastes = views.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    lines = views.spoken(spark, sf_dir).withColumn("embedding", embed(F.col("text")))
    clips = build_cuts(pastes, lines, embed=embed, min_idf=3.0)
    return clips.select("query_id", "clip.description", F.size("clip.alternates").alias("n_alternates"), F.get("clip.alternates", 0)["line_id"].alias("line_id"))


QUERIES = {
    f.__name__: f
    for f in (
        timecode_parse, cue_clean, srt_parse, dialogue_windows, dialogue_windows_capped, window_text, quoted_spans, season_episode_hint, season_scope,
        position_hint, episode_name_match, split_lines_usable, ordered_distinct_cap, sentence_split, split_descriptions, montage_build,
    )
}
SQL = {
    "timecode_parse": f"WITH {CUES_SQL} SELECT video_id, cue, start_ms, end_ms FROM cues",
    "cue_clean": f"WITH c AS (SELECT page_id, {clean_sql(chr(99) + 'oalesce(html, ' + chr(39) * 2 + ')')} AS c FROM pages) SELECT page_id, sha256({shout_sql('c')}) AS text_sha256 FROM c",
    "srt_parse": SRT_SQL,
    "dialogue_windows": windows_sql(14_000, 3_000, 6, 2, WINDOW_COLUMNS),
    "dialogue_windows_capped": windows_sql(60_000, 30_000, 3, 2, WINDOW_COLUMNS),
    "window_text": windows_sql(60_000, 30_000, 4, 1, WINDOW_TEXT),
    "quoted_spans": f"WITH {PROMPTS_SQL} SELECT query_id, array_to_string({SPANS_SQL.format('text')}, '|') AS spans FROM prompts",
    "season_episode_hint": NUMBERED_SQL,
    "season_scope": SEASON_SQL,
    "position_hint": POSITION_SQL,
    "episode_name_match": NAME_SQL,
    "sentence_split": f"""
SELECT doc_id, CAST(i - 1 AS INT) AS pos, s[i] AS sentence
FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[{B}]+([A-Z"“''(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)),
        lambda x: regexp_replace(x, '\\A[{B}]+|[{B}]+\\z', '', 'g')), lambda x: x <> '') AS s FROM documents), unnest(range(1, len(s) + 1)) AS r(i)""",
    "split_lines_usable": LINES_USABLE_SQL,
    "ordered_distinct_cap": DISTINCT_SQL,
}
