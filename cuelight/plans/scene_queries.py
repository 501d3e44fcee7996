"""Descriptions read for episodes, scene searches of titles and of the library, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.functions import text as T
from cuelight.operators import hints
from cuelight.operators import postings as P
from cuelight.operators import retrieval as R
from cuelight.plans import views
from cuelight.plans.retrieval_queries import DISTANCE, TERMS_SQL, TOKENS_SQL
from cuelight.plans.text_queries import EPISODES_SQL, PROMPTS_SQL, SPANS_SQL, B, episodes, key_sql, prompts, squeeze_sql
from cuelight.session import shared_folder

#: An episode by its numbers, in the forms' order of trust.
NUMBERED = (
    "(?i)\\bs(\\d{1,2})\\s*(?:ep(?:isode)?|e)\\s*(\\d{1,2})\\b",
    "(?i)\\bseason\\s*(\\d{1,2})\\s*,?\\s*(?:ep(?:isode)?|e)\\s*(\\d{1,2})\\b",
    "(?i)\\b(\\d{1,2})x(\\d{1,2})\\b",
)
#: Least rarity of a term in the scene queries: a title of the small tables has about fifty lines.
RARE = 2.0


def read_sql(prompts: str = "prompts", episodes: str = "episodes") -> str:
    """``reading``: what each of ``prompts(query_id, title_id, text)`` says about where to look, in ``episodes`` of its title or all."""
    forms = ", ".join(f"({k}, '{p}')" for k, p in enumerate(NUMBERED, 1))
    trim = lambda x: f"regexp_replace({x}, '\\A[{B}]+|[{B}]+\\z', '', 'g')"
    label = "CASE WHEN season IS NOT NULL AND episode IS NOT NULL THEN name || ' (S' || season || 'E' || episode || ')' ELSE name END"
    gone = "t"
    for a, z in (('"', '"'), ("“", "”"), ("“", '"'), ('"', "”")):
        gone = f"replace({gone}, '{a}' || s || '{z}', ' ')"
    return f"""
asked AS (SELECT query_id, text, coalesce('=' || title_id, '') AS scope FROM {prompts}),
eps AS (SELECT *, '' AS scope FROM {episodes} UNION ALL SELECT *, '=' || title_id FROM {episodes} WHERE title_id IS NOT NULL),
spans AS (SELECT query_id, scope, i AS ord, s[i] AS span, {key_sql('s[i]')} AS key FROM (SELECT query_id, scope, {SPANS_SQL.format('text')} AS s FROM asked), unnest(range(1, len(s) + 1)) AS r(i)),
named AS (SELECT *, {key_sql('name')} AS key FROM eps),
q AS (SELECT query_id, arg_min({{'v': video_id, 'l': {label}}}, (ord, coalesce(season, -1), coalesce(episode, -1), video_id)) AS hit, list(DISTINCT span) AS names
  FROM spans JOIN named USING (scope, key) WHERE key <> '' GROUP BY query_id),
first_words AS (SELECT DISTINCT query_id, scope, line, unnest(regexp_extract_all(line, '[A-Za-z0-9]+|[^A-Za-z0-9]')) AS word FROM (SELECT query_id, scope, translate(text, '’‘', '''''') AS line FROM asked)),
plain AS (SELECT *, regexp_extract(n, '^([A-Za-z0-9]+|[^A-Za-z0-9])', 1) AS word FROM (SELECT *, translate({trim('name')}, '’‘', '''''') AS n FROM eps) WHERE len(regexp_split_to_array(n, '[{B}]+')) >= 2),
u AS (SELECT query_id, arg_min({{'v': video_id, 'l': {label}}}, (-length(n), coalesce(season, -1), coalesce(episode, -1), video_id)) AS hit
  FROM first_words JOIN plain USING (scope, word) WHERE contains(line, n) AND regexp_matches(line, '(^|[^A-Za-z0-9])' || regexp_escape(n) || '($|[^A-Za-z0-9])') GROUP BY query_id),
forms AS (SELECT query_id, scope, ord, TRY_CAST(regexp_extract(text, p, 1) AS INT) AS season, TRY_CAST(regexp_extract(text, p, 2) AS INT) AS episode
  FROM asked, (VALUES {forms}) AS f(ord, p) WHERE regexp_matches(text, p)),
n AS (SELECT query_id, arg_min({{'v': video_id, 'l': {label}}}, (ord, video_id)) AS hit FROM forms JOIN eps USING (scope, season, episode) GROUP BY query_id),
seasons AS (
  SELECT query_id, scope, coalesce(
    TRY_CAST(nullif(regexp_extract(text, '(?i)\\bs(\\d{{1,2}})\\b', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(text, '(?i)\\bseason\\s*(\\d{{1,2}})\\b', 1), '') AS INT),
    CAST(nullif(list_position(['one','two','three','four','five','six','seven','eight','nine','ten'], lower(regexp_extract(text, '(?i)\\bseason\\s+([a-z]+)\\b', 1))), 0) AS INT)) AS season,
    CASE WHEN regexp_matches(text, '(?i)\\b(finale|final episode|last episode)\\b') THEN 'last' WHEN regexp_matches(text, '(?i)\\b(premiere|première|first episode)\\b') THEN 'first' END AS e
  FROM asked),
ends AS (SELECT scope, season, arg_max({{'v': video_id, 'l': {label}}}, (episode, video_id)) AS last, arg_min({{'v': video_id, 'l': {label}}}, (episode, video_id)) AS first FROM eps WHERE season IS NOT NULL GROUP BY scope, season),
s AS (SELECT query_id, CASE e WHEN 'last' THEN last WHEN 'first' THEN first ELSE {{'v': NULL, 'l': 'season ' || season}} END AS hit, CASE WHEN e IS NULL THEN season END AS season FROM seasons JOIN ends USING (scope, season)),
reading AS (
  SELECT a.query_id, a.scope, f.found.v AS video_id, CASE WHEN q.hit IS NULL AND u.hit IS NULL AND n.hit IS NULL THEN s.season END AS season, f.found.l AS label,
    CASE WHEN q.hit IS NOT NULL AND {squeeze_sql(f'list_reduce(q.names, lambda t, s: {gone}, a.text)')} <> '' THEN {squeeze_sql(f'list_reduce(q.names, lambda t, s: {gone}, a.text)')} ELSE {trim('a.text')} END AS text,
    CASE WHEN regexp_matches(a.text, '{T.OPENING}') AND NOT regexp_matches(a.text, '{T.ENDING}') THEN 'opening' WHEN regexp_matches(a.text, '{T.ENDING}') AND NOT regexp_matches(a.text, '{T.OPENING}') THEN 'ending' END AS "when"
  FROM asked a LEFT JOIN q USING (query_id) LEFT JOIN u USING (query_id) LEFT JOIN n USING (query_id) LEFT JOIN s USING (query_id), LATERAL (SELECT coalesce(q.hit, u.hit, n.hit, s.hit) AS found) f)
"""


def scene_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hints.read_requests(prompts(spark, sf_dir), episodes(spark, sf_dir)).select("query_id", "text", "video_id", "season", "label", "when")


# ---- searches -----------------------------------------------------------------


def scene_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lines: a title is a source, a video of it a language."""
    return views.lines(spark, sf_dir).where("title_id is not null and video_id is not null").withColumn("video_id", F.concat("title_id", F.lit("/"), "video_id"))


def scene_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The videos of every title, numbered by their language, so that titles share seasons and episodes."""
    found = views.table(spark, sf_dir, "documents").where("source is not null and lang is not null").groupBy("source", "lang").agg(F.max(F.col("doc_id") * 7000 + 4000).alias("runtime_ms"))
    code = (F.ascii("lang") + F.ascii(F.substring("lang", 2, 1))) % 4
    return found.select(
        F.concat("source", F.lit("/"), "lang").alias("video_id"), F.col("source").alias("title_id"), F.concat(F.lit("The "), "lang", F.lit(" hour of "), "source").alias("name"),
        (code % 2 + 1).cast("int").alias("season"), F.floor(code / 2).cast("int").alias("episode"), "runtime_ms",
    )


def scene_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages with places to look, two of three for a title."""
    i = F.col("query_id")
    source = F.concat(F.lit("src"), (i % 5).cast("string"))
    where = (
        F.when(i % 7 == 1, F.lit("S1E1 "))
        .when(i % 7 == 2, F.lit("season 2 finale, "))
        .when(i % 7 == 3, F.concat(F.lit('in "The en hour of '), source, F.lit('." ')))
        .when(i % 7 == 4, F.lit("season 1 "))
        .when(i % 7 == 5, F.lit("opening scene of s2e1 "))
        .when(i % 7 == 6, F.concat(F.lit("The de hour of "), source, F.lit(", at the very end ")))
        .otherwise("")
    )
    title = F.when(i % 3 > 0, F.concat(F.lit("src"), (i % 20).cast("string")))
    return views.requests(spark, sf_dir).select("query_id", title.alias("title_id"), F.concat(where, F.coalesce("text", F.lit(""))).alias("text"), "embedding")


def scene_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five scenes for each description, in its title or in the library, named episodes first; by a kept keyword index."""
    lines = scene_lines(spark, sf_dir)
    asked = scene_prompts(spark, sf_dir)
    found = R.scene_search(lines, scene_videos(spark, sf_dir), asked, 5, min_idf=RARE, stemmed=False)
    return found.select("query_id", "place", "line_id", "title_id", "video_id", "start_ms", "score")


def _scoped_bm25_sql(name: str, scope: str) -> str:
    return f"""
{name}_total AS (SELECT query_id, count(*) AS n FROM {scope} JOIN lines USING (video_id) GROUP BY query_id),
{name}_met AS (SELECT t.query_id, t.term, t.times, h.line_id, h.tf, h.len FROM (SELECT query_id, term, count(*) AS times FROM terms GROUP BY ALL) t JOIN hits h USING (term) JOIN lines l USING (line_id)
  JOIN {scope} s ON s.query_id = t.query_id AND s.video_id = l.video_id),
{name}_rare AS (SELECT query_id, term FROM {name}_met JOIN {name}_total USING (query_id) GROUP BY query_id, term, n HAVING ln(n / count(*)) >= {RARE}),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, line_id) AS rank FROM (
  SELECT query_id, line_id, round(sum(times * greatest(ln((total - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 9) AS bm25
  FROM {name}_met JOIN {name}_rare USING (query_id, term) JOIN df USING (term), corpus GROUP BY query_id, line_id))
"""


SCENE_TABLES_SQL = """
lines AS (
  SELECT doc_id AS line_id, source AS title_id, source || '/' || lang AS video_id, doc_id * 7000 AS start_ms, doc_id * 7000 + 4000 AS end_ms, coalesce(text, '') AS text, CAST(embedding AS DOUBLE[]) AS embedding
  FROM documents LEFT JOIN embeddings ON doc_id = vec_id WHERE source IS NOT NULL AND lang IS NOT NULL),
episodes AS (
  SELECT source || '/' || lang AS video_id, source AS title_id, 'The ' || lang || ' hour of ' || source AS name, CAST(code % 2 + 1 AS INT) AS season, CAST(code // 2 AS INT) AS episode, runtime_ms
  FROM (SELECT source, lang, (ascii(lang) + ascii(substr(lang, 2, 1))) % 4 AS code, max(doc_id * 7000 + 4000) AS runtime_ms FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source, lang)),
prompts AS (
  SELECT item_id AS query_id, CASE WHEN item_id % 3 > 0 THEN 'src' || (item_id % 20) END AS title_id, CAST(embedding AS DOUBLE[]) AS embedding,
    CASE item_id % 7 WHEN 1 THEN 'S1E1 ' WHEN 2 THEN 'season 2 finale, ' WHEN 3 THEN 'in "The en hour of src' || (item_id % 5) || '." ' WHEN 4 THEN 'season 1 '
      WHEN 5 THEN 'opening scene of s2e1 ' WHEN 6 THEN 'The de hour of src' || (item_id % 5) || ', at the very end ' ELSE '' END || coalesce(text, '') AS text
  FROM benchmark JOIN embeddings ON item_id = vec_id)
"""
SCENE_SQL = f"""
WITH RECURSIVE {SCENE_TABLES_SQL}, {read_sql()},
requests AS (SELECT r.query_id, p.title_id, r.scope, r.text, r.video_id, r.season, r."when", p.embedding FROM reading r JOIN prompts p USING (query_id) WHERE r.text <> ''),
{TERMS_SQL}, {TOKENS_SQL},
inside AS (SELECT r.query_id, e.video_id FROM requests r JOIN episodes e ON r.title_id IS NULL OR r.title_id = e.title_id),
wanted AS (SELECT query_id, video_id FROM requests WHERE video_id IS NOT NULL UNION SELECT r.query_id, e.video_id FROM requests r JOIN eps e USING (scope, season) WHERE r.video_id IS NULL),
{_scoped_bm25_sql('lexical', 'inside')}, {_scoped_bm25_sql('words', 'wanted')},
vector AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, line_id) AS rank
  FROM (SELECT a.query_id, b.line_id, {DISTANCE} AS distance FROM requests a JOIN inside s USING (query_id) JOIN lines b ON b.video_id = s.video_id WHERE b.embedding IS NOT NULL)) WHERE rank <= 40),
fused AS (
  SELECT query_id, line_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, v_rank ASC NULLS LAST, line_id) AS pos
  FROM (SELECT query_id, line_id, v.rank AS v_rank, round(coalesce(1.0 / (60 + v.rank), 0) + coalesce(CAST(1.5 AS DOUBLE) / (60 + w.rank), 0), 12) AS rrf
        FROM vector v FULL OUTER JOIN (SELECT * FROM lexical WHERE rank <= 40) w USING (query_id, line_id))),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, line_id) AS v_rank FROM (
  SELECT a.query_id, b.line_id, round(CASE WHEN b.embedding IS NULL THEN 2 ELSE {DISTANCE} END, 9) AS d,
    CASE WHEN "when" IS NULL THEN 0 WHEN "when" = 'opening' AND runtime_ms > 0 AND b.start_ms <= CAST(runtime_ms AS DOUBLE) * CAST(0.15 AS DOUBLE) THEN 0
         WHEN "when" = 'ending' AND runtime_ms > 0 AND b.start_ms >= CAST(runtime_ms AS DOUBLE) * CAST(0.85 AS DOUBLE) THEN 0 ELSE 1 END AS band
  FROM requests a JOIN wanted s ON s.query_id = a.query_id JOIN lines b ON b.video_id = s.video_id JOIN episodes e ON e.video_id = s.video_id)),
mixed AS (SELECT n.query_id, n.line_id, band, row_number() OVER (PARTITION BY n.query_id ORDER BY round(1.0 / (60 + v_rank) + coalesce(CAST(1.5 AS DOUBLE) / (60 + w.rank), 0), 12) DESC, v_rank, n.line_id) AS f
  FROM near n LEFT JOIN words w USING (query_id, line_id)),
first_ones AS (SELECT query_id, line_id, row_number() OVER (PARTITION BY query_id ORDER BY band, f) AS pos FROM mixed),
found AS (SELECT query_id, line_id, pos FROM first_ones WHERE pos <= 5 UNION ALL SELECT query_id, line_id, pos + 5 FROM fused),
placed AS (SELECT f.query_id, f.pos, l.line_id, l.video_id, l.start_ms FROM found f JOIN lines l USING (line_id)),
ordered AS (SELECT query_id, list({{'line_id': line_id, 'video_id': video_id, 'start_ms': start_ms}} ORDER BY pos) AS c FROM placed GROUP BY query_id),
walk AS (
  SELECT query_id, c, 1 AS i, CAST([] AS STRUCT(line_id BIGINT, video_id VARCHAR, start_ms BIGINT)[]) AS kept FROM ordered
  UNION ALL
  SELECT query_id, c, i + 1,
         CASE WHEN len(list_filter(kept, lambda x: x.video_id = c[i].video_id AND abs(x.start_ms - c[i].start_ms) < 20000)) > 0 THEN kept ELSE list_append(kept, c[i]) END
  FROM walk WHERE i <= len(c) AND len(kept) < 5),
done AS (SELECT query_id, arg_max(kept, i) AS kept FROM walk GROUP BY query_id),
best AS (SELECT query_id, i - 1 AS place, kept[i].line_id AS line_id FROM done, unnest(range(1, len(kept) + 1)) AS r(i))
SELECT b.query_id, CAST(place AS INT) AS place, b.line_id, l.title_id, l.video_id, l.start_ms, CASE WHEN l.embedding IS NULL THEN 0 ELSE round(greatest(0, 1 - ({DISTANCE.replace('b.embedding', 'l.embedding')}) / 2), 6) END AS score
FROM best b JOIN lines l USING (line_id) JOIN requests a ON a.query_id = b.query_id"""


def stemmed_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best lines by stems and phrases, from a written positional index: lines are read once, to build it."""
    lines, asked = views.spoken(spark, sf_dir), views.requests(spark, sf_dir)
    path = shared_folder(spark, "postings")
    P.build_postings(lines).write.parquet(path)
    kept = spark.read.parquet(path)
    found = R.bm25(lines, asked, 10, min_idf=3.0, postings=kept, corpus=P.corpus_of(P.build_sizes(lines)))
    return found.select("query_id", "line_id", F.round("bm25", 6).alias("bm25"), "rank")


QUERIES = {f.__name__: f for f in (scene_requests, scene_search, stemmed_bm25)}
SQL = {
    "scene_requests": f"""WITH {PROMPTS_SQL.replace('SELECT i AS query_id,', 'SELECT i AS query_id, CAST(NULL AS VARCHAR) AS title_id,')}, {EPISODES_SQL.replace('FROM part)', ', CAST(NULL AS VARCHAR) AS title_id FROM part)').replace('\n  , CAST', ', CAST')}, {read_sql()}
SELECT query_id, text, video_id, season, label, "when" FROM reading""",
    "scene_search": SCENE_SQL,
}
