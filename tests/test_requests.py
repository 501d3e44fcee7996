from pyspark.sql import functions as F

from cuelight.operators.hints import read_requests, scope_of
from cuelight.operators.splitting import split_descriptions

EPISODES = [("e1", "Harbour", 1, 1), ("e2", "The Long Dinner", 1, 2), ("e3", "Dinner", 2, 1), ("e4", "Rain Again", 2, 2), ("e5", "Special", None, None)]


def asked(spark, *texts):
    q = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    e = spark.createDataFrame(EPISODES, "video_id string, name string, season int, episode int")
    requests = read_requests(q, e)
    videos = {r.query_id: sorted(r.ids) for r in scope_of(requests, e).groupBy("query_id").agg(F.collect_list("video_id").alias("ids")).collect()}
    return {r.query_id: (r.text, videos.get(r.query_id), r.label, r.when) for r in requests.collect()}


def test_requests(spark):
    got = asked(
        spark,
        'they argue in "the long dinner." by the stove',
        "cold open of Rain Again with umbrellas",
        "he falls in s2e1 at the very end",
        "the season one finale",
        "season two, all of it",
        "it's 10 minutes in, harbour",
        '"Special"',
        'she says "leave me be" in 1x02',
        "opening scene and the ending",
    )
    assert got[0] == ("they argue in by the stove", ["e2"], "The Long Dinner (S1E2)", None)
    assert got[1] == ("cold open of Rain Again with umbrellas", ["e4"], "Rain Again (S2E2)", "opening")
    assert got[2][1:] == (["e3"], "Dinner (S2E1)", "ending")
    assert got[3][1:3] == (["e2"], "The Long Dinner (S1E2)")
    assert got[4][1:3] == (["e3", "e4"], "season 2")
    assert got[5][1:] == (None, None, None)
    assert got[6] == ('"Special"', ["e5"], "Special", None)
    assert got[7][:3] == ('she says "leave me be" in 1x02', ["e2"], "The Long Dinner (S1E2)")
    assert got[8][3] is None


def test_requests_of_a_title(spark):
    """Titles share numbers and names; one that is given reads its own episodes, and none reads all."""
    episodes = [("a%d" % k, "A", f"Part {k} of a", 1 + k // 4, 1 + k % 4) for k in range(8)] + [("b%d" % k, "B", f"Part {k} of b", 1 + k // 2, 1 + k % 2) for k in range(6)]
    episodes += [("bx", "B", "Part 1 of a", None, None), ("nt", None, "Lone Part", 9, 9)]
    e = spark.createDataFrame(episodes, "video_id string, title_id string, name string, season int, episode int")
    texts = ["a walk in season 2, episode 2", "the season 2 finale", 'talk in "Part 1 of a" here', "they meet in Part 1 of a again", "season 3 of it", "season 1, all", 's9e9 it was']
    rows = [(10 * k + j, t, title) for k, t in enumerate(texts) for j, title in enumerate(("A", "B", None, "C"))]
    q = spark.createDataFrame(rows, "query_id long, text string, title_id string")
    requests = read_requests(q, e)
    told = {r.query_id: (r.title_id, r.video_id) for r in requests.collect()}
    assert [told[k] for k in range(4)] == [("A", "a5"), ("B", "b3"), (None, "a5"), ("C", None)]
    assert [told[k][1] for k in range(10, 14)] == ["a7", "b3", "a7", None]
    assert [told[k][1] for k in range(20, 24)] == ["a1", "bx", "bx", None]
    assert [told[k][1] for k in range(30, 34)] == ["a1", "bx", "bx", None]
    assert [told[k][1] for k in range(60, 64)] == [None, None, "nt", None]
    scope = {}
    for r in scope_of(requests, e).collect():
        scope.setdefault(r.query_id, []).append(r.video_id)
    assert sorted(scope[41]) == ["b4", "b5"] and sorted(scope[42]) == ["b4", "b5"] and 40 not in scope
    assert [sorted(scope[k]) for k in (50, 51, 52)] == [["a0", "a1", "a2", "a3"], ["b0", "b1"], ["a0", "a1", "a2", "a3", "b0", "b1"]]


def split(spark, text, **options):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [r.description for r in split_descriptions(df, **options).orderBy("pos").collect()]


def test_split(spark):
    assert split(spark, "> - 1. the one on the **roof** edit: typo\nu/some_one the boat scene again\nlol\n12 points\nBest of all these:\n") == [
        "the one on the roof",
        "the boat scene again",
    ]
    paste = "the one with the kite\r\nAd\r\nshoes that fit every day\r\nshop.example\r\nThe one with THE kite!\r\nAd\r\nthe last one of them"
    assert split(spark, paste) == ["the one with the kite", "the last one of them"]
    assert split(spark, '"I will not go there today." Great!') == ["I will not go there today."]
    long = "He drops the whole cake on the floor. " * 3 + "She laughs at him for an hour! " * 2 + "Then they both leave the house for good, and the credits roll over it."
    assert split(spark, long) == ["He drops the whole cake on the floor.", "She laughs at him for an hour!", "Then they both leave the house for good, and the credits roll over it."]
    assert split(spark, "") == [] and split(spark, None) == []
    assert len(split(spark, "\n".join(f"scene number {k} there" for k in range(80)))) == 60
    names = spark.createDataFrame([("x", "the long dinner", 1, 1)], "video_id string, name string, season int, episode int")
    assert split(spark, 'the quarrel in "the long dinner."', episodes=names) == ['the quarrel in "the long dinner."']


def test_episodes_of_one_name_meet_a_text_once(spark, monkeypatch):
    """Many episodes share a name or a number: the one that is taken is found before texts meet it."""
    from cuelight.operators import hints

    rows, first = [], hints._first
    monkeypatch.setattr(hints, "_first", lambda found, *order: rows.append(found.count()) or first(found, *order))
    e = spark.range(150).selectExpr("cast(1000 - id as string) video_id", "'Old Plate' name", "cast(id % 3 as int) season", "1 episode")
    q = spark.range(150).selectExpr("id query_id", "'s1e1 of \"old plate\", the Old Plate' text")
    found = [f(q, e).collect() for f in (hints.quoted_episode, hints.unquoted_episode, hints.numbered_episode)]
    assert max(rows) <= 150
    assert [{(r.video_id, r.label) for r in f} for f in found] == [{("1000", "Old Plate (S0E1)")}, {("1000", "Old Plate (S0E1)")}, {("852", "Old Plate (S1E1)")}] and all(len(f) == 150 for f in found)


def test_names_of_any_characters_stand_apart(spark):
    """Names are looked up as they stand, also where they hold signs or begin and end with them, and not next to letters."""
    from cuelight.operators.hints import unquoted_episode

    names = [("a", r"A \E B"), ("b", "(So It"), ("c", "Went On)"), ("d", "It’s  Late 😀")]
    e = spark.createDataFrame([(v, n, 1, k) for k, (v, n) in enumerate(names)], "video_id string, name string, season int, episode int")
    texts = [r"on A \E B.", r"on A \E Bee", "x (So It was", "x(So It was", "he Went On)", "he Went On)s", "and It's  Late 😀", "It's Late 😀", None]
    q = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    assert {r.query_id: r.video_id for r in unquoted_episode(q, e).collect()} == {0: "a", 2: "b", 4: "c", 6: "d"}


def test_only_marks_of_posts_are_shuffled(spark):
    """Posts are found from their markers and closers, and met where lines are read; what is cut is as it was."""
    from cuelight.operators.splitting import drop_promoted

    texts = ["a\nAd\nx\nshop.example\nb", "\u00a0promoted \nx\nThumbnail image: y\nAd\nz", "Ad\n" + "x\n" * 11 + "shop.example", "Ad\n" + "x\n" * 10 + "shop.example\nb", "plain"]
    rows = [(k, p, t) for k, text in enumerate(texts) for p, t in enumerate(text.split("\n"))]
    kept = drop_promoted(spark.createDataFrame(rows, "doc_id int, pos int, line string"))
    assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
    got = {k: [r.pos for r in kept.where(f"doc_id = {k}").orderBy("pos").collect()] for k in range(5)}
    assert got == {0: [0, 4], 1: [3, 4], 2: list(range(13)), 3: [12], 4: [0]}
