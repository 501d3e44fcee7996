"""A catalogue read from a live server (one in this process) and from its saved pages."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from cuelight.sources import catalogue as C

ITEMS = [
    {
        "Id": f"i{k:03d}", "Name": f"{'Boats' if k % 3 == 0 else 'Apples'} {k:03d}", "Type": ("Series", "Movie", "Episode")[k % 3], "ProviderIds": {"Tvdb": str(k // 6) if k % 3 == 0 else "", "Imdb": None},
        "RunTimeTicks": 15_005_000 if k else None, "MediaSources": [{"Id": "s", "MediaStreams": [{"Index": 2, "Type": "Audio", "Language": "eng"}]}, {"Id": "t"}] if k % 2 else None, "Extra": {"a": [1]},
    }
    for k in range(90)
]


@pytest.fixture
def server():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urllib.parse.urlparse(self.path)
            q = {k: v[0] for k, v in urllib.parse.parse_qs(url.query).items()}
            asked.append(q)
            if self.headers["Authorization"] != 'MediaBrowser Token="right"':
                self.send_error(401)
                return
            kinds, ids, term = q.get("includeItemTypes"), q.get("ids"), q.get("searchTerm", "").lower()
            fit = [i for i in ITEMS if (not kinds or i["Type"] in kinds.split(",")) and (not ids or i["Id"] in ids.split(",")) and term in i["Name"].lower()]
            start = int(q.get("startIndex", 0))
            body = json.dumps({"Items": fit[start : start + int(q["limit"])], "TotalRecordCount": len(fit)}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    running = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{running.server_address[1]}", asked
    running.shutdown()


def pages(asked):
    return sorted((int(q["startIndex"]), int(q["limit"]), q.get("includeItemTypes"), q.get("ids"), q.get("searchTerm")) for q in asked if q["limit"] != "0")


def test_filters_choose_the_pages(spark, server):
    url, asked = server
    read = lambda **o: C.read_server(spark, url, "right", page=20, **o)
    assert read().count() == 90
    assert pages(asked) == [(k, min(20, 90 - k), None, None, None) for k in range(0, 90, 20)]
    asked.clear()
    movies = read().where("kind = 'Movie'")
    assert movies.count() == 30 and {r.kind for r in movies.collect()} == {"Movie"}
    assert set(pages(asked)) == {(0, 20, "Movie", None, None), (20, 10, "Movie", None, None)}
    asked.clear()
    assert {r.id for r in read().where(F.col("id").isin("i004", "i005", "nothing")).collect()} == {"i004", "i005"}
    assert pages(asked) == [(0, 2, None, "i004,i005,nothing", None)]
    asked.clear()
    assert read().where(F.col("name").contains("Boats 0")).count() == 30 and read().where(F.col("name").contains("boats")).count() == 0
    assert set(pages(asked)) == {(0, 20, None, None, "Boats 0"), (20, 10, None, None, "Boats 0"), (0, 20, None, None, "boats"), (20, 10, None, None, "boats")}
    asked.clear()
    assert read(limit=25).count() == 25 and pages(asked) == [(0, 20, None, None, None), (20, 5, None, None, None)]
    asked.clear()
    assert read().where("kind = 'Movie' and kind in ('Series', 'Episode')").count() == 0 and pages(asked) == []


def test_titles_and_their_total(spark, server):
    url, asked = server
    items, total = C.server_titles(spark, url, "right", page=25)
    # every two series that follow each other have one id elsewhere
    assert items.count() == 45 and total.first().total == 45
    first = items.first()
    assert (first.id, first.kind, first.runtime_ms, first.provider_ids) == ("i001", "Movie", 1501, {})
    assert [(s.id, len(s.streams)) for s in first.sources] == [("s", 1), ("t", 0)] and first.sources[0].streams[0].is_default is False
    # a limit cuts what is listed, not what is there
    items, total = C.server_titles(spark, url, "right", limit=20, page=25)
    got = items.collect()
    assert total.first().total == 60 - (20 - len(got)) and len(got) < 20
    assert C.server_titles(spark, url, "right", term="BOAT")[1].first().total == 15
    assert {r.id for r in C.server_items(spark, url, ["i000", "i089"], "right").collect()} == {"i000", "i089"}


def test_what_goes_wrong_is_said(spark, server):
    url, _ = server
    with pytest.raises(Exception, match=r"rejected the key \(401\)"):
        C.read_server(spark, url, "wrong").count()
    with pytest.raises(C.CatalogueError, match="no server could be reached"):
        C.fetch("http://127.0.0.1:9", "", "/Items", {})


def test_a_snapshot_has_the_same_items(spark, server, tmp_path):
    url, _ = server
    for k in range(0, 90, 40):
        (tmp_path / f"{k}.json").write_text(json.dumps({"Items": ITEMS[k : k + 40], "TotalRecordCount": 90}, indent=1))
    (tmp_path / "empty.json").write_text(json.dumps({"Items": None}))
    saved = sorted(map(str, C.read_snapshot(spark, str(tmp_path)).collect()))
    live = C.items_of(C.read_server(spark, url, "right").select(F.from_json("item", C.ITEM).alias("item")))
    assert saved == sorted(map(str, live.collect())) and len(saved) == 90
