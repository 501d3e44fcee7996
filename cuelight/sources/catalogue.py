"""A media server's catalogue: a live server as a data source, and snapshots of its pages.

The server is asked once how many items fit, and its pages are the partitions;
what kinds, names and ids a plan filters by goes to the server with every page, and so
does the limit. Rows carry an item in the server's own form, as snapshots
do, and both are read by the same expressions.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains

from cuelight.operators.library import collapse_titles, ticks_to_ms

# Fields of the server's items, kinds of titles, and what is asked for with them.
STREAM = "struct<Index:int,Type:string,Codec:string,Language:string,IsDefault:boolean,IsForced:boolean,IsTextSubtitleStream:boolean,IsHearingImpaired:boolean>"
ITEM = (
    "Id string, Name string, Type string, ProductionYear int, ParentIndexNumber int, IndexNumber int, RunTimeTicks long, "
    f"ProviderIds map<string,string>, MediaSources array<struct<Id:string,MediaStreams:array<{STREAM}>>>"
)
TITLE_KINDS = ("Series", "Movie")
FIELDS = "ProductionYear,ProviderIds,MediaSources"
#: Items of a page, seconds that one may take, and items of a catalogue that are listed at most.
PAGE, TIMEOUT_S, MOST_TITLES = 200, 30, 1000


class CatalogueError(RuntimeError):
    """What a server answered, in words."""


def fetch(base: str, key: str, path: str, params: dict, timeout: float = TIMEOUT_S) -> dict:
    """One answer of the server, as JSON."""
    query = urllib.parse.urlencode({k: v for k, v in params.items() if v is not None})
    request = urllib.request.Request(f"{base.rstrip('/')}{path}?{query}", headers={"Authorization": f'MediaBrowser Token="{key}"', "Accept": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        said = "the server rejected the key (401)" if e.code == 401 else f"the server returned {e.code} for {path}"
    except TimeoutError:
        said = f"the server did not answer within {timeout:g} s for {path}"
    except urllib.error.URLError as e:
        late = isinstance(e.reason, TimeoutError)
        said = f"the server did not answer within {timeout:g} s for {path}" if late else f"no server could be reached at {base}"
    raise CatalogueError(said)


class Page(InputPartition):
    def __init__(self, start: int, size: int):
        self.start, self.size = start, size


class CatalogueReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.base, self.key = options["url"], options.get("key", "")
        self.page = int(options.get("page", PAGE))
        self.limit = int(options["limit"]) if options.get("limit") else None
        self.params = {"recursive": "true", "sortBy": "SortName", "sortOrder": "Ascending", "fields": FIELDS, "searchTerm": options.get("term") or None}
        self.empty = False

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Kinds and ids are the server's to select; names too, but for their case, so Spark looks again."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In, StringContains)) and len(f.attribute) == 1 else None
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is not None and column in ("id", "kind") and all(isinstance(v, str) and v and "," not in v for v in values):
                self._only("ids" if column == "id" else "includeItemTypes", set(values))
            elif column == "name" and isinstance(f, StringContains) and f.value and not self.params["searchTerm"]:
                self.params["searchTerm"] = f.value
                yield f
            else:
                yield f

    def _only(self, name: str, values: set[str]) -> None:
        known = self.params.get(name)
        kept = values if known is None else values & set(known.split(","))
        self.params[name] = ",".join(sorted(kept))
        self.empty = self.empty or not kept

    def count(self) -> int:
        return 0 if self.empty else int(fetch(self.base, self.key, "/Items", {**self.params, "limit": 0, "enableTotalRecordCount": "true"}).get("TotalRecordCount") or 0)

    def partitions(self) -> list[Page]:
        n = self.count()
        n = n if self.limit is None else min(n, self.limit)
        return [Page(k, min(self.page, n - k)) for k in range(0, n, self.page)] or [Page(0, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        if partition.size:
            answer = fetch(self.base, self.key, "/Items", {**self.params, "startIndex": partition.start, "limit": partition.size})
            for item in answer.get("Items") or []:
                yield item.get("Id"), item.get("Name"), item.get("Type"), json.dumps(item)


class Catalogue(DataSource):
    """Options: ``url``, ``key``, ``term``, ``limit`` and ``page`` (items a request)."""

    @classmethod
    def name(cls) -> str:
        return "media_catalogue"

    def schema(self) -> str:
        return "id string, name string, kind string, item string"

    def reader(self, schema) -> CatalogueReader:
        return CatalogueReader(dict(self.options))


def items_of(items: DataFrame) -> DataFrame:
    """Items in the server's form, as the struct ``item``, in this library's: ticks as milliseconds, empty ids gone."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    stream = lambda m: F.struct(
        m["Index"].alias("index"), m["Type"].alias("type"), m["Codec"].alias("codec"), m["Language"].alias("language"), flag(m["IsDefault"]).alias("is_default"),
        flag(m["IsForced"]).alias("is_forced"), flag(m["IsTextSubtitleStream"]).alias("is_text"), flag(m["IsHearingImpaired"]).alias("is_sdh"),
    )
    streams = lambda s: F.transform(F.coalesce(s["MediaStreams"], F.array().cast(f"array<{STREAM}>")), stream)
    ids = F.map_filter(F.coalesce("item.ProviderIds", F.create_map().cast("map<string,string>")), lambda k, v: F.coalesce(v != "", F.lit(False)))
    sources = F.coalesce("item.MediaSources", F.array().cast(f"array<struct<Id:string,MediaStreams:array<{STREAM}>>>"))
    return items.select(
        F.col("item.Id").alias("id"), F.col("item.Name").alias("name"), F.col("item.Type").alias("kind"), F.col("item.ProductionYear").alias("year"),
        F.col("item.ParentIndexNumber").alias("season"), F.col("item.IndexNumber").alias("episode"), ticks_to_ms(F.col("item.RunTimeTicks")).alias("runtime_ms"),
        ids.alias("provider_ids"), F.transform(sources, lambda s: F.struct(s["Id"].alias("id"), streams(s).alias("streams"))).alias("sources"),
    )


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Items of saved pages, JSON files with ``Items`` each, in any store that Spark reads."""
    pages = spark.read.schema(f"Items array<struct<{_nested(ITEM)}>>").option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
    return items_of(pages.select(F.explode("Items").alias("item")))


def _nested(fields: str) -> str:
    """Columns of a table as fields of a struct."""
    return ",".join(f.replace(" ", ":", 1) for f in fields.split(", "))


def read_server(spark: SparkSession, url: str, key: str = "", term: str | None = None, limit: int | None = None, page: int = PAGE) -> DataFrame:
    """``id, name, kind, item`` of a live server; filters on the first three select its pages."""
    spark.dataSource.register(Catalogue)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"url": url, "key": key, "term": term or "", "limit": "" if limit is None else str(limit), "page": str(page)}
    return spark.read.format("media_catalogue").options(**options).load()


def server_titles(spark: SparkSession, url: str, key: str = "", term: str | None = None, limit: int = MOST_TITLES, page: int = PAGE) -> tuple[DataFrame, DataFrame]:
    """Series and films of a server by name, split ones collapsed, and one row ``total``: what fits there, less what collapsed."""
    raw = read_server(spark, url, key, term, limit, page).where(F.col("kind").isin(*TITLE_KINDS))
    items = items_of(raw.select(F.from_json("item", ITEM).alias("item")))
    kept = collapse_titles(items)
    asked = CatalogueReader({"url": url, "key": key, "term": term or ""})
    asked._only("includeItemTypes", set(TITLE_KINDS))
    gone = items.agg(F.count("*").alias("n")).crossJoin(kept.agg(F.count("*").alias("kept")))  # one row each
    total = gone.select((F.lit(asked.count()) - F.col("n") + F.col("kept")).alias("total"))
    return kept.orderBy(F.lower("name"), "id"), total


def server_items(spark: SparkSession, url: str, ids: list[str], key: str = "") -> DataFrame:
    """The items of some ids in one request for each page of them."""
    raw = read_server(spark, url, key).where(F.col("id").isin(*ids))
    return items_of(raw.select(F.from_json("item", ITEM).alias("item")))


def read_catalogue(spark: SparkSession, folder: str, term: str | None = None, limit: int = MOST_TITLES) -> DataFrame:
    """Titles of a snapshot by name, those that hold ``term``, duplicates collapsed."""
    items = read_snapshot(spark, folder).where(F.col("kind").isin(*TITLE_KINDS))
    if term:
        items = items.where(F.contains(F.lower("name"), F.lit(term.lower())))
    return collapse_titles(items).orderBy(F.lower("name"), "id").limit(limit)
