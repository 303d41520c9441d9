"""A paged REST source, walked inside tasks, and enrichment by id batches; searches by time are in ``paged``.

The transport is a function (endpoint, parameters) -> dict, so tests need no
network and a deployment brings its own client.  Each input partition walks the
pages of one key by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = 100  # threads of one request
Transport = Callable[[str, dict], dict]


@dataclass(frozen=True)
class Search:
    """What a collection run asks for."""

    query: str
    published_after: str | None = None
    published_before: str | None = None
    min_views: int = 0
    min_comments: int = 0
    max_videos: int = 2000
    max_comments: int = 10000
    extra: dict = field(default_factory=dict)

    def parameters(self) -> dict:
        named = {"q": self.query, "type": "video", "order": "date", "publishedAfter": self.published_after, "publishedBefore": self.published_before}
        return {k: v for k, v in (named | self.extra).items() if v is not None}


def pages(transport: Transport, endpoint: str, parameters: dict, limit: int | None = None) -> Iterator[dict]:
    """Items of all pages; ends at an empty page, a missing token or ``limit`` items."""
    given, token = 0, None
    while True:
        page = transport(endpoint, parameters | ({"pageToken": token} if token else {}))
        items = page.get("items") or []
        for item in items:
            if limit is not None and given >= limit:
                return
            given += 1
            yield item
        token = page.get("nextPageToken")
        if not items or not token:
            return


def chunks(items: list, n: int) -> Iterator[list]:
    for at in range(0, len(items), n):
        yield items[at : at + n]


def search(spark: SparkSession, transport: Transport, asked: Search) -> DataFrame:
    """video_id of every search hit up to ``max_videos``; paging is sequential by nature and yields ids only."""
    rows = [(x["id"]["videoId"],) for x in pages(transport, "search", asked.parameters() | {"maxResults": 50}, asked.max_videos)]
    return spark.createDataFrame(rows, "video_id string").distinct()


def lookup(ids: DataFrame, column: str, transport: Transport, endpoint: str, batch: int = 50) -> DataFrame:
    """One JSON document for each id found, asked for in batches of ``batch`` ids."""
    import json

    def run(parts):
        held: list[str] = []

        def ask() -> list[str]:
            got = transport(endpoint, {"id": ",".join(held)}).get("items") or []
            held.clear()
            return [json.dumps(x) for x in got]

        import pandas as pd

        for frame in parts:
            for value in frame[column]:
                held.append(value)
                if len(held) == batch:
                    yield pd.DataFrame({"item": ask()})
        if held:
            yield pd.DataFrame({"item": ask()})

    return ids.select(column).where(F.col(column).isNotNull()).distinct().mapInPandas(run, "item string")


def comment_threads(ids: DataFrame, transport: Transport, max_comments: int | None = None) -> DataFrame:
    """(video_id, page_pos, item, before): the thread documents of each video, walked inside its task.

    ``before`` counts the video's comments and replies in earlier documents, of which one without a top comment has
    none.  Paging ends once ``max_comments`` have come; ``collect.flat_threads`` cuts at the very number.
    """
    import json

    import pyarrow as pa

    schema = pa.schema([("video_id", pa.string()), ("page_pos", pa.int64()), ("item", pa.string()), ("before", pa.int64())])

    def comments_in(item: dict) -> int:
        top = (item.get("snippet") or {}).get("topLevelComment") or {}
        return 0 if top.get("id") is None else 1 + len((item.get("replies") or {}).get("comments") or [])

    def run(parts):
        encode = json.JSONEncoder(ensure_ascii=False).encode
        for part in parts:
            rows: tuple[list, ...] = ([], [], [], [])
            for video in part.column(0).to_pylist():
                said = 0
                for at, item in enumerate(pages(transport, "commentThreads", {"videoId": video, "maxResults": PAGE})):
                    if max_comments is not None and said >= max_comments:
                        break
                    for column, value in zip(rows, (video, at, encode(item), said)):
                        column.append(value)
                    said += comments_in(item)
                    if len(rows[0]) == PAGE:  # no more than a page's threads are held, of one video or of several
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)
                        rows = ([], [], [], [])
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    # a given number of tasks, before the ids are made distinct: they are so short that Spark would hand them to a few
    tasks = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ids.select("video_id").where("video_id is not null").repartition(tasks, "video_id").distinct().mapInArrow(run, "video_id string, page_pos bigint, item string, before bigint")


def transcripts(ids: DataFrame, transport: Transport, language: str = "es") -> DataFrame:
    """(video_id, snippets) of each video; null snippets where none can be had, so one video never ends the job."""

    def run(parts):
        import pandas as pd

        def one(video: str) -> list[dict] | None:
            try:
                return [{"text": x["text"]} for x in transport("transcript", {"videoId": video, "lang": language})["items"]]
            except Exception:
                return None

        for frame in parts:
            yield pd.DataFrame({"video_id": frame["video_id"], "snippets": [one(v) for v in frame["video_id"]]})

    return ids.select("video_id").distinct().mapInPandas(run, "video_id string, snippets array<struct<text: string>>")
