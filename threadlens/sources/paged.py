"""Searches by time of publication as a batch data source.

A search endpoint gives a bounded number of results however it is paged.  The
source halves the range of publication until each piece promises no more than
``most`` results (a request for the total each), and every piece is a partition
that pages through its own results inside its task: ids never pass the driver,
and what plans the read grows with the pieces.  Filters on ``published_at``
narrow the range before it is halved.

A piece that cannot be halved any more (``finest`` seconds) is read as it is.
Points in time are text like 2024-01-01T00:00:00Z, whose order is that of time.
Pieces share no moment, so a result appears once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .api import Search, Transport, pages

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def moment(text: str) -> datetime:
    found = datetime.fromisoformat(text)
    return found.astimezone(timezone.utc) if found.tzinfo else found.replace(tzinfo=timezone.utc)


def spelled(at: datetime) -> str:
    return at.strftime("%Y-%m-%dT%H:%M:%SZ")


@dataclass
class Piece(InputPartition):
    """Results published from ``after`` on and before ``before``."""

    after: str
    before: str

    def __post_init__(self) -> None:
        super().__init__((self.after, self.before))


class Reader(DataSourceReader):
    def __init__(self, transport: Transport, asked: Search, most: int, finest: int):
        self.transport, self.asked, self.most, self.finest = transport, asked, most, finest
        self.after, self.before = moment(asked.published_after), moment(asked.published_before)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        second = timedelta(seconds=1)
        for one in filters:
            if getattr(one, "attribute", None) == ("published_at",) and isinstance(one, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                try:
                    at = moment(one.value)
                except ValueError:
                    at = None
                if at is not None:
                    if isinstance(one, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                        self.after = max(self.after, at)
                    if isinstance(one, (EqualTo, LessThan, LessThanOrEqual)):
                        self.before = min(self.before, at + second)
            yield one  # Spark applies every filter as well

    def _asked(self, after: datetime, before: datetime) -> dict:
        return self.asked.parameters() | {"publishedAfter": spelled(after), "publishedBefore": spelled(before)}

    def partitions(self) -> list[InputPartition]:
        out, held = [], [(self.after, self.before)]
        while held:
            after, before = held.pop()
            if after >= before:
                continue
            total = self.transport("search", self._asked(after, before) | {"maxResults": 0})["pageInfo"]["totalResults"]
            half = (after + (before - after) / 2).replace(microsecond=0)
            if total > self.most and (before - after).total_seconds() > self.finest and after < half:
                held += [(half, before), (after, half)]
            elif total:
                out.append(Piece(spelled(after), spelled(before)))
        return out or [Piece(spelled(self.after), spelled(self.after))]

    def read(self, partition: Piece) -> Iterator[tuple]:
        if partition.after < partition.before:
            for item in pages(self.transport, "search", self._asked(moment(partition.after), moment(partition.before)) | {"maxResults": 50}):
                yield item["id"]["videoId"], item["snippet"]["publishedAt"]


def search_source(transport: Transport, asked: Search, most: int = 500, finest: int = 1) -> type[DataSource]:
    """The data source of one search, which must say from when to when."""
    if not asked.published_after or not asked.published_before:
        raise ValueError("a search by time needs both ends")

    class VideoSearch(DataSource):
        @classmethod
        def name(cls) -> str:
            return "video_search"

        def schema(self) -> str:
            return "video_id string, published_at string"

        def reader(self, schema) -> DataSourceReader:
            return Reader(transport, asked, most, finest)

    return VideoSearch


def searched(spark: SparkSession, transport: Transport, asked: Search, most: int = 500) -> DataFrame:
    """(video_id, published_at) of every result between both ends."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(search_source(transport, asked, most))
    return spark.read.format("video_search").load()
