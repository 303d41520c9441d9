"""From nested API documents to flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions.text import iso_seconds

WATCH_URL = "https://www.youtube.com/watch?v="  # fixed value: the address of a video


def count_of(column: Column) -> Column:
    """A number sent as text; absent counts as 0."""
    return F.coalesce(column.try_cast("long"), F.lit(0))


def parsed(items: DataFrame, schema: StructType) -> DataFrame:
    """The fields of JSON documents (``item``) by a declared schema; what does not parse has null fields."""
    return items.select(F.from_json("item", schema).alias("x")).select("x.*")


def flat_videos(items: DataFrame) -> DataFrame:
    """One row a video from nested items; equal rows once."""
    return items.select(
        F.col("id").alias("video_id"), F.col("snippet.title").alias("title"), F.col("snippet.publishedAt").alias("published_text"), F.col("snippet.channelId").alias("channel_id"),
        F.col("snippet.channelTitle").alias("channel_title"), count_of(F.col("statistics.viewCount")).alias("views"), count_of(F.col("statistics.likeCount")).alias("likes"),
        count_of(F.col("statistics.commentCount")).alias("comments"), F.col("snippet.description").alias("description"),
        F.array_join(F.coalesce("snippet.tags", F.array()), ", ").alias("video_tags"), iso_seconds(F.col("contentDetails.duration")).alias("duration_seconds"), F.concat(F.lit(WATCH_URL), "id").alias("video_url"),
    ).dropDuplicates()


def popular(videos: DataFrame, min_views: int, min_comments: int) -> DataFrame:
    return videos.where((F.col("views") >= min_views) & (F.col("comments") >= min_comments))


def without_repeats(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` with equal rows once, and one row (n_rows, n_kept, n_removed)."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return df.dropDuplicates(), groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_kept"), (F.coalesce(F.sum("_n"), F.lit(0)) - F.count("*")).alias("n_removed"))


def flat_channels(items: DataFrame) -> DataFrame:
    """(channel_id, channel_subscribers, channel_country) from JSON documents of channels."""
    return parsed(items, schemas.CHANNEL_ITEM).select(F.col("id").alias("channel_id"), count_of(F.col("statistics.subscriberCount")).alias("channel_subscribers"), F.col("snippet.country").alias("channel_country"))


def enriched(videos: DataFrame, channels: DataFrame) -> DataFrame:
    """Videos with their channel's subscribers and country; null where the channel is unknown."""
    return videos.join(channels.select("channel_id", "channel_subscribers", "channel_country").dropDuplicates(["channel_id"]), "channel_id", "left")


def flat_threads(pages: DataFrame, max_comments: int | None = None) -> DataFrame:
    """Comments from JSON documents of threads (video_id, page_pos, item): a row for each top comment and each of its replies, in one pass.

    ``max_comments`` counts comments and replies of a video alike, in the order of the pages.  Documents that say how
    many came ``before`` them are cut where they are; others are numbered by video first.
    """
    counted = "before" in pages.columns
    rows = pages.select("video_id", "page_pos", *["before"] * counted, F.from_json("item", schemas.COMMENT_THREAD).alias("t"))
    top = F.col("t.snippet.topLevelComment")
    parent = F.struct(top.alias("c"), F.lit(False).alias("is_reply"), F.lit(None).cast("string").alias("reply_to"))
    replies = F.transform(F.coalesce("t.replies.comments", F.array()), lambda r: F.struct(r.alias("c"), F.lit(True).alias("is_reply"), top["id"].alias("reply_to")))
    every = rows.where(top["id"].isNotNull()).select("video_id", "page_pos", *["before"] * counted, F.posexplode(F.concat(F.array(parent), replies)).alias("at", "x"))
    if max_comments is not None and counted:
        every = every.where(F.col("before") + F.col("at") < max_comments)
    elif max_comments is not None:
        number = F.row_number().over(Window.partitionBy("video_id").orderBy("page_pos", "at"))
        every = every.withColumn("rn", number).where(F.col("rn") <= max_comments)
    said = F.col("x.c.snippet")
    return every.select(
        "video_id", F.col("x.c.id").alias("comment_id"), said["textDisplay"].alias("text"), said["authorDisplayName"].alias("author_name"), said["authorChannelId"]["value"].alias("author_id"),
        F.try_to_timestamp(said["publishedAt"]).alias("published_at"), said["likeCount"].alias("likes"), F.col("x.is_reply").alias("is_reply"), F.col("x.reply_to").alias("reply_to_comment_id"),
    )


def first_per_video(comments: DataFrame, n: int, page: int | None = None) -> DataFrame:
    """The first ``n`` comments of each video by row_pos; with ``page``, whole pages until ``n`` are reached."""
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("row_pos"))
    bound = n if page is None else -(-n // page) * page
    return comments.withColumn("rn", number).where(F.col("rn") <= bound)
