"""Interaction graphs as vertices and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels


def modal(df: DataFrame, keys: list[str], value: str, order: str = "row_pos") -> DataFrame:
    """The most frequent value of each group, null being one; ties go to the value seen first."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias("mode"))


def last_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst): the last row's attributes win."""
    return edges.groupBy("src", "dst").agg(F.max_by(F.struct("weight", "sentiment_score"), "row_pos").alias("e")).select("src", "dst", "e.weight", "e.sentiment_score")


def with_implied(declared: DataFrame, edges: DataFrame) -> DataFrame:
    """Declared vertices and, without a type, the end points nobody declared."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return declared.unionByName(ends.join(declared, "id", "left_anti").withColumn("type", F.lit(None).cast("string")))


def _weight(score: Column, only_default: bool) -> Column:
    return labels.weight(score, only_default=only_default).alias("weight")


def comment_video(comments: DataFrame, feature: str = "sentiment", only_default: bool = True) -> tuple[DataFrame, DataFrame]:
    """Each comment points to its parent comment or, without one, to its video."""
    parent = F.col("is_reply") & F.col("reply_to_comment_id").isNotNull()
    score = labels.score(F.col(feature))
    edges = last_edges(comments.select(F.col("comment_id").alias("src"), F.when(parent, F.col("reply_to_comment_id")).otherwise(F.col("video_id")).alias("dst"), _weight(score, only_default), score.alias("sentiment_score"), "row_pos"))
    declared = comments.select(F.col("video_id").alias("id"), F.lit("video").alias("type")).distinct().unionByName(comments.select(F.col("comment_id").alias("id"), F.lit("comment").alias("type")).distinct())
    declared = declared.groupBy("id").agg(F.min("type").alias("type"))  # a comment is declared after the videos
    return with_implied(declared, edges), edges


def reply_pairs(comments: DataFrame, feature: str = "sentiment") -> DataFrame:
    """Replies to known comments: author, replied author, video, label; of a repeated comment id the last author counts."""
    authors = comments.groupBy(F.col("comment_id").alias("reply_to_comment_id")).agg(F.max_by("author_id", "row_pos").alias("replied_id"))
    return comments.where("is_reply and reply_to_comment_id is not null").join(authors, "reply_to_comment_id").select("author_id", "replied_id", "video_id", F.col(feature).alias("label"), "row_pos")


def user_video(comments: DataFrame, feature: str = "sentiment", only_default: bool = True) -> tuple[DataFrame, DataFrame]:
    """Authors point to authors they reply to and to videos they comment on, with their modal sentiment there."""
    pairs = reply_pairs(comments, feature)
    by_reply = modal(pairs, ["author_id", "replied_id", "video_id"], "label")
    by_video = modal(comments, ["author_id", "video_id"], feature)
    score = labels.score(F.coalesce("mode", F.lit("Neutral")))
    to_user = pairs.join(by_reply, ["author_id", "replied_id", "video_id"]).select(F.col("author_id").alias("src"), F.col("replied_id").alias("dst"), _weight(score, only_default), score.alias("sentiment_score"), "row_pos")
    direct = comments.where("not is_reply or reply_to_comment_id is not null")
    to_video = direct.join(by_video, ["author_id", "video_id"]).select(F.col("author_id").alias("src"), F.col("video_id").alias("dst"), _weight(score, only_default), score.alias("sentiment_score"), "row_pos")
    edges = last_edges(to_user.unionByName(to_video))
    declared = comments.select(F.col("author_id").alias("id"), F.lit("user").alias("type")).distinct().unionByName(comments.select(F.col("video_id").alias("id"), F.lit("video").alias("type")).distinct())
    return with_implied(declared, edges), edges
