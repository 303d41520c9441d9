"""Cleaning with its cascade, and what users do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..functions import text as X


def with_cleaned(comments: DataFrame) -> DataFrame:
    return comments.withColumn("cleaned_comment", X.cleaned(F.col("text")))


def lemmatised(comments: DataFrame, lexicon: DataFrame, key: str = "comment_id") -> DataFrame:
    """``cleaned_comment`` with words replaced by a lexicon's lemmas (form, lemma, pos, is_stop); stop words and function words go.

    Words the lexicon lacks stay. Forms must be unique in the lexicon.
    """
    tokens = comments.select(key, F.posexplode(F.split("cleaned_comment", " ")).alias("at", "form"))
    known = tokens.join(lexicon, "form", "left").withColumn("word", F.lower(F.coalesce("lemma", "form")))
    keep = ~F.coalesce("is_stop", F.lit(False)) & ~F.coalesce(F.col("pos").isin(*X.DROPPED_POS), F.lit(False)) & ~F.col("word").isin(*X.EXTRA_STOP_LEMMAS) & (F.col("word") != "")
    joined = known.where(keep).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("_lemmas"))
    return comments.join(joined, key, "left").withColumn("cleaned_comment", F.coalesce("_lemmas", F.lit(""))).drop("_lemmas")


def _answers() -> Column:
    """Whether a row names a parent; only such rows are joined, so null keys never meet in one task."""
    return F.coalesce(F.col("is_reply"), F.lit(False)) & F.col("reply_to_comment_id").isNotNull()


def _blank(cleaned: DataFrame) -> Column:
    return F.col("blank") if "blank" in cleaned.columns else X.is_blank(F.col("cleaned_comment"))


def without_blank(cleaned: DataFrame) -> DataFrame:
    """Without blank comments and without replies to them; other replies stay, also those to unknown comments.

    ``cleaned`` is read twice; its ``blank``, where it has one, saves looking at the text.
    """
    # written, so that its size is known: a small one is broadcast and no text moves
    gone = shared.durable(cleaned.where(_blank(cleaned)).select(F.col("comment_id").alias("_gone")).distinct(), "blank-ids")
    # what answers nothing gets a key of its own, which no comment has: keys without a partner are dealt evenly
    key = F.when(_answers(), F.col("reply_to_comment_id")).otherwise(F.concat(F.lit("\x00"), F.xxhash64("comment_id").cast("string")))
    return cleaned.where(~_blank(cleaned)).join(gone, key == F.col("_gone"), "left_anti")


def clean_comments(comments: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cleaned comments without blank ones and replies to those; all columns and ``cleaned_comment``, or only ``columns``.

    Every text is cleaned once, into a written table with what the cascade and ``columns`` need.
    """
    columns = [*comments.columns, "cleaned_comment"] if columns is None else columns
    keys = ["comment_id", "is_reply", "reply_to_comment_id"]
    once = with_cleaned(comments).select(*dict.fromkeys([*columns, *keys]), X.is_blank(F.col("cleaned_comment")).alias("blank"))
    return without_blank(shared.durable(once, "cleaned-comments")).select(*columns)


def clean_by_text(comments: DataFrame, texts: DataFrame, columns: list[str]) -> DataFrame:
    """``clean_comments`` for comments that name their text by ``text_id``; ``texts`` has (text_id, cleaned_comment), each text once.

    So a text is cleaned once however many comments repeat it, and the cascade moves keys only.  The result has
    ``columns`` of the comments; a ``cleaned_comment`` among them is joined to what is left.
    """
    narrow = [c for c in columns if c != "cleaned_comment"]
    keys = ["comment_id", "is_reply", "reply_to_comment_id", "text_id"]
    blank = texts.where(_blank(texts)).select("text_id", F.lit(True).alias("blank"))
    once = comments.select(*dict.fromkeys([*narrow, *keys])).join(blank, "text_id", "left").withColumn("blank", F.coalesce("blank", F.lit(False)))
    kept = without_blank(shared.durable(once, "comment-keys"))
    if "cleaned_comment" in columns:
        kept = kept.join(texts.select("text_id", "cleaned_comment"), "text_id")
    return kept.select(*columns)


def removed_counters(comments: DataFrame) -> DataFrame:
    """One row: comments, blank ones, replies to blank ones that are not blank themselves, and what is kept."""
    rows = shared.durable(with_cleaned(comments).select("comment_id", F.when(_answers(), F.col("reply_to_comment_id")).alias("parent"), X.is_blank(F.col("cleaned_comment")).alias("blank")), "blank-comments")
    gone = rows.where("blank").select(F.col("comment_id").alias("_gone")).distinct()
    key = F.coalesce("parent", F.concat(F.lit("\x00"), F.xxhash64("comment_id").cast("string")))
    orphan = F.col("_gone").isNotNull() & ~F.col("blank")
    return rows.join(gone, key == F.col("_gone"), "left").agg(F.count("*").alias("n_comments"), F.count_if("blank").alias("n_blank"), F.count_if(orphan).alias("n_orphaned"), F.count_if(~F.col("blank") & ~orphan).alias("n_kept"))


def user_activity(comments: DataFrame) -> DataFrame:
    """Comments and different videos of each author, most active first; one shuffle for both counts."""
    counts = comments.where("author_name is not null").groupBy("author_name").agg(F.count("*").alias("comment_count"), F.countDistinct("video_id").alias("video_count"))
    return counts.orderBy(F.desc("comment_count"), "author_name")


def user_activity_joined(comments: DataFrame) -> DataFrame:
    """The same by two aggregations and an inner join."""
    known = comments.where("author_name is not null")
    return known.groupBy("author_name").agg(F.count("*").alias("comment_count")).join(known.groupBy("author_name").agg(F.countDistinct("video_id").alias("video_count")), "author_name")
