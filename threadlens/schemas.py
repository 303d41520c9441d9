"""Declared schemas; nothing is inferred."""

from pyspark.sql import types as T

_S, _L, _TS, _B = T.StringType(), T.LongType(), T.TimestampType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


VIDEO_ITEM = _struct(
    id=_S,
    snippet=_struct(title=_S, publishedAt=_S, channelId=_S, channelTitle=_S, description=_S, tags=T.ArrayType(_S)),
    statistics=_struct(viewCount=_S, likeCount=_S, commentCount=_S),
    contentDetails=_struct(duration=_S),
)
SEARCH_PAGE = _struct(items=T.ArrayType(_struct(id=_struct(videoId=_S))), nextPageToken=_S)
CHANNEL_ITEM = _struct(id=_S, statistics=_struct(subscriberCount=_S), snippet=_struct(country=_S))
_COMMENT = _struct(id=_S, snippet=_struct(textDisplay=_S, authorDisplayName=_S, publishedAt=_S, likeCount=_L, authorChannelId=_struct(value=_S)))
COMMENT_THREAD = _struct(snippet=_struct(topLevelComment=_COMMENT), replies=_struct(comments=T.ArrayType(_COMMENT)))
VIDEOS = _struct(video_id=_S, title=_S, publishedAt=_TS, channel_id=_S, channel_title=_S, views=_L, likes=_L, comments=_L, description=_S, video_tags=_S, duration_seconds=_L, video_url=_S)
COMMENTS = _struct(video_id=_S, comment_id=_S, text=_S, author_name=_S, author_id=_S, published_at=_TS, likes=_L, is_reply=_B, reply_to_comment_id=_S)
TRANSCRIPT = _struct(video_id=_S, snippets=T.ArrayType(_struct(text=_S)))
