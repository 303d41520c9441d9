"""Searches by time: no piece holds more than the endpoint gives, and nothing is lost or doubled."""

import pytest

from threadlens.plans import fixtures as fx
from threadlens.sources import api, paged

ASKED = api.Search("x", "2024-01-01T00:00:00Z", "2024-01-21T00:00:00Z")


def read(reader):
    return [row for piece in reader.partitions() for row in reader.read(piece)]


def test_pieces_are_halved_until_they_fit():
    reader = paged.Reader(fx.Timed(), ASKED, 300, 1)
    pieces = reader.partitions()
    assert len(pieces) > 5 and all(len(list(reader.read(p))) <= 300 for p in pieces)
    assert [a.before for a in pieces[:-1]] == [b.after for b in pieces[1:]]
    rows = read(reader)
    assert len(rows) == len(set(rows)) == 20 * 144
    # one piece alone loses what the endpoint does not give
    assert len(list(reader.read(paged.Piece(ASKED.published_after, ASKED.published_before)))) == 500


def test_filters_narrow_the_range_and_stay():
    reader = paged.Reader(fx.Timed(), ASKED, 300, 1)
    given = [paged.GreaterThanOrEqual(("published_at",), "2024-01-19T00:00:00Z"), paged.LessThan(("published_at",), "2024-01-20T00:00:00Z"), paged.EqualTo(("video_id",), "m1"), paged.GreaterThan(("published_at",), "soon")]
    assert list(reader.pushFilters(given)) == given
    assert len(read(reader)) == 145 and len(reader.partitions()) == 1  # the moment at the end is Spark's to leave out


def test_source(spark):
    found = paged.searched(spark, fx.Timed(), ASKED, 100)
    assert found.count() == 20 * 144 and found.where("published_at >= '2024-01-19T00:00:00Z' and published_at < '2024-01-20T00:00:00Z'").count() == 144
    assert paged.searched(spark, fx.Timed(), api.Search("x", "2024-01-01T00:00:01Z", "2024-01-01T00:00:02Z")).count() == 0
    with pytest.raises(ValueError):
        paged.search_source(fx.Timed(), api.Search("x"))


def test_a_burst_in_one_second_is_read_as_it_is():
    everything = lambda endpoint, asked: {"pageInfo": {"totalResults": 9}, "items": [{"id": {"videoId": "v"}, "snippet": {"publishedAt": asked["publishedAfter"]}}]}
    reader = paged.Reader(everything, api.Search("x", "2024-01-01T00:00:00Z", "2024-01-01T00:00:04Z"), 5, 1)
    assert len(reader.partitions()) == 4


def test_threads_leave_page_by_page(spark):
    said = lambda n: {"id": n, "snippet": {"textDisplay": n}}
    page = lambda e, p: {"items": [{"snippet": {"topLevelComment": said(f"{p['videoId']}-{k}")}} for k in range(250)]}
    ids = spark.createDataFrame([("a",), ("b",)], "video_id string")
    rows = api.comment_threads(ids, page).collect()
    assert sorted((r.video_id, r.page_pos) for r in rows) == [(v, k) for v in "ab" for k in range(250)]
