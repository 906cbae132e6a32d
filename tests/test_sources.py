from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidepool.operators import reviews
from tidepool.schema import UNIFIED
from tidepool.sources import readers
from tidepool.sources.specs import SPECS, ebay_records, explain, unified, unify, with_businesses, youtube_records
from tidepool.streaming import ingest


def first(df):
    return df.first().asDict()


def test_amazon(spark):
    raw = spark.createDataFrame([(5.0, "A1", "P1", "u1", 1588687728923, 3, True, "Nice", None), (None, "A2", None, None, None, None, None, None, None)], "rating double, asin string, parent_asin string, user_id string, timestamp long, helpful_vote int, verified_purchase boolean, title string, text string")
    a, b = unify(raw, SPECS["amazon"]).orderBy("review_id").collect()
    assert (a.review_id, a.product_name, a.rating_normalized, a.review_text, a.helpful_votes, a.source_url) == ("amazon_A1_u1", "P1", 1.0, "Nice", 3, "https://amazon.com/dp/A1")
    assert a.review_date.strftime("%Y-%m-%d") == "2020-05-05"
    assert (b.review_id, b.product_name, b.rating_normalized, b.review_text, b.reviewer_id, b.display_name) == ("amazon_A2_unknown", "A2", None, "", "unknown", "Amazon Electronics Item A2")


def test_yelp_takes_one_business_per_id(spark):
    raw = spark.createDataFrame([("r1", "b1", 3, "ok", "2024-01-01"), ("r2", "b9", 5, "", "bad")], "review_id string, business_id string, stars int, text string, date string")
    shops = spark.createDataFrame([("b1", "Cafe", "Coffee & Tea, Cafes"), ("b1", "Cafe", "Coffee & Tea, Cafes")], "business_id string, name string, categories string")
    a, b = unify(with_businesses(raw, shops), SPECS["yelp"]).orderBy("review_id").collect()
    assert (a.product_name, a.product_category, a.display_category, a.rating_normalized) == ("Cafe", "Coffee & Tea, Cafes", "Coffee & Tea", 0.5)
    assert (b.product_name, b.product_category, b.review_date) == ("b9", "local_business", None)
    assert first(unify(with_businesses(raw, None), SPECS["yelp"]).where("review_id = 'yelp_r1'"))["product_name"] == "b1"


def test_other_sources(spark):
    ebay = spark.createDataFrame([("1", "Cam", "99.2", "2024-01-01T00:00:00Z")], "item_id string, title string, seller_rating string, listing_date string")
    assert first(unify(ebay, SPECS["ebay"]))["rating_normalized"] == 0.992
    fix = spark.createDataFrame([("7", "Fix", 8, "1704067200")], "guide_id string, title string, repairability_score int, published_date string")
    got = first(unify(fix, SPECS["ifixit"]))
    assert (got["rating_normalized"], got["review_date"].year) == (0.7778, 2024)
    video = spark.createDataFrame([("v", [("a ", 1.5), ("b", 2.0)], 1704067200)], "source_id string, segments array<struct<text:string,duration:double>>, created_utc long")
    raw = youtube_records(video)
    assert first(raw)["duration_seconds"] == 3.5
    assert first(unify(raw, SPECS["youtube"]))["review_text"] == "a b"
    post = spark.createDataFrame([("s", "T", "", 12)], "source_id string, title string, text string, score int")
    got = first(unify(post, SPECS["reddit"]))
    assert (got["review_text"], got["helpful_votes"], got["rating_normalized"]) == ("T", 12, None)
    items = spark.createDataFrame([("1", "t", [("Cameras",)], ("bob", 5, "99.8%"), "u", "2024-01-01")], "itemId string, title string, categories array<struct<categoryName:string>>, seller struct<username:string,feedbackScore:int,feedbackPercentage:string>, itemWebUrl string, itemCreationDate string")
    assert first(unify(ebay_records(items), SPECS["ebay"]))["rating_normalized"] == 0.998


def test_unified_and_latest(spark):
    a = spark.createDataFrame([("1", "old", "2024-01-01"), ("1", "new", "2024-02-01"), ("1", "none", None)], "item_id string, feedback_text string, listing_date string")
    every = unified({"ebay": a, "reddit": spark.createDataFrame([("x", "hi")], "source_id string, text string")})
    assert every.columns == UNIFIED.names
    assert {(r.review_id, r.review_text) for r in reviews.latest(every).collect()} == {("ebay_1", "new"), ("reddit_x", "hi")}


def test_explain(spark):
    rows = explain("ebay", spark.createDataFrame([("1", "Cam")], "item_id string, title string")).collect()
    assert {r.field: r.after for r in rows}["product_name"] == "Cam" and len(rows) == len(UNIFIED)


def test_json_lines_skip_what_isnt_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"item_id": "1"}\n\nnot json\n{"item_id": "2"}\n')
    (tmp_path / "b.txt").write_text('{"item_id": "3"}\n')
    got = readers.json_lines(spark, str(tmp_path), SPECS["ebay"].schema)
    assert sorted(r.item_id for r in got.collect()) == ["1", "2"]


def test_runs(spark, tmp_path):
    runs = readers.Runs(spark, str(tmp_path / "set"))
    with pytest.raises(FileNotFoundError):
        runs.read()
    runs.write(spark.range(3), "a b")
    runs.write(spark.range(5), "c", promote=False)
    assert runs.read().count() == 3 and runs.stale() == ["c"]
    runs.promote("c")
    assert runs.read().count() == 5 and readers.signature(spark, runs.current())[0] >= 1
    with pytest.raises(ValueError):
        runs.promote("none")


def test_upsert_and_queue(spark, tmp_path):
    have, new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(readers.merged(have, new).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    path = str(tmp_path / "queue")
    readers.append_queue(spark.createDataFrame([("1", "2024-01-01", "pending"), ("2", "2024-01-02", "done"), ("3", "2024-01-03", "pending")], "request_id string, created_at string, status string"), path)
    assert [r.request_id for r in readers.queue(spark, path).collect()] == ["3", "1"]


def test_streamed_files_equal_a_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [[{"item_id": "1", "feedback_text": "old", "listing_date": "2024-01-01"}], [{"item_id": "1", "feedback_text": "new", "listing_date": "2024-03-01"}, {"item_id": "2", "feedback_text": "x"}]]
    for i, rows in enumerate(lines):
        (folder / f"{i}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    run = lambda: ingest.ingest(spark, str(folder), "ebay", str(tmp_path / "out"), str(tmp_path / "state"), 1).awaitTermination()
    run()
    (folder / "9.jsonl").write_text('{"item_id": "3"}\n')
    run()
    got = ingest.ingested(spark, str(tmp_path / "out"))
    batch = reviews.latest(unify(readers.json_lines(spark, str(folder), SPECS["ebay"].schema), SPECS["ebay"]))
    assert sorted(got.select("review_id", "review_text").collect()) == sorted(batch.select("review_id", "review_text").collect())
    assert got.where(F.col("review_id") == "ebay_1").first().review_text == "new"
