from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tidepool.functions import aspects, sentiment, text, values
from tidepool.operators import analytics, backends, eda, resume, retrieval, reviews, warehouse
from tidepool.operators.enrich import enrich, enrich_in_parts
from tidepool.operators.reviews import ReviewFilter
from tidepool.plans import params, status
from tidepool.sources import connectors, readers, resolve, staging


def put(path, text="x", age=0):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    then = time.time() - age
    os.utime(path, (then, then))


def test_latest_complete_run_and_the_one_to_go_on_with(spark, tmp_path):
    runs, base = tmp_path / "amazon" / "runs", str(tmp_path)
    assert resolve.latest_run(spark, base) is None and resolve.incomplete_run(spark, base) is None
    for run, files, age in (
        ("a", {"amazon_reviews_batch_000001_records_2.jsonl": "{}", "manifest.json": "{}"}, 300),
        ("b", {"amazon_reviews_batch_000001_records_2.jsonl": "{}", "_checkpoint.json": '{"completed": true}'}, 200),
        ("c", {"amazon_reviews_batch_000001_records_2.jsonl": "{}", "_checkpoint.json": '{"completed": false}'}, 100),
        ("d", {"_checkpoint.json": "not json"}, 50),
        ("e", {"manifest.json": "{}"}, 10),
    ):
        for name, text_ in files.items():
            put(runs / run / name, text_, age)
    assert resolve.latest_run(spark, base).endswith("/runs/b")
    assert resolve.incomplete_run(spark, base) == "d" and resolve.incomplete_run(spark, base, pinned="mine") == "mine"
    put(runs / "b" / "amazon_reviews_batch_000002_records_1.jsonl")
    assert [p.rsplit("/", 1)[-1] for p in resolve.batches(spark, str(runs / "b"), 2)] == ["amazon_reviews_batch_000001_records_2.jsonl", "amazon_reviews_batch_000002_records_1.jsonl"]
    put(runs / "b" / "amazon_reviews_batch_000002_records_9.jsonl")
    with pytest.raises(RuntimeError):
        resolve.batches(spark, str(runs / "b"), 2)


def test_reviews_and_businesses_come_in_pairs(spark, tmp_path):
    base = str(tmp_path)
    assert resolve.reviews_and_businesses(spark, base) == (None, None)
    put(tmp_path / "yelp_reviews.jsonl", '{"review_id": "r", "business_id": "b", "stars": 5, "text": "t"}\n')
    assert resolve.reviews_and_businesses(spark, base) == (f"{base}/yelp_reviews.jsonl", None)
    put(tmp_path / "yelp_business.jsonl", '{"business_id": "b", "name": "Cafe"}\n')
    assert [p.rsplit("/", 1)[-1] for p in resolve.reviews_and_businesses(spark, base)] == ["yelp_reviews.jsonl", "yelp_business.jsonl"]
    assert resolve.load(spark, base, "yelp").first().product_name == "Cafe"
    shop = tmp_path / "own"
    put(shop / resolve.REVIEWS, "{}")
    put(shop / resolve.BUSINESSES, "{}")
    run = tmp_path / "yelp" / "runs" / "r1"
    for name in (resolve.REVIEWS, resolve.BUSINESSES, "manifest.json"):
        put(run / name, "{}")
    assert resolve.reviews_and_businesses(spark, base)[0].startswith(str(run))
    assert resolve.reviews_and_businesses(spark, str(tmp_path / "none"), str(shop / resolve.REVIEWS))[1] == f"{shop}/{resolve.BUSINESSES}"
    put(tmp_path / "ebay" / "current" / "a.jsonl", '{"item_id": "1"}\n')
    assert resolve.load(spark, base, "ebay").first().review_id == "ebay_1" and resolve.load(spark, base, "reddit") is None


def test_staging(spark, tmp_path):
    run, current = tmp_path / "run", tmp_path / "current"
    put(run / "a.txt", "one\ntwo")
    put(run / "sub" / "b.txt", "three\n")
    put(current / "old.txt")
    said = []
    assert staging.promote(spark, str(run), str(current), "r7", {"rows": 3})["removed_count"] == 1
    assert sorted(p.name for p in current.rglob("*.txt")) == ["a.txt", "b.txt"] and staging.marker(spark, str(current))["run_id"] == "r7"
    assert staging.mirror(spark, str(run), str(current), on_progress=said.append)["removed_count"] == 0 and said[-1]["copied_count"] == 2
    assert staging.marker(spark, str(current))["rows"] == 3
    assert staging.count_lines(spark, str(run / "a.txt")) == 2
    assert staging.missing(spark, [str(run / "a.txt"), str(run / "z")]) == [str(run / "z")]
    with pytest.raises(ValueError):
        staging.relative("/x/../y", "/x")
    with pytest.raises(FileNotFoundError):
        staging.mirror(spark, str(tmp_path / "none"), str(current))
    spark.range(12).write.parquet(str(tmp_path / "p"))
    assert staging.footer_rows(spark, str(tmp_path / "p")) == 12
    assert staging.delete(spark, str(current)) and not staging.delete(spark, str(current))


def test_titles_are_remembered(spark, tmp_path):
    cache = readers.TitleCache(spark, str(tmp_path / "titles"))
    names = spark.createDataFrame([("A1",), ("A2",), (" ",)], "product_name string")
    assert cache.look_up(names).count() == 0
    metadata = spark.createDataFrame([("A1", "One"), ("A9", "Nine"), ("A2", " ")], "parent_asin string, title string")
    assert [tuple(r) for r in cache.look_up(names, metadata).collect()] == [("A1", "One")]
    assert [tuple(r) for r in cache.look_up(names).collect()] == [("A1", "One")]


def test_connectors():
    pages = {(q, o): {"itemSummaries": [{"itemId": i} for i in ids], "next": o == 0} for q, o, ids in (("cam", 0, ["1", "2", " "]), ("cam", 2, ["2", "3"]), ("tv", 0, ["3", "4"]), ("tv", 2, []))}
    ask = lambda url, p, h: pages[p["q"], p["offset"]]
    assert [i["itemId"] for i in connectors.ebay_items(ask, "t", ["cam", "tv"], page=2)] == ["1", "2", "3", "4"]
    assert [i["itemId"] for i in connectors.ebay_items(ask, "t", ["cam", "tv"], page=2, most=1)] == ["1", "3"]
    assert connectors.token(lambda url, form, h: {"access_token": h["Authorization"]}, "a", "b") == "Basic YTpi"
    with pytest.raises(RuntimeError):
        connectors.token(lambda *a: {}, "a", "b")
    assert [g["guide_id"] for g in connectors.ifixit_guides(lambda u, p, h: {"title": u}, ["7", "7", "8"])] == ["7", "8"]
    search = lambda u, p, h: {"items": [{"id": {"videoId": "v1"}}, {"id": {}}, {"id": {"videoId": "v0"}}]}
    assert connectors.video_ids(search, "k", ["q"], ["v0"]) == ["v0", "v1"]
    tube = lambda u, p, h: {"title": "page", "author_name": "chan"} if u == connectors.YOUTUBE_OEMBED else {"items": [{"snippet": {"title": "own"}, "statistics": {"likeCount": "5"}}]}
    v = next(connectors.videos(tube, lambda v: [{"text": "a", "duration": 1.0}], ["v1"], "key"))
    assert (v["title"], v["channel"], v["like_count"]) == ("own", "chan", "5")
    forum = {None: {"data": {"children": [{"data": {"id": "1", "selftext": "x" * 20}}, {"data": {"id": "2", "selftext": "short"}}], "after": "p2"}}, "p2": {"data": {"children": [{"data": {"id": "3", "selftext": "y" * 30}}]}}}
    assert [p["source_id"] for p in connectors.posts(lambda u, p, h: forum[p["after"]], "t", "tech", "q")] == ["1", "3"]
    calls, waits = [], []

    def busy(x):
        calls.append(x)
        if len(calls) < 3:
            raise connectors.TooMany
        return {"ok": x}

    assert connectors.patient(busy, sleep=waits.append)(1) == {"ok": 1} and waits == [1.0, 2.0, 4.0]
    with pytest.raises(connectors.TooMany):
        connectors.patient(lambda: (_ for _ in ()).throw(connectors.TooMany()), sleep=waits.append)()


def letters(query):
    yield from ({"name": f"{query}{i}"} for i in range(2))


def test_records_source(spark, tmp_path, monkeypatch):
    module = tmp_path / "made_records.py"
    module.write_text("def letters(q):\n    yield from ({'name': q + str(i)} for i in range(2))\n")
    spark.sparkContext.addPyFile(str(module))
    spark.dataSource.register(connectors.Records)
    df = spark.read.format("tidepool_records").option("producer", "made_records:letters").option("queries", '["a", "b"]').load()
    assert sorted(json.loads(r.record)["name"] for r in df.collect()) == ["a0", "a1", "b0", "b1"]


def test_model_scores(spark):
    score = backends.signed_score
    assert score({"label": "POSITIVE", "score": 0.9}) == 0.8 and score([{"label": "x", "score": 0.1}, {"label": "LABEL_0", "score": 0.8}]) == -0.6
    assert score({"label": "neutral", "score": 0.9}) == 0.0 and score(None) == score([]) == 0.0 and score({"label": "very positive", "score": "bad"}) == 0.0
    assert score({"label": "POSITIVE"}) == score({"label": "NEGATIVE", "score": None}) == 0.0 and score({"label": "positive", "score": 0}) == -1.0 and score({"label": "LABEL_0", "score": 0.2}) == 0.6
    cases = [("POSITIVE", "0.9"), ("a positive one", "0.2"), ("label_0", "0.3"), ("negative", None), ("5 stars", "7"), ("neutral", "0.9"), ("other", "1"), ("4 stars", "x"), (None, "1")]
    rows = spark.createDataFrame(cases, "label string, score string").select(sentiment.model_score("label", "score").alias("s"), "*").collect()
    assert [r.s + 0.0 for r in rows] == [score({"label": r.label, "score": r.score}) + 0.0 for r in rows] == [0.8, -0.6, 0.4, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    seen = []

    def load(name):
        if name == "broken":
            raise OSError("no such model")
        return lambda texts: [{"label": "negative" if "bad" in t else "positive", "score": 1.0} for t in texts]

    df = spark.createDataFrame([("good",), ("bad",), ("  ",), (None,)], "review_text string")
    chosen, column = backends.sentiment_backend("mine", load)
    assert chosen.name == "model" and [r.s for r in df.select(column("review_text").alias("s")).collect()] == [1.0, -1.0, 0.0, 0.0] and not seen
    for asked in ("broken", "lexicon", "other"):
        chosen, column = backends.sentiment_backend(asked, load if asked == "broken" else None)
        assert chosen.name == "lexicon" and bool(chosen.reason) == (asked != "lexicon")
        assert [r.s for r in df.select(column("review_text").alias("s")).collect()] == [1.0, -1.0, 0.0, 0.0]
    assert [r.sentiment_label for r in enrich(df, backends.sentiment_backend("mine", load)[1]).collect()] == ["positive", "negative", "neutral", "neutral"]


def test_embedding_backends(spark, tmp_path):
    folder = str(tmp_path)
    load = lambda name: lambda texts: [[1.0, 0.0] for _ in texts]
    assert backends.embedding_backend(spark, model="hashing-8")[0].dimensions == 16 and backends.hashing_dimensions("hash") == 384
    chosen, column = backends.embedding_backend(spark, folder, "mine", load)
    assert chosen.name == "model" and spark.createDataFrame([("a",)], "x string").select(column("x").alias("e")).first().e == [1.0, 0.0]
    fallen = backends.embedding_backend(spark, folder, "mine")[0]
    assert fallen.name == "hashing" and "LookupError" in fallen.reason
    with pytest.raises(LookupError):
        backends.embedding_backend(spark, folder, "mine", fall_back=False)
    backends.save_backend(spark, folder, chosen)
    with pytest.raises(RuntimeError):
        backends.embedding_backend(spark, folder)
    backends.save_backend(spark, folder, backends.Backend("hashing", "hashing-32", 32))
    assert backends.embedding_backend(spark, folder, "mine", load)[0].dimensions == 32


def test_asked_aspects_and_answers(spark):
    assert backends.parse_aspects('```json\n[{"aspect": "Battery life", "sentiment": "2", "quote": "q"}, {"sentiment": 1}]\n```') == [("Battery life", 1.0, "q")]
    assert backends.parse_aspects('{"aspects": [{"aspect": "camera"}]}') == [("camera", 0.0, "")] and backends.parse_aspects("sorry") == []

    def service():
        def ask(t):
            if "down" in t:
                raise OSError
            return '[{"aspect": "charging", "sentiment": 0.5, "quote": "it charges"}]'

        return ask

    df = spark.createDataFrame([("any",), ("down: great camera here",)], "x string")
    got = [[(a.aspect, a.sentiment) for a in r.a] for r in df.select(backends.asked_aspects(service)("x").alias("a")).collect()]
    assert got == [[("battery", 0.5)], [("camera", 1.0)]]
    plain = lambda q, found: "plain"
    assert backends.generated_answer(None, "q", [{}], plain) == backends.generated_answer(lambda q, f: " ", "q", [{}], plain) == backends.generated_answer(lambda q, f: 1 / 0, "q", [{}], plain) == "plain"
    assert backends.generated_answer(lambda q, f: "said", "q", [{}], plain) == "said" and backends.generated_answer(lambda q, f: "said", "q", [], plain) == "plain"


def test_first_mentions(spark):
    t = "The battery is great and great. Bad battery here! Short. The camera is bad and awful and slow"
    got = spark.createDataFrame([(t,)], "x string").select(aspects.first_mentions("x", {"battery": ("battery",), "camera": ("camera", "lens"), "price": ("price",)}, ("great",), ("bad", "awful", "slow")).alias("a")).first().a
    assert [(a.aspect, a.sentiment, a.quote) for a in got] == [("battery", 0.7, "The battery is great and great"), ("camera", -1.0, "The camera is bad and awful and slow")]


def test_resumable_jobs(spark, tmp_path):
    df = spark.range(40).select(F.col("id").cast("string").alias("review_id"), F.lit("a good phone with a fine battery").alias("review_text"))
    target, ran = str(tmp_path / "job"), []

    def make(part):
        if len(ran) == 2:
            raise OSError("lost")
        ran.append(1)
        return part.withColumn("made", F.lit(len(ran)))

    with pytest.raises(OSError):
        resume.run(df, make, target, 4, {"model": "m"})
    with pytest.raises(RuntimeError):
        resume.result(spark, target)
    with pytest.raises(RuntimeError, match="model"):
        resume.run(df, make, target, 4, {"model": "other"})
    assert resume.run(df, lambda p: p.withColumn("made", F.lit(9)), target, 4, {"model": "m"})["status"] == "completed"
    got = resume.result(spark, target).collect()
    assert sorted(int(r.review_id) for r in got) == list(range(40)) and {r.made for r in got} == {1, 2, 9}
    assert enrich_in_parts(df, str(tmp_path / "e"), 2)["parts_done"] == 2 and resume.result(spark, str(tmp_path / "e")).count() == 40
    assert retrieval.index_in_parts(df, str(tmp_path / "i"), 1, 32)["status"] == "completed"
    with pytest.raises(RuntimeError):
        retrieval.index_in_parts(df, str(tmp_path / "i"), 1, 64)


def test_parameters():
    assert params.compact({"a": "", "b": None, "c": "all", "d": [], "e": 0, "f": "x"}) == {"e": 0, "f": "x"}
    for bad in ({"limit": 0}, {"limit": 101}, {"min_rating": 1.5}, {"max_rows": 0}, {"n_results": 21}, {"offset": -1}):
        with pytest.raises(ValueError):
            params.checked(**bad)
    f = params.review_filter(query=" a ", source="", date_start="not a date", date_end="2024-01-02T03:04:05Z", min_rating=0.5)
    assert (f.query, f.source, f.date_start, f.date_end.hour, f.min_rating) == ("a", None, None, 3, 0.5)
    env = {"A": "yes", "B": "x", "C": " 7 ", "D": "a, b\n,c", "E": "0.5"}
    assert params.flag(env, "A", False) and not params.flag(env, "B", True) and params.flag(env, "Z", True)
    assert (params.whole(env, "C", 1), params.whole(env, "B", 1), params.decimal(env, "E", 0), params.items(env, "D")) == (7, 1, 0.5, ("a", "b", "c"))
    assert (params.escaped('<a "b">'), params.count_text("12345"), params.count_text("x"), params.percent_text(0.1234), params.percent_text(None)) == ("&lt;a &quot;b&quot;&gt;", "12,345", "0", "12.34%", "0.00%")


def test_choice_of_datasets_and_scans(spark, tmp_path):
    a, b = str(tmp_path / "enriched"), str(tmp_path / "normalized")
    assert warehouse.choose_dataset(spark, a, b, ["nowhere"]) is None
    spark.range(3).write.parquet(b)
    assert warehouse.choose_dataset(spark, a, b).count() == 3
    spark.range(5).write.parquet(a)
    assert warehouse.choose_dataset(spark, a, b).count() == 5 and warehouse.latest_change(spark, a) is not None
    spark.range(7).createOrReplaceTempView("some_reviews")
    assert warehouse.choose_dataset(spark, "none", "none", ["nowhere", "some_reviews"]).count() == 7
    assert warehouse.Scan.of(spark.range(9), 4).metadata() == {"rows_scanned": 4, "scan_limited": True, "max_rows": 4}
    assert warehouse.Scan.of(spark.range(9)).metadata()["scan_limited"] is False
    assert readers.first_existing(spark, [str(tmp_path / "x"), a]) == a


def test_labels_and_table(spark):
    rows = [("1", "amazon", "B0ABCDEFGHIJKLMNOP", None, None), ("2", "amazon", "B0KNOWN0000000000", "", None), ("3", "ebay", "", None, " Shop "), ("4", "yelp", "x", None, "A" * 20), ("5", "amazon", "unknown", None, "")]
    df = spark.createDataFrame(rows, "review_id string, source string, product_name string, product_title string, display_name string")
    titles = spark.createDataFrame([("B0KNOWN0000000000", "Known")], "product_name string, product_title string")
    got = {r.review_id: (r.product_title, r.product_label) for r in warehouse.attach_labels(df, titles).collect()}
    assert got == {"1": (None, "Amazon Product (ASIN B0ABCDEFGHIJKLMNOP)"), "2": ("Known", "Known"), "3": (None, "Unknown Product"), "4": (None, "x"), "5": (None, "unknown")}
    shown = {r.review_id: (r.display_name, r.display_category, r.entity_type) for r in warehouse.shown_names(df).collect()}
    assert shown["1"] == ("Amazon Electronics Item B0ABCDEFGHIJKLMNOP", "Electronics Product", "product_review") and shown["3"][0] == "Shop" and shown["4"][0] == "Yelp Business Review" and shown["5"][0] == "Amazon Product Review"
    table = warehouse.explorer_table(df)
    assert table.columns == list(warehouse.EXPLORED) and {r.review_id: r.product_label for r in table.collect()}["3"] == "Shop"


def test_status_and_counters(spark, tmp_path):
    put(tmp_path / "ebay" / "a.jsonl")
    for i in range(30):
        put(tmp_path / "logs" / f"{i:02d}.log")
    s = status.pipeline_status(spark, {"Normalized": str(tmp_path / "n")}, str(tmp_path), [str(tmp_path / "logs")])
    assert not s["artifacts"][0]["exists"] and [x["source"] for x in s["sources"] if x["available"]] == ["ebay"] and [f["name"] for f in s["log_files"]][:1] == ["05.log"]
    raw = spark.createDataFrame([("1", "old", "2024-01-01"), ("1", "new", "2024-02-01")], "item_id string, feedback_text string, listing_date string")
    said = status.normalize_all({"ebay": raw, "reddit": spark.createDataFrame([("x", "hi")], "source_id string, text string")}, str(tmp_path / "n"))
    assert said == {"source_counts": {"ebay": 2, "reddit": 1}, "rows_before": 3, "rows_after": 2, "removed_count": 1}
    d = status.dashboard_files(spark, str(tmp_path / "none"), str(tmp_path / "n"), str(tmp_path))
    assert (d["total_reviews"], d["sources_integrated"], d["hitl_queue_items"]) == (2, 1, 0)


def test_postings_follow_changes(spark):
    docs = lambda *rows: spark.createDataFrame(rows, "id string, document string")
    have = retrieval.postings(docs(("1", "a b a"), ("2", "b"), ("3", "c")))
    got = retrieval.updated_postings(have, docs(("2", "d d"), ("4", "a")), docs(("3", "")))
    want = retrieval.postings(docs(("1", "a b a"), ("2", "d d"), ("4", "a")))
    assert sorted(got.collect()) == sorted(want.collect())


def test_product_report(spark):
    rows = [("1", "Phone", "ebay", "positive", "battery, screen", "P"), ("2", "phone", "amazon", "positive", "battery", "P"), ("3", "Phone", "ebay", "negative", "price", "Q")]
    df = spark.createDataFrame(rows, "review_id string, product_name string, source string, sentiment_label string, aspect_labels string, display_name string").withColumns({"rating_normalized": F.lit(0.5), "sentiment_score": F.lit(0.1), "review_date": F.current_timestamp(), "review_text": F.lit("x")})
    got = {r.product_key: r for r in analytics.product_report(df, ["PHONE", "none"]).collect()}
    assert [(s.source, s.review_count) for s in got["phone"].sources] == [("amazon", 1), ("ebay", 2)] and [a.aspect for a in got["phone"].positive_aspects] == ["battery", "screen"] and got["phone"].display_name == "P"
    assert got["none"].review_count == 0 and [r.product_key for r in analytics.reviewed_only(analytics.compare_products(df, ["PHONE", "none"])).collect()] == ["phone"]


def test_small_text_functions(spark):
    one = lambda v, c: spark.createDataFrame([(v,)], "x string").select(c.alias("y")).first().y
    assert [one(v, text.video_id("x")) for v in ("https://www.youtube.com/watch?v=abcdefghijk&t=1", "https://youtu.be/abcdefghijk", "https://x.y/embed/abcdefghijk", "abcdefghijk", "short")] == ["abcdefghijk"] * 4 + [None]
    assert one('```json\n{"a": 1}\n```', text.unfenced("x")) == '{"a": 1}' and one("very_good_item", text.title_case("x")) == "Very Good Item" and one("b\x01 a", text.token_count("x")) == 2
    assert spark.createDataFrame([([3.0, 4.0],)], "x array<double>").select(values.norm("x"), values.unit("x")).first()[0:2] == (5.0, [0.6, 0.8])
    assert readers.run_id(" a/b:c ") == "a-b-c" and readers.run_id("///") == "run"


def test_filters_and_samples(spark, tmp_path):
    rows = [("1", "a fine 50% off", "Phone", "Home", "ebay", "positive", 0.9), ("2", "a_b", "phone", "Homes", "EBAY", "negative", 0.1)]
    df = spark.createDataFrame(rows, "review_id string, review_text string, product_name string, product_category string, source string, sentiment_label string, rating_normalized double").withColumns({"review_date": F.lit("2024-05-05").cast("timestamp"), "display_name": F.lit(None).cast("string"), "aspect_labels": F.lit("x")})
    ids = lambda **f: [r.review_id for r in df.where(warehouse.table_condition(ReviewFilter(**f), df.columns, True)).orderBy("review_id").collect()]
    assert ids() == ["1", "2"] and ids(product="Phone") == ["1"] and ids(source="ebay") == ["1", "2"] and ids(query="a%f") == ["1"] and ids(query="a_b") == ["2"] and ids(sentiment="NEGATIVE") == ["2"] and ids(category="home", date_end="2024-05-04") == []
    assert df.where(warehouse.table_condition(ReviewFilter(sentiment="x"), ["review_id"])).count() == 0
    assert [r.review_id for r in ReviewFilter(product=" PHONE", date_end="2024-05-05", min_rating=0.5).apply(df).collect()] == ["1"]
    assert eda.sample(df, 1).count() == 1 and {r.field: r.null_percent for r in eda.null_shares(df).collect()}["display_name"] == 100.0
    eda.save_sample(df, str(tmp_path / "s"), 1)
    assert readers.parquet(spark, str(tmp_path / "s"), ["review_id", "none"], 5).columns == ["review_id"]
    seen = spark.createDataFrame([("1", "so so so so promo code click here limited time buy now!!!")], "review_id string, review_text string")
    from pyspark.sql import Observation

    o = Observation("x")
    assert reviews.genuine(seen, threshold=0.4, observed=o).count() == 0 and o.get["removed_count"] == 1


def test_streams_see_each_review_once_and_count_windows(spark, tmp_path):
    from tidepool.streaming import ingest

    rows = [("1", "ebay", "2024-01-05"), ("1", "ebay", "2024-01-05"), ("2", "ebay", "2024-01-06"), ("3", "amazon", "2024-03-01")]
    spark.createDataFrame(rows, "review_id string, source string, day string").selectExpr("review_id", "source", "cast(day as timestamp) as review_date").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("review_id string, source string, review_date timestamp").parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert sorted(r.review_id for r in run(ingest.first_seen(stream()), "seen_once", "append")) == ["1", "2", "3"]
    trend = run(ingest.live_trend(stream(), "30 days"), "trend", "complete")
    assert sorted((r.source, r.review_count) for r in trend) == [("amazon", 1), ("ebay", 3)]
