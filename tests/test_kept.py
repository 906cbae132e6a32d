"""What is kept between calls: pulls, versions, stores, indexes, jobs, profiles, events, raw records."""

from __future__ import annotations

import datetime
import json
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.functions import aspect_table, aspects
from tidepool.operators import analytics, eda, profile, profile_states, resume, retrieval, text_index, vector_index
from tidepool.operators.enrich import enrich, enrich_by_key
from tidepool.operators.reviews import latest
from tidepool.schema import UNIFIED, align, struct
from tidepool.sources import paged, raw, readers, resolve, specs
from tidepool.sources.readers import listing
from tidepool.sources.store import Store
from tidepool.streaming import events, pull, versions


# --- pulls ----------------------------------------------------------------------------------------


def service(tmp_path, **sizes):
    for name, n in sizes.items():
        (tmp_path / name).write_text(str(n))
    return [str(tmp_path / name) for name in sizes]


def numbers(spark, target):
    return sorted((os.path.basename(r.query), r.number, json.loads(r.record)["value"]) for r in paged.batches(spark, target).collect())


def test_a_pull_goes_on_where_it_was_cut_short(spark, tmp_path):
    queries, target = service(tmp_path, a=47, b=12), str(tmp_path / "run")
    listener = events.Events(spark, str(tmp_path / "events"), ("a-run",))
    spark.streams.addListener(listener)
    try:
        (tmp_path / "a.down").write_text("")
        with pytest.raises(Exception, match="the service is down"):
            pull.pull(spark, "tests.producers:Counted", queries, target, "a-run", per_batch=10, per_task=4)
        said = pull.progress(spark, target)
        assert pull.manifest(spark, target) is None and not said["completed"] and said["last_successful_batch_index"] == 2 and said["cumulative_records"] == 42
        assert paged.committed(spark, f"{target}/_checkpoint") == {queries[0]: 30, queries[1]: 12}
        (tmp_path / "a.down").unlink()
        with pytest.raises(RuntimeError, match="producer"):
            pull.pull(spark, "tests.producers:Lossy", queries, target, "a-run", per_batch=10)
        before = sorted(os.listdir(target))
        done = pull.pull(spark, "tests.producers:Counted", queries, target, "a-run", per_batch=10, per_task=4)
        assert done == pull.manifest(spark, target) and done["completed"] and done["resumed"] and done["cumulative_records"] == 59 and done["total_batches"] == 5 and done["stream_state"] == {queries[0]: 47, queries[1]: 12}
        assert {x for x in before if x.startswith("batch")} < {x for x in os.listdir(target) if x.startswith("batch")}
        assert numbers(spark, target) == sorted([("a", i, i) for i in range(47)] + [("b", i, i) for i in range(12)])
        assert pull.pull(spark, "tests.producers:Counted", queries, target, "a-run") == done  # a run that is complete does nothing
        reads = [int(x) for x in (tmp_path / "a.reads").read_text().split()]
        assert set(reads) == set(range(47)) and reads.count(3) == 1 and reads.count(25) == 1  # batches that were done aren't read again
        deadline = time.time() + 20
        while time.time() < deadline and len(list((tmp_path / "events" / "a-run").glob("batch-*.json"))) < 5:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    found = events.events(spark, str(tmp_path / "events")).collect()
    batches = [e for e in found if e.event == "batch"]
    assert sum(e.counters["pulled.rows"] for e in batches) == sum(e.input_rows for e in batches) == 59 and sorted(e.batch for e in batches) == [0, 1, 2, 3, 4]
    assert {e.status for e in found if e.event == "ended"} <= {"failed", "completed"}


def test_a_pulled_run_is_a_source(spark, tmp_path):
    """Resolvers go on with it while it is open, and read it when it is complete."""
    base, target = str(tmp_path / "raw"), str(tmp_path / "raw" / "amazon" / "runs" / "r1")
    (query,) = service(tmp_path, reviews=35)
    (tmp_path / "reviews.down").write_text("")
    with pytest.raises(Exception, match="the service is down"):
        pull.pull(spark, "tests.producers:Reviews", [query], target, "r1", per_batch=20)
    assert resolve.latest_run(spark, base) is None and resolve.incomplete_run(spark, base) == "r1"
    (tmp_path / "reviews.down").unlink()
    assert pull.pull(spark, "tests.producers:Reviews", [query], target, "r1", per_batch=20)["total_batches"] == 2
    assert resolve.latest_run(spark, base) == target and resolve.incomplete_run(spark, base) is None
    rows = resolve.load(spark, base, "amazon").collect()
    assert len(rows) == 35 and {r.rating_normalized for r in rows} == {0.0, 0.25, 0.5, 0.75, 1.0} and len({r.review_id for r in rows}) == 35
    assert resolve.load(spark, base, "amazon", limit=3).count() == 3


def test_a_pull_takes_what_came_since(spark, tmp_path):
    """A stream that stays open sees records that appear later, once each."""
    spark.dataSource.register(paged.Pages)
    (query,) = service(tmp_path, a=5)
    seen: list[int] = []
    stream = spark.readStream.format("tidepool_pages").options(producer="tests.producers:Counted", queries=json.dumps([query]), per_batch=3).load()
    q = stream.writeStream.foreachBatch(lambda batch, n: seen.extend(r.number for r in batch.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert sorted(seen) == [0, 1, 2, 3, 4]
        (tmp_path / "a").write_text("8")
        q.processAllAvailable()
        assert sorted(seen) == list(range(8))
    finally:
        q.stop()


def test_producers(spark, tmp_path):
    spark.dataSource.register(paged.Pages)
    read = lambda producer, q, **o: spark.read.format("tidepool_pages").options(producer=f"tests.producers:{producer}", queries=json.dumps([q]), per_task=10, **o).load()
    assert [json.loads(r.record)["id"] for r in read("FromTheBeginning", "whole").orderBy("number").collect()] == list(range(25))
    assert read("FromTheBeginning", "whole", start='{"whole": 23}').count() == 2
    with pytest.raises(Exception, match="3 more were done|has records up to"):
        read("FromTheBeginning", "short", start='{"short": 23}').collect()
    (query,) = service(tmp_path, a=30)
    with pytest.raises(Exception, match="has records up to"):
        read("Lossy", query).collect()
    served = lambda name: json.dumps({"dataset": name, "config": "default", "split": "train"})
    whole = spark.read.format("tidepool_pages").options(producer="tests.producers:Served", queries=json.dumps([served("whole")]), per_task=130).load()
    assert whole.rdd.getNumPartitions() == 2 and sorted(json.loads(r.record)["value"] for r in whole.collect()) == list(range(250))
    with pytest.raises(Exception, match="has records up to"):
        read("Served", served("short")).collect()
    with pytest.raises(Exception, match="at least 1"):
        spark.read.format("tidepool_pages").options(producer="tests.producers:Counted", per_batch=0).load().collect()
    assert paged.committed(spark, str(tmp_path / "nothing")) == {}


# --- versions and stores --------------------------------------------------------------------------

VERSIONS = "review_id string, review_date timestamp, review_text string, source_url string, n int"


def some_versions(seed, n):
    rng = random.Random(seed)
    day = lambda d: d and datetime.datetime(2024, 1, d)
    return [(rng.choice(["a", "b", "c", "d", None]), day(rng.choice([None, 1, 2, 3, 4])), rng.choice([None, "x", "y"]), rng.choice([None, "u", "v"]), i) for i in range(n)]


def plain(df):
    return sorted((tuple(r) for r in df.select("review_id", "review_date", "review_text", "source_url").collect()), key=str)


def test_latest_versions_win_however_late_they_come(spark, tmp_path):
    rows, schema = some_versions(2, 60), spark.createDataFrame([], VERSIONS).schema
    store = Store.create(spark, str(tmp_path / "store"), schema, "review_id", 4)
    for i in range(3):
        spark.createDataFrame(rows[i * 20 : i * 20 + 20], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        versions.into_store(stream, store, str(tmp_path / "c")).awaitTermination()
        assert plain(store.read()) == plain(latest(spark.createDataFrame(rows[: i * 20 + 20], schema).where("review_id is not null")))
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


def test_versions_give_out_winners_only(spark, tmp_path):
    schema = spark.createDataFrame([], VERSIONS).schema
    day = lambda d: datetime.datetime(2024, 1, d)
    given = [[("a", day(2), "x", None, 1), ("a", day(3), "x", None, 2)], [("a", day(1), "x", None, 3), ("a", day(3), "x", None, 4)], [("a", day(3), "w", None, 5)], [("a", None, "a", None, 6), ("b", None, None, None, 7)]]
    got = []
    for i, rows in enumerate(given):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        changes = versions.latest_wins(spark.readStream.schema(schema).json(str(tmp_path / "in")), ttl=None if i < 0 else "1 day")
        with versions.settings(spark, versions.SETTINGS):
            q = changes.writeStream.outputMode("update").foreachBatch(lambda batch, n: got.append(sorted(r.n for r in batch.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert [x for x in got if x] == [[2], [5], [7]]


def test_state_expires(spark, tmp_path):
    """After its time to live a key is new again."""
    schema = spark.createDataFrame([], VERSIONS).schema
    got = []
    for n, d in ((1, 5), (2, 3)):
        spark.createDataFrame([("a", datetime.datetime(2024, 1, d), "x", None, n)], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        changes = versions.latest_wins(spark.readStream.schema(schema).json(str(tmp_path / "in")), ttl="1 second")
        with versions.settings(spark, versions.SETTINGS):
            q = changes.writeStream.outputMode("update").foreachBatch(lambda batch, _: got.extend(r.n for r in batch.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        time.sleep(2)
    assert got == [1, 2]


def files(spark, path):
    return {f[0] for f in listing(spark, path) if f[0].endswith(".parquet")}


def test_a_store_writes_the_buckets_of_changed_keys(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(200).select(F.col("id"), F.concat(F.lit("t"), "id").alias("document"), F.col("id").cast("int").alias("n"))
    store = Store.create(spark, path, rows.schema, "id", 16)
    assert store.read().count() == 0 and store.delete(rows) == [] and len(store.upsert(rows)) == 16
    before = files(spark, path)
    new = spark.createDataFrame([(7, "seven", None), (7, "later", 1), (500, "new", 5), (None, "none", 1)], "id long, document string, n int").withColumn("other", F.lit(1))
    touched = store.upsert(new)
    after = files(spark, path)
    same = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert len(touched) <= 2 and same == before & after and len(same) >= 14
    got = {r.id: (r.document, r.n) for r in Store(spark, path).read().collect()}
    assert len(got) == 201 and got[7] == ("seven", None) and got[500] == ("new", 5) and got[8] == ("t8", 8)
    assert [r.document for r in store.get(7).collect()] == ["seven"]
    assert store.upsert(new.where("id = 500")) and store.read().count() == 201  # again: the same
    store.delete(rows.select("id"))
    assert [r.id for r in store.read().collect()] == [500] and store.upsert(new.where("false")) == []
    with pytest.raises(ValueError):
        Store.create(spark, path, rows.schema, "id", 8)
    with pytest.raises(ValueError):
        Store.create(spark, str(tmp_path / "x"), rows.schema, "nokey")
    with pytest.raises(FileNotFoundError):
        Store(spark, str(tmp_path / "y"))


# --- indexes --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(4)
    words = ["battery", "life", "great", "don't", "bad", "Camera", "é", "x1", "screen", "the"]
    rows = [(f"d{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))), rng.choice(["A", "b ", None])) for i in range(300)]
    return spark.createDataFrame([*rows, ("none", None, "A"), ("empty", "", "A"), (None, "battery life", "A"), ("one", "battery-life!", "b")], "id string, document string, source string").cache()


@pytest.fixture(scope="module")
def text_at(spark, library, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    text_index.build(library, path, buckets=8, per_block=64)
    return text_index.TextIndex.open(spark, path)


@pytest.mark.parametrize("query", ["battery life", "great battery life", "nothing battery", "don't", "don't bad camera", "x1", "zebra", "the is", "", "screen bad great x1 life battery"])
def test_text_index_has_the_ladder(spark, library, text_at, query):
    for source in (None, " B"):
        got = text_index.search(spark, text_at, query, source)
        want = retrieval.lexical(library.where("id is not null"), query, source)
        assert sorted((r.id, r.source, r.level) for r in got.collect()) == sorted((r.id, r.source, r.level) for r in want.collect()) if source else {(r.id, r.level) for r in got.collect()} == {(r.id, r.level) for r in want.collect()}


def test_text_index_reads_the_terms_of_the_question(spark, text_at):
    rows = text_at.of_terms(spark, ["battery", "life"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "In(term, [battery,life])" in plan
    assert {r.term for r in rows.collect()} == {"battery", "life"} and len({f.split("bucket=")[1].split("/")[0] for f in rows.inputFiles()}) >= 1
    assert text_at.blocks == 5 and max(r.documents for r in rows.collect()) < 100


@pytest.mark.parametrize(("query", "n"), [("battery life", 5), ("camera", 1), ("zebra", 3), ("great bad", 1000)])
def test_best_documents(spark, library, text_at, query, n):
    terms = retrieval.query_terms(query)
    want = retrieval.postings(library.where("id is not null")).where(F.col("term").isin(terms)).groupBy("id").agg(F.sum("occurrences").alias("n")).orderBy(F.desc("n"), "id").limit(n)
    assert [tuple(r) for r in text_index.best(spark, text_at, query, n).collect()] == [tuple(r) for r in want.collect()]


def operators(plan):
    """Spark's operators of a plan that has run."""
    yield plan
    if plan.nodeName() == "AdaptiveSparkPlan":
        yield from operators(plan.executedPlan())
    elif plan.nodeName().endswith("QueryStage"):
        yield from operators(plan.plan())
    for i in range(plan.children().size()):
        yield from operators(plan.children().apply(i))


def stages_of(spark):
    """Spark's own figures of the stages that have run."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    jvm, gateway = context._jvm, context._gateway
    found = context._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return [found.apply(i) for i in range(found.size())]


def test_text_index_exchanges_texts_and_not_words(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i % 280, " ".join(rng.choices(words, k=400)), f"s{i % 3}" if i < 280 else None) for i in range(300)]  # twenty ids twice
    df = spark.createDataFrame(rows, "id long, document string, source string").repartition(4).cache()
    size = sum(len(r[1]) for r in rows)
    df.count()
    written = lambda: sum(s.shuffleWriteBytes() for s in stages_of(spark))
    before = written()
    text_index.build(df, str(tmp_path / "a"), buckets=4, per_block=100)
    assert 0 < written() - before < 1.5 * size
    monkeypatch.setattr(text_index, "WORDS", 1000)
    index = text_index.build(df, str(tmp_path / "b"), buckets=4, per_block=100)
    have = {(r.term, r.id, r.source, r.n): sorted(r.places) for r in text_index._matching(index, index.rows(spark), None).collect()}
    want = {}
    for i, text, source in rows:
        for place, term in enumerate(text.split()):
            want.setdefault((term, i, source), []).append(place)
    assert have == {(*k, len(v)): sorted(v) for k, v in want.items()}
    found = text_index.best(spark, index, "w1 w2 w3", 40).collect()
    counts = {}
    for (term, i, _), v in want.items():
        counts[i] = counts.get(i, 0) + len(v) * (term in ("w1", "w2", "w3"))
    assert [tuple(r) for r in found] == sorted(((i, c) for i, c in counts.items() if c), key=lambda x: (-x[1], x[0]))[:40]


def test_vector_index(spark, tmp_path):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(6, 8))
    v = middles[rng.integers(0, 6, 400)] + rng.normal(scale=0.4, size=(400, 8))
    rows = [(i, [float(x) for x in v[i]], "A" if i % 3 else "b") for i in range(400)] + [(900, None, "A"), (901, [0.0] * 8, "A"), (902, [float("nan")] * 8, "A"), (None, [1.0] * 8, "A"), (401, rows0 := [float(x) for x in v[5]], "b")]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, source string")
    vector_index.build(df, str(tmp_path), cells=12, n=5)
    index = vector_index.VectorIndex.open(spark, str(tmp_path))
    asked = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 400, 8)] + [(5, rows0), (999, None), (998, [0.0] * 8)], "query_id long, embedding array<double>")
    unit = np.array([r[1] for r in rows if r[0] is not None and r[0] <= 401 and r[1]], float)
    ids, source = np.array([r[0] for r in rows if r[0] is not None and r[0] <= 401]), np.array([r[2] for r in rows if r[0] is not None and r[0] <= 401])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for wanted in (None, "A ", "b"):
        near = {}
        for exact in (True, False):
            for r in vector_index.search(spark, index, asked, 5, wanted, exact=exact, others=True).collect():
                near.setdefault((exact, r.query_id), []).append((r.rank, r.id, r.distance))
        hits = total = 0
        for i in [*range(0, 400, 8), 5]:
            distance = np.round(1 - unit @ unit[list(ids).index(i)], 10)
            fit = (ids != i) & ((source == wanted.strip()) if wanted else True)
            true = sorted(zip(distance[fit], ids[fit]))[:5]
            assert [x[1] for x in sorted(near[True, i])] == [x[1] for x in true] and [x[0] for x in sorted(near[True, i])] == [1, 2, 3, 4, 5]
            hits += len({x[1] for x in near[False, i]} & {x[1] for x in true})
            total += 5
        assert hits >= 0.85 * total
        assert not any(q in (998, 999) for _, q in near)
    assert index.probes < index.cells and vector_index.search(spark, index, asked.where("query_id = 0"), 3, "no such source").count() == 0
    with pytest.raises(ValueError):
        vector_index.build(df.where("false"), str(tmp_path / "e"))


def test_vector_index_keeps_its_recall_for_few_questions(spark, tmp_path):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(500, 64))  # neighbours are in many cells, and some questions find far fewer than others
    df = spark.createDataFrame([(i, x.tolist(), "a" if i % 2 else "b") for i, x in enumerate(v)], "id long, embedding array<double>, source string").persist()
    vector_index.build(df, str(tmp_path), cells=16)
    index = vector_index.VectorIndex.open(spark, str(tmp_path))
    assert index.probes == index.by_set[-1] < index.by_set[2] and list(index.by_set) == sorted(index.by_set, reverse=True) and index.by_source.keys() == {"a", "b"}
    unit = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    near = unit @ unit.T
    np.fill_diagonal(near, -9)
    true = np.argsort(-near, axis=1)[:, :10]
    for r in range(8):
        asked = df.where(F.col("id") % 100 == r).select(F.col("id").alias("query_id"), "embedding")
        found = {(x.query_id, x.id) for x in vector_index.search(spark, index, asked, 10, others=True).collect()}
        assert sum((i, int(j)) in found for i in range(r, 500, 100) for j in true[i]) >= 0.9 * 50, r
    # copies of five questions are a set of five
    copies = df.where("id % 100 = 0").select(F.explode(F.sequence(F.lit(0), F.lit(99))).alias("copy"), "id", "embedding")
    copied = vector_index.search(spark, index, copies.select((F.col("id") * 1000 + F.col("copy") + 1000).alias("query_id"), "embedding"), 10)
    alone = vector_index.search(spark, index, df.where("id % 100 = 0").select((F.col("id") * 1000 + 1000).alias("query_id"), "embedding"), 10)
    assert sorted(map(tuple, copied.where("query_id % 1000 = 0").collect())) == sorted(map(tuple, alone.collect()))


def test_vector_index_compares_blocks_and_keeps_ties(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(3000, 16))
    v[rng.permutation(3000)[:400]] = v[7]  # more copies than a block's n nearest
    df = spark.createDataFrame([(i, x.tolist(), "s") for i, x in enumerate(v)], "id long, embedding array<double>, source string")
    index = vector_index.build(df, str(tmp_path), cells=6, n=5)
    asked = df.where("id % 10 = 0 or id = 7").select(F.col("id").alias("query_id"), "embedding")
    for name, value in (("BLOCK", 16 * 8 * 100), ("ASKED", 32), ("HELD", 1000)):
        monkeypatch.setattr(vector_index, name, value)
    unit = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    for exact in (True, False):
        found = vector_index.search(spark, index, asked, 5, exact=exact, probes=None if exact else 6, others=True)
        near = {}
        for r in found.collect():
            near.setdefault(r.query_id, []).append((r.rank, r.id))
        for i in [7, *range(0, 3000, 10)]:
            distance = np.round(1 - unit @ unit[i], 12)
            distance[i] = 9
            assert [x for _, x in sorted(near[i])] == np.lexsort((np.arange(3000), distance))[:5].tolist()
    found.collect()
    joined = [p.metrics().get("numOutputRows").get().value() for p in operators(found._jdf.queryExecution().executedPlan()) if "Join" in p.nodeName()]
    assert joined and max(joined) < 3000  # blocks meet; rows and questions would make 900,000 pairs


# --- jobs, profiles, events -----------------------------------------------------------------------


def test_a_job_reads_its_input_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "job")
    spark.range(500).select(F.when(F.col("id") % 4 > 0, F.col("id").cast("string")).alias("review_id"), F.col("id").alias("n")).write.parquet(source)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.read.parquet(source).mapInArrow(counted, "review_id string, n long")
    calls = []

    def make(part):
        calls.append(1)
        if len(calls) == 3:
            raise OSError("lost")
        return part.withColumn("twice", F.col("n") * 2)

    with pytest.raises(OSError):
        resume.run(df, make, target, 5, {"job": "x"})
    assert resume.progress(spark, target)["parts_done"] == 2
    assert resume.run(df, make, target, 5, {"job": "x"})["status"] == "completed" and read.value == 500
    assert sorted((r.n, r.twice) for r in resume.result(spark, target).collect()) == [(i, 2 * i) for i in range(500)]
    assert not os.path.exists(f"{target}/_staged") and resume.run(df, make, target, 5, {"job": "x"})["parts_done"] == 5 and len(calls) == 6
    spark.range(5).select(F.col("id").cast("string").alias("review_id"), F.col("id").alias("n")).write.mode("append").parquet(source)
    with pytest.raises(RuntimeError, match="input"):
        resume.run(spark.read.parquet(source), make, target, 5, {"job": "x"})


def test_profiles_add_up(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"r{i}", rng.choice(["A", "b", None]), rng.choice([None, " ", f"p{rng.randrange(40)}"]), f"u{rng.randrange(90)}", rng.choice([None, rng.random()]), rng.choice(["2024-01-01T00:00:00Z", "never", None]), rng.choice([None, "", "Same  text", f"text {i} of"])) for i in range(600)]
    df = spark.createDataFrame(rows, "review_id string, source string, product_name string, reviewer_id string, rating_normalized double, review_date string, review_text string")
    df = align(df, UNIFIED).withColumn("review_date", F.lit(None).cast("string")).drop("review_date").join(df.select("review_id", "review_date"), "review_id").cache()
    kept = profile_states.Profiles(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        kept.profile()
    part = F.pmod(F.xxhash64("review_id"), F.lit(4))
    for run in range(3):
        kept.add(f"run {run}", df.where(part == run))
    kept.add("run 0", df.where(part == 0))  # again: the same
    exact = [c for c in profile.dataset_profile(df).columns if not c.startswith("distinct")]

    def same(rows, got):
        want = {r.scope: r for r in profile.dataset_profile(rows).collect()}
        quality = {r.scope: r for r in profile.quality_metrics(rows).collect()}
        found = {r.scope: r for r in got.collect()}
        assert found.keys() == want.keys() and [r.scope for r in got.select("scope").collect()][0] == "overall"
        for scope, r in found.items():
            assert {c: r[c] for c in exact} == {c: want[scope][c] for c in exact} and r.invalid_date_count == quality[scope].invalid_date_count
            for c in ("distinct_products", "distinct_reviewers"):
                assert abs(r[c] - want[scope][c]) <= profile_states.DISTINCT_ERROR * want[scope][c] + 1
            assert abs(r.repeated_texts - quality[scope].duplicate_count) <= profile_states.DISTINCT_ERROR * r.distinct_texts + 1

    same(df.where(part < 3), kept.profile())
    kept.add("run 3", df.where(part == 3))
    same(df, kept.profile())
    same(df.where(part.isin(1, 2)), kept.profile(["run 1", "run 2"]))
    kept.drop("run 3")
    same(df.where(part < 3), kept.profile())
    ratings = sorted(r[4] for r in rows if r[4] is not None and spark)
    middle = kept.profile().where("scope = 'overall'").first().rating_quartiles[1]
    assert abs(sum(x <= middle for x in ratings) / len(ratings) - 0.5) < 0.1
    plan = kept.profile()._jdf.queryExecution().executedPlan().toString()
    assert "run=run-0" in plan and "review_text" not in plan.replace("null_review_text", "")


def test_events_of_jobs(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", 1)], "x string, y int")
    events.job_event(spark, str(tmp_path), "good run", df, lambda rows: rows.write.parquet(str(tmp_path / "out")), ("x", "y"))

    def fails(rows):
        raise OSError("no room")

    with pytest.raises(OSError):
        events.job_event(spark, str(tmp_path), "bad", df, fails)
    got = {r.run: r for r in events.events(spark, str(tmp_path)).where("event = 'job'").collect()}
    assert got["good-run"].counters == {"rows.rows": 2, "rows.null_x": 0, "rows.null_y": 1} and got["good-run"].status == "completed"
    assert got["bad"].status == "failed" and "no room" in got["bad"].reason


# --- aspects in SQL, raw records ------------------------------------------------------------------


def test_aspects_in_sql(spark):
    texts = ["The battery is GREAT. Bad\tcamera!  Battery lasts\n\nok", None, "", "  The   screen is fine. It broke. Éar ear?", "value! worth. " + "great price " * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, review_text string")
    aspect_table.register(spark, "mentions_of")
    df.createOrReplaceTempView("some_reviews")
    got = spark.sql("SELECT id, a.sentence, a.aspect, a.sentiment, a.quote FROM some_reviews, LATERAL mentions_of(review_text) a")
    want = aspects.mention_rows(df).select("id", "sentence", "aspect", "sentiment", "quote")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 5
    counted = spark.sql("SELECT a.aspect, count(*) AS n FROM some_reviews, LATERAL mentions_of(review_text) a GROUP BY 1")
    assert {r.aspect: r.n for r in counted.collect()} == {r.aspect: r["count"] for r in want.groupBy("aspect").count().collect()}


def test_raw_records(spark):
    lines = [
        '{"guideid": 12, "title": "T", "category": "Phone", "author": {"username": "me"}, "new.field": [1, 2], "introduction_raw": " ", "summary": "sum", "modified_date": 1704067200}',
        '{"guide_id": "g", "author": "plain", "difficulty_score": 7.5, "subject": null, "topic": "Pad"}', '{"id": null, "author": {"id": 1}}', "[1]", "nope", "7", None, "",
    ]
    parsed = raw.records(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = raw.ifixit_records(parsed).collect()
    assert got[0].asDict() == {**dict.fromkeys(specs.SPECS["ifixit"].schema.names), "guide_id": "12", "source_id": "12", "device_name": "Phone", "title": "T", "device_category": "Phone", "review_text": "sum", "published_date": "1704067200", "author": "me"}
    assert (got[1].guide_id, got[1].author, got[1].repairability_score, got[1].device_name) == ("g", "plain", "7.5", "Pad") and not any(got[2]) and len(got) == 3
    known = [k for keys in raw.IFIXIT_KEYS.values() for k in keys]
    assert [r.u for r in parsed.select(raw.unknown("record", known).alias("u")).collect()] == [{"new.field": "[1,2]"}, {}, {}]
    rows = specs.unify(raw.ifixit_records(parsed), specs.SPECS["ifixit"]).collect()
    assert (rows[0].review_id, rows[0].review_date, rows[1].rating_normalized) == ("ifixit_12", datetime.datetime(2024, 1, 1), 0.7222)
    videos = ['{"video_id": "v", "segments": [{"text": " a b ", "duration": 1.5}, {"text": "c"}, {"duration": 2}], "snippet": {"title": "TT"}}', '{"id": "w", "text": "own", "segments": "none"}']
    seen = raw.youtube_records(raw.records(spark.createDataFrame([(x,) for x in videos], "value string"))).collect()
    assert (seen[0].source_id, seen[0].title, seen[0].text, seen[0].duration_seconds, seen[0].segment_count) == ("v", "TT", "a b c", 3.5, 3) and (seen[1].text, seen[1].segment_count) == ("own", 0)


# --- aspects by rows, charts ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def many_texts(spark):
    rng = random.Random(8)
    words = "battery battery-life camera fast slow great bad worth value refund easy design durable ear the and fine broke phone".split()
    rows = [(f"r{i}", "".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", "! ", "\n", ".", "  "]) for _ in range(rng.randrange(0, 40)))) for i in range(200)]
    rows += [("none", None), ("empty", ""), ("blank", " \n"), ("long", "the battery is great " * 30 + ". " + "bad camera " * 40), ("short", "ear. fit.")]
    return spark.createDataFrame(rows, "review_id string, review_text string").repartition(3).cache()


@pytest.mark.parametrize("exact_first", [False, True])
def test_records_by_rows_equal_those_by_text(many_texts, exact_first):
    want = {r.review_id: r.a for r in many_texts.select("review_id", aspects.extract("review_text", exact_first=exact_first).alias("a")).collect() if r.a}
    got = {r.review_id: r.records for r in aspects.record_rows(many_texts, "review_id", exact_first=exact_first).collect()}
    assert got == want and len(got) > 100


def test_first_mentions_by_rows_equal_those_by_text(many_texts):
    want = many_texts.select("review_id", F.explode(aspects.first_mentions("review_text")).alias("a")).select("review_id", "a.*")
    got = aspects.first_mention_rows(many_texts, "review_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100


def test_enrichment_by_key(spark, many_texts):
    odd = many_texts.unionByName(spark.createDataFrame([(None, "great battery life")], many_texts.schema)).withColumn("n", F.lit(1))
    want = {r.review_id: r for r in enrich(many_texts.withColumn("n", F.lit(1))).collect()}
    got = enrich_by_key(odd)
    rows = {r.review_id: r for r in got.collect()}
    alone = rows.pop(None)
    assert (alone.sentiment_score, alone.aspect_count, alone.aspect_labels) == (1.0, 0, "") and got.count() == odd.count()
    assert {k: r.asDict() for k, r in rows.items()} == {k: r.asDict() for k, r in want.items()}


def test_charts(spark, many_texts, tmp_path):
    df = many_texts.withColumns({"rating": F.lit(4.0), "review_date": F.lit(datetime.datetime(2024, 2, 1)), "product_name": F.lit("p"), "verified": F.lit(True), "rating_normalized": F.lit(0.75)})
    names = eda.save_charts(df, str(tmp_path))
    assert names == ["missing_values", "ratings", "reviews_by_month", "text_lengths", "top_products", "verified_ratings"]
    read = lambda name: [tuple(r) for r in spark.read.parquet(str(tmp_path / name)).collect()]
    assert read("reviews_by_month") == [("2024-02", 205)] and read("ratings") == [(4.0, 205, 100.0)] and read("top_products") == [("p", 205)]
    assert sum(n for _, n in read("text_lengths")) == 205 and read("verified_ratings") == [(True, "0.6-0.8", 1.0)]
    assert list(eda.chart_data(many_texts)) == ["missing_values", "text_lengths"]


def test_options_from_one_scan(spark):
    rng = random.Random(2)
    rows = [(rng.choice([" a", "b", "", None, "c"]), rng.choice(["x", None]), rng.choice(["S", "t ", None]), rng.choice(["Positive", None]), rng.choice([None, datetime.datetime(2024, 1, rng.randrange(1, 9))])) for _ in range(80)]
    df = spark.createDataFrame(rows, "product_name string, product_category string, source string, sentiment_label string, review_date timestamp")
    for limit in (1, 200):
        want = {k: [r.asDict() for r in v.collect()] for k, v in analytics.filter_options(df, limit).items()}
        assert analytics.from_option_cube([r.asDict() for r in analytics.option_cube(df, limit).collect()]) == want
    assert analytics.from_option_cube([r.asDict() for r in analytics.option_cube(df.where("false")).collect()])["products"] == []


def test_tables_and_scans(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 2, None)], "id string, n int, extra double")
    df.write.parquet(str(tmp_path / "p"))
    read = readers.parquet(spark, str(tmp_path / "p"), ["n", "nothing", "id"], most=1)
    assert read.columns == ["n", "id"] and read.count() == 1 and "extra" not in readers.parquet(spark, str(tmp_path / "p"), ["n"])._jdf.queryExecution().executedPlan().toString()
    spark.sql(f"CREATE DATABASE IF NOT EXISTS kept LOCATION '{tmp_path / 'db'}'")
    schema = struct("n int, id string, other string")
    assert readers.load_table(df, "kept.loaded", schema) == 2 and readers.load_table(df.where("n = 1"), "kept.loaded", schema) == 1
    assert [tuple(r) for r in spark.table("kept.loaded").collect()] == [(1, "a", None)]
    spark.sql("DROP DATABASE kept CASCADE")
