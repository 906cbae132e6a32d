from __future__ import annotations

import random
import zlib

import corpus_pipeline
import __spark_entry__
from tidepool.llm.sentencepiece import MODEL, load
from tidepool.llm.toxicity import fit_toxicity, score_toxicity

from test_dedup import bytes_removed, components_by_pairs
from test_rest import plain_viterbi


def tables(spark, path, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) as n_chars")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 400}" for j in range(80 + i % 5)), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s1") for i in range(10)]
    df = tables(spark, tmp_path, rows, [(i, 1, 0) for i in range(60)])
    kept = corpus_pipeline.jaccard_join(spark, df, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r.n_pieces == len(r.pieces) for r in out) and {r.doc_id for r in out} <= set(range(60))


def test_stages_equal_plain_ones(spark, tmp_path):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("some plain words of a text that is long enough to be cut".split()) + str(rng.randrange(60)) for _ in range(n))
    shared, rows = say(40), []
    for d in range(240):
        text = say(70) + (" blorgs you blorgish" * 2 if d % 4 == 1 else "")
        rows.append((d, f"{shared} � {text} é" if d % 5 == 0 else text, "en", f"s{d % 3}"))
    rows += [(500 + d, rows[d][1].upper() if d % 2 else rows[d][1] + " more", "en", "s0") for d in range(0, 40)]
    rows += [(600, None, "en", "s0"), (601, "", None, None), (602, "keep � mark", "fr", None), (603, say(9000), "en", "s1"), (603, "another text of that id", "en", "s1"), (None, "no id " + say(30), "en", "s2")]
    df = tables(spark, tmp_path, rows, [(d, 1, int(d % 4 == 1)) for d in range(240)])
    columns = lambda found: sorted((r.doc_id if r.doc_id is not None else -1, r.text or "", r.source or "") for r in found)
    # toxicity: what the classifier of the same labels calls toxic goes
    model = fit_toxicity(df, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    toxic = {(r.doc_id, r.text) for r in score_toxicity(df, model).where("predicted = 1").select("doc_id", "predicted").join(df, "doc_id").collect()}
    one = corpus_pipeline.toxicity(spark, df, str(tmp_path))
    assert columns(one.collect()) == columns([r for r in df.collect() if (r.doc_id, r.text) not in toxic])
    held = [r for r in df.collect() if r.doc_id is not None and r.doc_id < 240 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(((r.doc_id, r.text) in toxic) == (r.doc_id % 4 == 1) for r in held) / len(held) > 0.9
    # near copies: the least of each component stays, and rows without an id
    given = [r for r in one.collect() if r.doc_id is None or r.doc_id < 600]
    two = corpus_pipeline.jaccard_join(spark, spark.createDataFrame(given, df.schema), str(tmp_path))
    least = components_by_pairs([(r.doc_id, r.text) for r in given if r.doc_id is not None])
    assert columns(two.collect()) == columns([r for r in given if r.doc_id is None or least[r.doc_id][1] == r.doc_id])
    # repeated strings: whole characters of what brute force leaves
    given = [r for r in two.collect() if r.doc_id is not None] + [r for r in df.collect() if r.doc_id in (600, 601, 602)]
    three = corpus_pipeline.suffix_array(spark, spark.createDataFrame(given, df.schema), str(tmp_path)).collect()
    left = bytes_removed([(r.doc_id, r.text) for r in given], 100)
    texts = {r.doc_id: r.text for r in given}
    assert len(three) == len(given)
    for r in three:
        want = left[r.doc_id][3].decode(errors="ignore")
        assert r.text == (want if texts[r.doc_id] is not None else None) and r.n_chars == (None if r.text is None else len(r.text))
    assert {r.doc_id: r.text for r in three}[602] == "keep � mark"
    # the last stage: pieces of the texts that run() has mixed
    pieces = load(MODEL)
    out = corpus_pipeline.sentencepiece(spark, spark.createDataFrame(three, df.schema), str(tmp_path)).collect()
    for r, t in zip(sorted(out, key=lambda r: r.doc_id), sorted(three, key=lambda r: r.doc_id)):
        assert r.pieces is None if t.text is None else len(t.text) > 2000 or list(r.pieces) == plain_viterbi(pieces, t.text.encode())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_of_no_rows(spark, tmp_path):
    tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
