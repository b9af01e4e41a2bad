"""The corpus pipeline stage by stage, and the registered queries of the subpackage."""

from helpers import ALNUM, SPACE, classes, documents, low
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from lectern.llm import jaccard, quality

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r["doc_id"] for r in docs.collect()}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        ids = {r["doc_id"] for r in after.collect()}
        assert ids <= kept, name
        if name == "quality":
            scored = quality.score(docs, quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet")))
            assert ids == {r["doc_id"] for r in scored.filter("score >= 0.3").collect()} and len(ids) > 100
        if name == "near_duplicates":
            joined = jaccard.similarity_join(docs, **pipeline.NEAR).collect()
            assert ids == {r["component_id"] for r in joined}
        if name == "pii":
            assert after.count() == docs.count() and after.filter("length(text) <> n_chars").count() == 0
            assert after.filter(F.col("text").contains("@example")).count() == 0
        if name == "mixing":
            assert after.filter("taken <= 0 or taken > 3 * size").count() == 0
        else:
            assert after.columns == list(pipeline.COLUMNS)
        docs, kept = after, ids
    assert {r["doc_id"] for r in pipeline.run(spark, DATA).collect()} == kept


def test_stages_survive_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "same words here again and again"), (3, "same words here again and again"), (4, "same words here again and again"), (3, "quite another text under an id that is there"), (None, "no id"), (None, "no id"), (None, None), (5, "mail a@b.co " * 3)]
    docs = documents(spark, rows, extra=False).withColumn("source", F.when(F.col("doc_id") != 2, F.col("source")))
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
        out = stage(spark, docs, DATA).select(*pipeline.COLUMNS).collect()
        if name == "quality":
            # labels are of other texts here: the stage must only stand the rows
            assert {r["doc_id"] for r in out} <= {1, 2, 3, 4, 5, None}
            continue
        docs = spark.createDataFrame(out, docs.schema)
        if name == "near_duplicates":
            assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "2", "3", "3", "5", "None", "None"]


def test_near_duplicates_at_five_words_and_four_fifths(spark):
    word = lambda i, j: f"w{i}x{j}"
    rows = [(i, " ".join(word(i, j) for j in range(52))) for i in range(4)]
    # one word of 52 changed in the middle: 43 of 53 shingles of five words are shared, 47 of 53 of three
    rows += [(10 + i, t.replace(word(i, 25), "other")) for i, t in rows[:2]] + [(20, rows[2][1].replace(word(2, 20), "x").replace(word(2, 40), "y")), (21, rows[3][1])]
    sets = {}
    for i, t in rows:
        w = SPACE.findall(low(t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = set(classes(list(sets), links).values())
    assert want == {0, 1, 2, 3, 20}
    assert {r["doc_id"] for r in pipeline.near_duplicate_stage(spark, documents(spark, rows, extra=False), DATA).collect()} == want


def test_decontamination_takes_near_matches(spark):
    item = next(r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").collect() if len(ALNUM.findall(low(r["text"]))) >= 15)
    words = ALNUM.findall(low(item))[:15]
    # every window of ten words holds the eighth
    near, far = [*words[:7], "qqq", *words[8:]], [w if j % 3 else "qqq" for j, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, "nothing of it")]
    assert {r["doc_id"] for r in pipeline.decontamination_stage(spark, documents(spark, rows, extra=False), DATA).collect()} == {3, 4}


def test_registered_queries():
    names = list(entry.queries())
    assert "pipeline" in names and [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert set(entry.oracle_sql()) <= set(names)
