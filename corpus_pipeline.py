"""A corpus pipeline of five stages: quality, near duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents; the last adds what the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, jaccard, mixing, pii, quality
from lectern.llm.common import materialize, read_table, small

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates: words a shingle, and the least similarity num / den.
NEAR = {"k": 5, "num": 80, "den": 100}


def _without(docs: DataFrame, rows: DataFrame, on) -> DataFrame:
    """docs without those that match rows, which are broadcast only if they are few."""
    return docs.join(small(rows), on, "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored as empty texts; repeated rows share their verdict; columns beyond COLUMNS are dropped."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=COLUMNS[1:]).filter("predicted = 1").select(*COLUMNS)


def _nodes(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with `node`, which tells all different (id, text) apart: the id itself, or for rows of a repeated or null id a
    number beyond all ids, equal rows being one; and whether there are such rows."""
    ids = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select(F.col("doc_id").alias("odd_id"))
    ids = materialize(ids, "odd-ids")
    if ids.isEmpty():
        return docs.select(*COLUMNS, F.col("doc_id").alias("node")), False
    few, on = small(ids), F.col("doc_id").eqNullSafe(F.col("odd_id"))
    odd = docs.join(few, on, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    odd = materialize(odd.select("doc_id", "text", "rest.*", F.monotonically_increasing_id().alias("k")), "odd-rows")
    ends = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("top"), F.coalesce(F.min("doc_id"), F.lit(0)).alias("low")).first()
    node = F.col("k") + F.lit(ends["top"] + 1) if ends["top"] < 1 << 62 else F.lit(ends["low"] - 1) - F.col("k")
    single = docs.join(few, on, "left_anti").select(*COLUMNS, F.col("doc_id").alias("node"))
    return materialize(single.unionByName(odd.select(*COLUMNS, node.alias("node"))), "nodes"), True


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, that of the smallest id (null last).

    Documents link at NEAR: five words a shingle and a similarity of 0.8 (op10's contract is stricter). Rows of one id
    with different texts are different documents, equal rows are one."""
    rows, odd = _nodes(docs)
    classes = materialize(jaccard.similarity_join(rows.select(F.col("node").alias("doc_id"), "text"), **NEAR, counted=False).select("doc_id", "component_id"), "classes")
    gone = classes.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone"))
    if odd:
        # numbers beyond the ids say nothing of the ids' order
        named = classes.join(rows.select(F.col("node").alias("doc_id"), F.col("doc_id").alias("id")), "doc_id")
        first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "doc_id"))["doc_id"].alias("first"))
        gone = classes.join(first, "component_id").filter("doc_id <> first").select(F.col("doc_id").alias("gone"))
    return _without(rows, gone, F.col("node") == F.col("gone")).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window word for word go, and those that hold a window of ten words with at least
    eight in their places (shorter items match word for word only).

    Null and empty texts have no words and stay; rows go by id (null too) and text, so repeated rows go or stay together."""
    found = decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    hit = materialize(found.filter("n_hit > 0 or size(near_items) > 0").select(F.col("doc_id").alias("hit_id"), F.col("row_key").alias("hit_key")), "contaminated").distinct()
    return _without(docs, hit, (F.xxhash64("text") == F.col("hit_key")) & F.col("doc_id").eqNullSafe(F.col("hit_id"))).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kinds; n_chars follows a changed text.

    A null text stays null; all rows stay, repeated ones too."""
    found = pii.detect(docs, keep=("lang", "source", "n_chars"))
    spans = F.concat("base", "added")
    changed = F.size(spans) > 0
    text = pii.mask(F.col("text"), spans)
    return found.withColumn("changed", changed).withColumn("text", text).withColumn("n_chars", F.when(F.col("changed"), F.length("text").cast("long")).otherwise(F.col("n_chars").cast("long"))).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with how many it takes (repeats counted).

    Null and empty texts have no words and go; repeated rows are documents of their own; the null source comes last."""
    mixed = mixing.mix(docs, keep=("text", "lang", "n_chars"))
    return mixed.filter("taken > 0").select(*COLUMNS, "size", "source_size", "target", "taken")


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("pii", pii_stage), ("mixing", mixing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs


#: No SQL: the classifier and the tagger are learned. Tests hold near duplicates and decontamination against brute-force
#: versions, the other stages against their operators and the mix against its targets.
ORACLE_SQL = None
