"""A content-addressed cache as two tables: objects (hash, bytes) and refs (url_hash, hash, touched)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def put(objects: DataFrame, refs: DataFrame, new: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(objects, refs) after storing rows (url, bytes); empty contents are refused, equal ones are stored once."""
    rows = new.filter(F.octet_length("bytes") > 0).select(F.sha2(F.encode("url", "UTF-8"), 256).alias("url_hash"), F.sha2("bytes", 256).alias("hash"), "bytes")
    one = rows.groupBy("url_hash").agg(F.max("hash").alias("hash"))
    fresh = rows.join(one.select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(F.first("bytes").alias("bytes")).join(objects.select("hash"), "hash", "left_anti")
    kept = refs.join(one.select("url_hash"), "url_hash", "left_anti")
    return objects.unionByName(fresh.select(*objects.columns)), kept.unionByName(one.withColumn("touched", F.lit(now).cast("long")).select(*refs.columns))


def get(objects: DataFrame, refs: DataFrame, urls: DataFrame) -> DataFrame:
    """(url, hash, bytes) of cached addresses whose content still matches its hash."""
    rows = urls.withColumn("url_hash", F.sha2(F.encode("url", "UTF-8"), 256)).join(refs, "url_hash").join(objects, "hash")
    return rows.filter(F.sha2("bytes", 256) == F.col("hash")).select("url", "hash", "bytes")


def heal(objects: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without objects that do not match their hash, and without refs that lead nowhere."""
    sound = objects.filter(F.sha2("bytes", 256) == F.col("hash"))
    return sound, refs.join(sound.select("hash"), "hash", "left_semi").select(*refs.columns)


def stats(objects: DataFrame, refs: DataFrame) -> DataFrame:
    """Objects, refs, bytes stored, and bytes that refs lead to (each object once)."""
    o = objects.agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0)).cast("long").alias("bytes"))
    used = objects.join(refs.select("hash").distinct(), "hash", "left_semi").agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0)).cast("long").alias("used_bytes"))
    return o.crossJoin(refs.agg(F.count(F.lit(1)).alias("refs"))).crossJoin(used)  # three single rows


def surviving_refs(refs: DataFrame, sizes: DataFrame, limit: int) -> DataFrame:
    """Refs that stay when the oldest go until the objects they lead to take at most `limit` bytes.

    refs: url_hash, hash, touched; sizes: hash, size. An object counts from the newest ref that leads to it. The running
    sum needs one order over all refs; it is taken over per-second totals, which are summed in parallel first.
    """
    newest = refs.groupBy("hash").agg(F.max("touched").alias("touched")).join(sizes, "hash")
    totals = newest.groupBy("touched").agg(F.sum("size").alias("size"))
    # all refs of one second stay or go together up to the second that crosses the limit; within it, by url_hash
    order = Window.orderBy(F.desc("touched"))
    totals = totals.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("upto") - F.col("size"))
    rows = refs.join(totals.select("touched", "before", "upto"), "touched", "left").join(sizes, "hash", "left")
    whole = rows.filter(F.col("upto") <= limit)
    # refs of seconds without a first object add nothing and stay while everything newer does
    cut = totals.filter(F.col("upto") > limit).agg(F.max("touched").alias("cut"))
    rest = rows.crossJoin(F.broadcast(cut))
    free = rest.filter(F.col("upto").isNull() & (F.col("cut").isNull() | (F.col("touched") > F.col("cut"))))
    edge = rest.filter(F.col("touched") == F.col("cut")).join(newest.select("hash", F.col("touched").alias("first")), "hash")
    adds = F.when(F.col("first") == F.col("touched"), F.col("size")).otherwise(0)
    one = Window.partitionBy("hash", "touched").orderBy(F.desc("url_hash"))
    edge = edge.withColumn("adds", F.when(F.row_number().over(one) == 1, adds).otherwise(0))
    line = Window.partitionBy("touched").orderBy(F.desc("url_hash")).rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("sum", F.col("before") + F.sum("adds").over(line)).filter(F.col("sum") <= limit)
    return whole.select(*refs.columns).unionByName(free.select(*refs.columns)).unionByName(edge.select(*refs.columns))


def sweep(objects: DataFrame, refs: DataFrame) -> DataFrame:
    """Objects that some ref leads to."""
    return objects.join(refs.select("hash").distinct(), "hash", "left_semi")


def prune(objects: DataFrame, refs: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(objects, refs) after dropping the least recently touched refs down to `limit` bytes, then unused objects."""
    left = surviving_refs(refs, objects.select("hash", F.octet_length("bytes").alias("size")), limit)
    return sweep(objects, left), left
