"""Articles in hash buckets: a merge rewrites the buckets of its entries and leaves all others as they are.

A feed's articles are dealt to `slices` by their entry, so that a feed with a large part of all articles does not make one
bucket of that size; feed and slice together give the bucket. A published state names the folder of each bucket. A merge
reads the buckets that its batch touches, joins its keys to theirs, writes new versions of these buckets, and publishes a
state in which they replace the old ones. What the keys have in common is told to both sides as bits, one for each row of a
file, so that only stored rows that the batch changes, and the entries that change them, are shuffled with their texts; all
other rows go from where they were read into the new versions. Of two merges that began with the same state one fails and
changes nothing; a merge that runs again changes nothing either.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators import feeds as ops
from lectern.schema import TABLES, conform
from lectern.shared import materialize
from lectern.tables import Pointers

KEY = ["feed_id", "entry_id"]
#: Rows of a file that one bitmap of Spark's covers.
BLOCK = 32_768


def placed(rows: DataFrame, files: bool = True) -> DataFrame:
    """Rows of files with their places: file, block of rows in it, place in the block. Without files there are no rows."""
    row = F.col("_metadata.row_index") if files else F.lit(0).cast("long")
    return rows.withColumns({"_file": F.col("_metadata.file_path") if files else F.lit(""), "_block": F.floor(row / BLOCK), "_at": (row % BLOCK).cast("int")})


def marked(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Placed rows with _hit, whether hits (_file, _block, _at) have their place, and _n, numbering from 1 those they lack.

    Sent to all rows: a bit for each row up to a block's last hit, and a line for each block."""
    bits = hits.groupBy("_file", "_block").agg(F.bitmap_construct_agg("_at").alias("bits"), F.max("_at").alias("last"))
    bits = bits.select("_file", "_block", F.substring("bits", F.lit(1), F.floor(F.col("last") / 8).cast("int") + 1).alias("_bits"))
    blocks = rows.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("size")).join(bits, ["_file", "_block"], "left")
    lacked = F.col("size") - F.coalesce(F.bitmap_count("_bits"), F.lit(0))
    blocks = blocks.select("_file", "_block", "_bits", (F.sum(lacked).over(Window.orderBy("_file", "_block")) - lacked).alias("_before"))
    byte = F.floor(F.col("_at") / 8).cast("int")
    own = F.coalesce(F.conv(F.hex(F.substring("_bits", byte + 1, F.lit(1))), 16, 10).cast("int"), F.lit(0))
    earlier = F.coalesce(F.bitmap_count(F.substring("_bits", F.lit(1), byte)), F.lit(0)) + F.bit_count(own.bitwiseAND(F.expr("shiftleft(1, _at % 8) - 1")))
    out = rows.join(F.broadcast(blocks), ["_file", "_block"]).withColumns({"_hit": own.bitwiseAND(F.expr("shiftleft(1, _at % 8)")) != 0, "_n": F.col("_before") + F.col("_at") - earlier + 1})
    return out.drop("_file", "_block", "_at", "_bits", "_before")


class ArticleStore(Pointers):
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, slices: int = 8) -> None:
        super().__init__(spark, root)
        self.buckets, self.slices = buckets, slices

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("feed_id", F.pmod(F.xxhash64("entry_id"), F.lit(self.slices))), F.lit(self.buckets)).cast("int")

    def _read(self, state: dict, touched: list[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/{p}" for b, p in state.get("buckets", {}).items() if touched is None or int(b) in touched]
        if not paths:
            return self.spark.createDataFrame([], TABLES["articles"])
        return conform(self.spark.read.schema(TABLES["articles"]).parquet(*paths), "articles")

    def read(self) -> DataFrame:
        return self._read(self.state()[1])

    def _write(self, rows: DataFrame, files: int | None = None) -> dict[str, str]:
        """New versions of the buckets of rows: bucket -> folder."""
        path = f"v-{uuid.uuid4().hex}"
        rows = rows.withColumn("bucket", self.bucket())
        rows = rows.repartition(files, "bucket") if files else rows
        rows.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/{path}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{path}"))]
        return {n.split("=")[1]: f"{path}/{n}" for n in names if n.startswith("bucket=")}

    def _top(self, folders: dict[str, str]) -> int:
        return self._read({"buckets": folders}).agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]

    def load(self, articles: DataFrame) -> None:
        """These articles and no others."""
        number, state = self.state()
        folders = self._write(conform(articles, "articles"), self.buckets)
        self.publish(number, state | {"buckets": folders, "top": self._top(folders)})

    def touched(self, entries: DataFrame) -> list[int]:
        return sorted(r["b"] for r in entries.select(self.bucket().alias("b")).distinct().collect())

    def merge(self, entries: DataFrame, now: int) -> DataFrame:
        """Merges a batch as operators.feeds.ingest does; (feed_id, inserted) of the batch."""
        number, state = self.state()
        batch = materialize(ops.fold_batch(entries).withColumn("seq", F.lit(0)), "entry-batch")
        buckets = self.touched(batch)
        if not buckets:
            return self.spark.createDataFrame([], "feed_id long, inserted long")
        merged, top = self._merged(state, batch, buckets, now), state.get("top", 0)
        folders = self._write(merged)
        counts = materialize(self._read({"buckets": folders}).filter(F.col("id") > top).groupBy("feed_id").agg(F.count(F.lit(1)).alias("inserted")), "inserted")
        self.publish(number, state | {"buckets": state.get("buckets", {}) | folders, "top": max(top, self._top(folders))})
        return counts

    def _merged(self, state: dict, batch: DataFrame, buckets: list[int], now: int) -> DataFrame:
        files = any(int(b) in buckets for b in state.get("buckets", {}))
        stored, fetched = placed(self._read(state, buckets), files), placed(batch)
        place = lambda df, side: df.select(*KEY, F.struct("_file", "_block", "_at").alias(side))
        known = materialize(place(stored, "stored").join(place(fetched, "fetched"), KEY).select("stored", "fetched"), "known-entries")
        old, entries = marked(stored, known.select("stored.*")), marked(fetched, known.select("fetched.*"))
        changes = materialize(entries.filter("_hit").select(*batch.columns), "changes")
        same = old.filter(~F.col("_hit")).select(*TABLES["articles"].names)
        changed = ops.refreshed(old.filter("_hit").select(*TABLES["articles"].names), changes, "inner")
        new = entries.filter(~F.col("_hit")).withColumn("id", F.lit(state.get("top", 0)).cast("long") + F.col("_n"))
        return same.unionByName(changed).unionByName(ops.created(new, now))

    def compact(self) -> None:
        """Each bucket in one file; versions that no state names go."""
        old = self.folders(("v-",))
        self.load(self.read())
        kept = {p.split("/")[0] for s in self.states() for p in s.get("buckets", {}).values()}
        self.remove(old - kept)
