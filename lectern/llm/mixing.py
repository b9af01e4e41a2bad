"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Words are handed out in blocks of equal size. Sources get the blocks of all targets together by the highest quotients
T / (2 k + 1) of their targets T, then each source's blocks go to its shards by the highest quotients of the shards' words:
an integer quota for every shard, which is what it gives. Documents stand in a seeded order in the shards of their source; a
shard gives its words in whole passes and then, from a seeded block on, block after block in the seeded order.

Blocks seldom add up to a target: what a source's quotas miss of it, or have too much, is settled in words by the first of
its shards that can (the largest first), so only those end inside a block, and a source's taken words are its target but
for half a word. No shard gives more than `most` times its words.

Scale: one scan writes (doc_id, source, size); a shard holds about `shard_rows` rows however large its source is. Sources,
shards and the plan are tables: sources are numbered by a range sort, targets come from a few aggregates, and the driver
gets single rows of totals. The plan is broadcast only if it is small.
Defined results: null texts have size 0 and give nothing; the null source comes last; sources without words have target
0; repeated rows are separate documents; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import materialize, small
from lectern.shared import numbered

WORD = r"[^\x20\x09-\x0D]+"


def seeded(*parts) -> Column:
    """60 bits of the MD5 digest of the parts, joined by colons."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, cycle: tuple[float, ...], share: float, most: int) -> DataFrame:
    """Adds n (place in code point order, null last) and target to rows of (key, source, source_size).

    Shares of all sizes by weight; none stops above `most` times its size, the excess goes to the others by weight.
    """
    rows = numbered(sources, [F.col("source").isNull(), F.col("source")])
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in cycle)), (F.col("n") % len(cycle) + 1).cast("int"))
    rows = materialize(rows.withColumn("weight", weight), "mix-sources")
    first = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    total, open_ = float(first["size"]) * share, float(first["weight"])
    left, closed = total, 0
    full = (F.col("source_size") * most).cast("double")
    share_of = lambda: F.lit(left) * F.col("weight") / F.lit(open_)
    while open_ > 0:
        # words for a unit of weight only grow, so that a source that stops once has stopped for good
        above = share_of() > full
        row = rows.agg(F.count_if(above).alias("n"), F.coalesce(F.sum(F.when(above, full)), F.lit(0.0)).alias("full"), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("weight")).first()
        if row["n"] <= closed:
            break
        left, open_, closed = total - row["full"], float(row["weight"]), row["n"]
    target = F.when(share_of() > full, full).otherwise(share_of()) if open_ > 0 else full
    return rows.withColumn("target", target)


def apportion(rows: DataFrame, group: list[str], name: list[str], votes: str, seats: str) -> DataFrame:
    """(group, name, quota): the seats of each group by the highest quotients votes / (2 k + 1); ties by name.

    votes and seats are whole numbers; a group's rows carry its seats. Only quotients near the last one that wins are ranked:
    no row's quota is further than the window below from its share, whatever the rounding of the others."""
    own = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    sums = rows.groupBy(*group).agg(F.sum(votes).alias("_all"), F.count(F.lit(1)).alias("_rows"))
    sized = rows.join(small(sums), group) if group else rows.crossJoin(F.broadcast(sums))
    sized = sized.filter((F.col(seats) > 0) & (F.col(votes) > 0))
    share = F.floor(F.col(votes).cast("double") * F.col(seats) / F.col("_all") + 0.5).cast("long")
    window = F.floor((share + 1) * (F.col("_rows") + 1) / F.col(seats)).cast("long") + 2
    low = F.greatest(F.lit(0).cast("long"), share - window)
    sized = materialize(sized.select(*group, *name, F.col(votes).alias("_v"), F.col(seats).alias("_s"), low.alias("_low"), (share + window).alias("_high")), "mix-votes")
    free = sized.groupBy(*group).agg((F.max("_s") - F.sum("_low")).alias("_free"))
    each = sized.select(*group, *name, F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_k"), "_v").withColumn("_q", F.col("_v").cast("double") / (2 * F.col("_k") + 1))
    order = [F.desc("_q"), *name, "_k"]
    if group:
        ranked = each.withColumn("n", F.row_number().over(own.orderBy(*order)) - 1).join(small(free), group)
    else:
        ranked = numbered(each, order).crossJoin(F.broadcast(free))
    won = ranked.filter(F.col("n") < F.col("_free")).groupBy(*group, *name).agg(F.count(F.lit(1)).alias("_won"))
    out = sized.join(won, group + name, "left")
    return out.select(*group, *name, (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("quota"))


def plan(shards: DataFrame, goals: DataFrame, most: int, block: int, seed: int) -> DataFrame:
    """Per shard of (key, shard, words): its quota of blocks, passes, and the words it gives beyond them and from where."""
    goals = goals.select("key", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("goal"))
    total = goals.agg(F.coalesce(F.sum("goal"), F.lit(0)).alias("n")).first()["n"]
    seats = apportion(goals.select("key", "goal", F.lit((total + block // 2) // block).cast("long").alias("seats")), [], ["key"], "goal", "seats")
    goals = materialize(goals.join(small(seats), "key", "left").withColumn("seats", F.coalesce("quota", F.lit(0).cast("long"))).drop("quota"), "mix-goals")
    own = shards.join(small(goals), "key")
    quotas = apportion(own.select("key", "shard", "words", "seats"), ["key"], ["shard"], "words", "seats")
    own = own.join(small(quotas), ["key", "shard"], "left").withColumn("quota", F.coalesce("quota", F.lit(0).cast("long")))
    own = own.withColumn("given", F.least(F.col("quota") * block, most * F.col("words")))
    # what is missing, or too much, is settled by the largest shards first, as far as each can
    whole, line = Window.partitionBy("key"), Window.partitionBy("key").orderBy(F.desc("words"), "shard").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("gap", F.col("goal") - F.sum("given").over(whole))
    room = F.when(F.col("gap") > 0, most * F.col("words") - F.col("given")).otherwise(F.col("given"))
    own = own.withColumn("room", room).withColumn("before", F.sum("room").over(line) - F.col("room"))
    settled = F.least(F.col("room"), F.greatest(F.lit(0).cast("long"), F.abs("gap") - F.col("before")))
    own = own.withColumn("given", F.when(F.col("gap") > 0, F.col("given") + settled).otherwise(F.col("given") - settled))
    blocks = F.ceil(F.col("words") / block).cast("long")
    own = own.withColumn("passes", F.when(F.col("words") > 0, F.floor(F.col("given") / F.col("words"))).otherwise(0).cast("long"))
    own = own.withColumn("rest", F.col("given") - F.col("passes") * F.col("words"))
    return own.withColumn("from", F.pmod(seeded(seed, F.col("shard"), F.col("key")), F.greatest(blocks, F.lit(1))) * block).select("key", "shard", "words", "source_size", "target", "quota", "given", "passes", "rest", "from")


def mix(docs: DataFrame, seed: int = 11, cycle: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: int = 3, max_block: int = 4096, blocks: int = 65536, shard_rows: int = 16_384, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of docs (and the columns named in keep)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("text_hash"), *(F.col(c).alias(f"kept_{c}") for c in keep))
    # a key that is never null keeps joins plain
    rows = rows.withColumn("key", F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")))
    # rows of one id and size are told apart by their texts, so that reruns agree
    rows = materialize(rows.withColumn("h", seeded(seed, F.col("doc_id"), F.col("size"))), "mix-sizes")
    wide = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("long").alias("shards")).filter("shards > 1")
    rows = rows.join(small(wide), "key", "left").withColumn("shard", F.pmod("h", F.coalesce("shards", F.lit(1)))).drop("shards")
    shards = materialize(rows.groupBy("key", "source", "shard").agg(F.sum("size").cast("long").alias("words")), "mix-shards")
    goals = targets(shards.groupBy("key", "source").agg(F.sum("words").cast("long").alias("source_size")), cycle, share, most)
    total = shards.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n")).first()["n"]
    block = max(1, min(max_block, total // blocks))
    table = materialize(plan(shards, goals, most, block, seed), "mix-plan")
    line = Window.partitionBy("key", "shard").orderBy("h", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum("size").over(line)).withColumn("start", F.col("end") - F.col("size"))
    rows = rows.join(small(table), ["key", "shard"])
    # the stretch of `rest` words that begins at `from` goes on at the shard's first word
    shared = lambda a, z: F.greatest(F.lit(0).cast("long"), F.least(F.col("end"), z) - F.greatest(F.col("start"), a))
    stop = F.col("from") + F.col("rest")
    part = shared(F.col("from"), F.least(stop, F.col("words"))) + shared(F.lit(0).cast("long"), stop - F.col("words"))
    taken = F.col("passes") * F.col("size") + part
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *(F.col(f"kept_{c}").alias(c) for c in keep))
