"""Matching integer sequences: candidate voting by shift, the longest agreeing part, the whole overlap, the decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators.graph import kept

#: Seconds of a value, smoothing width, agreement, votes, candidates, seconds of a part and of a whole.
STEP_MS = 1365 / 11025 * 1000
WIDTH, AGREE_BITS, LEAST_VOTES, MOST_OTHERS = 24, 538, 10, 40
PART_MS, WHOLE_MS, WHOLE_SHARE, BLOCK, BLOCK_AGREE = 30_000, 60_000, 0.8, 40, 0.62


def values(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """(name, v): the words of a text as an array of unsigned 32-bit values."""
    words = F.regexp_extract_all(text, F.lit(r"[^ \n\t\r]+"), F.lit(0))
    return df.select(F.col(key).cast("long").alias(name), F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long")).alias("v"))


def keys(df: DataFrame, name: str) -> DataFrame:
    """(name, pos, key): two keys for each value, its upper half, and its lower half above them."""
    each = df.select(name, F.posexplode("v").alias("pos", "value"))
    both = F.array(F.shiftright("value", 16), F.col("value").bitwiseAND(65535) + 65536)
    return each.select(name, F.col("pos").cast("long").alias("pos"), F.explode(both).alias("key"))


def candidates(q: DataFrame, o: DataFrame) -> DataFrame:
    """(q, o, shift, votes): for each query at most 40 others, with their best shift.

    Of the index only the queries' keys are kept (at most 131072, so they are broadcast), in one pass. Keys that occur too often
    in it are left out before the join: that bounds its skew. Both limits are part of the definition. o is read twice: give it as
    a written table.
    """
    asked = keys(q, "q").withColumnRenamed("pos", "at")
    index = kept(keys(o, "o").join(F.broadcast(asked.select("key").distinct()), "key", "left_semi"))
    counts = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = o.agg((F.lit(20.0) * F.greatest(2 * F.sum(F.size("v")) / 131072.0, F.lit(1.0))).alias("most"))  # one row
    rare = counts.join(F.broadcast(total), F.col("n") <= F.col("most")).select("key")
    votes = asked.join(rare, "key", "left_semi").join(index, "key").groupBy("q", "o", (F.col("pos") - F.col("at")).alias("shift")).agg(F.count(F.lit(1)).alias("n"))
    pair = Window.partitionBy("q", "o")
    near = votes.withColumn("votes", F.sum("n").over(pair.orderBy("shift").rangeBetween(-1, 1))).where(F.col("votes") >= LEAST_VOTES)
    first = near.groupBy("q", "o").agg(F.min(F.struct((-F.col("votes")).alias("v"), "shift")).alias("k")).select("q", "o", "k.shift", (-F.col("k.v")).alias("votes"))
    rank = Window.partitionBy("q").orderBy(F.desc("votes"), "o", "shift")
    return first.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= MOST_OTHERS).select("q", "o", "shift", "votes")


def overlap(pairs: DataFrame, q: DataFrame, o: DataFrame) -> DataFrame:
    """(q, o, shift, pos, bits): equal bits of the values that lie over each other.

    Whole sequences are joined to the pairs (q, o, shift), and their slices compared value by value; only pairs' sequences move.
    """
    some = pairs.select("q", "o", F.col("shift").cast("int").alias("shift"))
    met = some.join(q.withColumnRenamed("v", "a"), "q").join(o.withColumnRenamed("v", "b"), "o")
    met = met.withColumn("lo", F.greatest(F.lit(0), -F.col("shift")))
    n = F.greatest(F.least(F.size("a") - F.col("lo"), F.size("b") - F.col("lo") - F.col("shift")), F.lit(0))
    bits = F.zip_with(F.slice("a", F.col("lo") + 1, n), F.slice("b", F.col("lo") + F.col("shift") + 1, n), lambda x, y: 32 - F.bit_count(x.bitwiseXOR(y)))
    return met.select("q", "o", F.col("shift").cast("long").alias("shift"), "lo", F.posexplode(bits).alias("at", "bits")).select("q", "o", "shift", (F.col("lo") + F.col("at")).cast("long").alias("pos"), F.col("bits").cast("int").alias("bits"))


def longest_part(over: DataFrame) -> DataFrame:
    """(q, o, shift, start, length, bits) of overlaps: the longest run whose smoothed agreement holds, the first of equals."""
    at = Window.partitionBy("q", "o", "shift")
    smooth = over.withColumns({"s": F.sum("bits").over(at.orderBy("pos").rowsBetween(-12, 11)), "n": F.count(F.lit(1)).over(at)})
    good = smooth.where((F.col("n") >= WIDTH) & (F.col("s") >= AGREE_BITS))
    island = good.withColumn("g", F.col("pos") - F.row_number().over(at.orderBy("pos")))
    runs = island.groupBy("q", "o", "shift", "g").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("length"), F.sum("bits").alias("bits"))
    best = runs.groupBy("q", "o", "shift").agg(F.min(F.struct((-F.col("length")).alias("l"), "start", "bits")).alias("k"))
    return best.select("q", "o", "shift", "k.start", (-F.col("k.l")).alias("length"), "k.bits")


def whole(over: DataFrame, sizes: DataFrame) -> DataFrame:
    """(q, o, shift, length, bits): overlaps that agree over their whole length, block by block too."""
    first = Window.partitionBy("q", "o", "shift").orderBy("pos")
    blocks = over.withColumn("block", F.floor((F.row_number().over(first) - 1) / BLOCK)).groupBy("q", "o", "shift", "block").agg(F.sum("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    full = F.when(F.col("n") == BLOCK, F.col("bits") / (32.0 * BLOCK))
    total = blocks.groupBy("q", "o", "shift").agg(F.sum("bits").alias("bits"), F.sum("n").alias("length"), F.percentile(full, 0.1).alias("low"))
    sized = total.join(sizes, ["q", "o"])
    ok = (F.col("length") * STEP_MS >= WHOLE_MS) & (F.col("length") >= WHOLE_SHARE * F.least("q_size", "o_size")) & (F.col("bits") * 10 >= 7 * 32 * F.col("length")) & (F.coalesce("low", F.lit(1.0)) >= BLOCK_AGREE)
    return sized.where(ok).select("q", "o", "shift", "length", "bits")


def decided(found: DataFrame, q: DataFrame, o: DataFrame) -> DataFrame:
    """(q, o, kind, score, offset_ms, matched_ms) over shifts -1 to +1 of the candidates."""
    found = kept(found)
    over = kept(overlap(found.select("q", "o", F.explode(F.sequence(F.col("shift") - 1, F.col("shift") + 1)).alias("shift")), q, o))
    sizes = found.select("q", "o").join(q.select("q", F.size("v").alias("q_size")), "q").join(o.select("o", F.size("v").alias("o_size")), "o")
    part = longest_part(over).join(sizes, ["q", "o"])
    score = F.col("bits") / (32.0 * F.col("length"))
    shorter = F.least("q_size", "o_size")
    part = part.where((F.col("length") * STEP_MS >= PART_MS) | (2 * F.col("length") >= shorter) & (score >= 0.85)).withColumn("score", score)
    best = part.groupBy("q", "o").agg(F.max(F.struct("length", "score", (-F.col("shift")).alias("s"), F.least("q_size", "o_size").alias("shorter"))).alias("p"))
    all_ = whole(over, sizes).groupBy("q", "o").agg(F.max(F.struct((F.col("bits") / (32.0 * F.col("length"))).alias("score"), "length", (-F.col("shift")).alias("s"))).alias("w"))
    both = best.join(all_, ["q", "o"], "full")
    take_part = F.col("p").isNotNull() & (F.col("w").isNull() | (F.col("p.length") >= 0.9 * F.col("p.shorter")))
    pick = lambda f: F.when(take_part, F.col(f"p.{f}")).otherwise(F.col(f"w.{f}"))
    return both.select("q", "o", F.when(take_part, "part").otherwise("whole").alias("kind"), F.bround(pick("score"), 4).alias("score"), F.bround(-pick("s") * STEP_MS).cast("long").alias("offset_ms"), F.bround(pick("length") * STEP_MS).cast("long").alias("matched_ms"))
