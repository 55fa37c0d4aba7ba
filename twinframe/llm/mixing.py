"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The targets level out the weights under each source's ceiling. Their sum is cut into blocks of equal token
counts, dealt to sources by highest quotients and then, in the same way, to the shards of each source. A
shard's documents form a ring in seeded order; its quota of blocks is laid on the ring from a seeded
start, so that whole rounds repeat every document and the last round takes a seeded stretch of blocks.

Everything is DataFrame work. Apart from one scan of the text, only (id, source, size) rows are shuffled, by
(source, one of BUCKETS hash buckets), which splits a source of any weight; windows run over those buckets or
over tables with a row for each source or shard.

Cases: a null or empty text has size 0 and takes nothing; a null source is a source of its own, ordered last;
repeated rows count as often as they occur; equal hashes fall back to the id and then the size; an empty table gives
an empty result; columns other than the three named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
#: Tokens for which a source gets one more shard, up to one for each bucket.
SHARD_TOKENS = 1 << 18
#: Blocks that the smallest positive target is cut into at least, and the most tokens of a block.
LEAST_BLOCKS, BLOCK_TOKENS = 512, 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, ceiling: float) -> DataFrame:
    """(source, source_size, weight, target) from one row (source, source_size) for each source."""
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    weighed = sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.row_number().over(by_code_point) - 1) % len(weights)).cast("double"))
    weighed = weighed.withColumn("cap", F.lit(float(ceiling)) * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("weight"))
    # Sources fill up in the order of cap / weight; the level is where the rest can take its share without reaching a cap.
    before = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    levels = weighed.withColumn(
        "level",
        (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(everything)["level"]
    return levels.withColumn("target", F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))).select("source", "source_size", "weight", "target")


def apportion(parties: DataFrame, of: list[str], key: list[str], seats: str, claim: str, cap: str) -> DataFrame:
    """Adds `quota`: Sainte-Laguë seats within each `of`, highest claim / (2k + 1) first, none above `cap`.

    With m parties and divisor d, the seats rounded from claim / d differ from the total claim / d by at most
    m / 2. So seats below the divisor total / (seats - m / 2) are certain, those above total / (seats + m / 2) are
    out of reach, and only the 2 m between them need be ranked.
    """
    group = Window.partitionBy(*of) if of else Window.partitionBy(F.lit(0))
    total, m = F.sum(claim).over(group), F.count(F.lit(1)).over(group)
    seat = lambda shift: F.when(F.col("_total") > 0, F.floor(F.col(claim) * F.greatest(F.col(seats) + shift * F.col("_m") / 2, F.lit(0)) / F.col("_total") + 0.5)).otherwise(0).cast("long")
    sure = parties.withColumn("_total", total.cast("double")).withColumn("_m", m).withColumn("_low", F.least(F.greatest(seat(-1) - 1, F.lit(0)), F.col(cap))).withColumn("_high", F.least(seat(1) + 1, F.col(cap)))
    sure = sure.withColumn("_left", F.col(seats) - F.sum("_low").over(group))
    open_seats = sure.filter("_high > _low").select(*of, *key, claim, "_left", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)).alias("_k"))
    order = (Window.partitionBy(*of) if of else Window.partitionBy(F.lit(0))).orderBy((F.col(claim) / (2 * F.col("_k") + 1)).desc(), *(F.col(k).asc_nulls_last() for k in key))
    won = open_seats.withColumn("_rank", F.row_number().over(order)).filter("_rank <= _left").groupBy(*of, *key).agg(F.count(F.lit(1)).alias("_won"))
    a, b = sure.alias("a"), won.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*of, *key]]
    return a.join(b, same, "left").select(*(F.col(f"a.{c}") for c in parties.columns), (F.col("a._low") + F.coalesce(F.col("b._won"), F.lit(0))).alias("quota"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, seed: int = 7) -> DataFrame:
    """Words that a mix takes from each row of df: (id, size, source_size, target, taken, block_tokens, shard, shard_quota)."""
    sized = df.select(F.col(id_col).alias(id_col), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = cut(sized.withColumn("mixed", F.xxhash64(F.lit(seed), F.col(id_col), F.col("size"))).withColumn("bucket", F.pmod(F.col("mixed"), F.lit(BUCKETS)).cast("int")))
    buckets = cut(sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, ceiling)
    everything = Window.partitionBy(F.lit(0))
    targets = (
        targets.withColumn("block", F.least(F.greatest(F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything) / LEAST_BLOCKS), F.lit(1)), F.lit(BLOCK_TOKENS)))
        .withColumn("block", F.coalesce("block", F.lit(1)).cast("long"))
        .withColumn("seats", F.round(F.sum("target").over(everything) / F.col("block")).cast("long"))
        .withColumn("cap", F.floor(F.lit(float(ceiling)) * F.col("source_size") / F.col("block")).cast("long"))
        # a power of two of shards, so that each one holds as many buckets as the next
        .withColumn("shards", F.least(F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("source_size") / SHARD_TOKENS, F.lit(1.0))))), F.lit(BUCKETS)).cast("int"))
    )
    quotas = apportion(targets, [], ["source"], "seats", "target", "cap").withColumnRenamed("quota", "source_quota")
    b, q = buckets.alias("b"), quotas.alias("q")
    cells = b.join(q, F.col("b.source").eqNullSafe(F.col("q.source"))).select("b.*", "q.source_size", "q.target", "q.block", "q.source_quota", F.pmod(F.col("b.bucket"), F.col("q.shards")).alias("shard"))
    shard = Window.partitionBy("source", "shard")
    cells = cells.withColumn("shard_size", F.sum("bucket_size").over(shard)).withColumn("offset", F.sum("bucket_size").over(shard.orderBy("bucket")) - F.col("bucket_size"))
    shards = cells.select("source", "shard", "shard_size", "source_quota", "block").distinct().withColumn("cap", F.floor(F.lit(float(ceiling)) * F.col("shard_size") / F.col("block")).cast("long"))
    dealt = apportion(shards, ["source"], ["shard"], "source_quota", "shard_size", "cap").select("source", "shard", "quota")
    c, d = cells.alias("c"), dealt.alias("d")
    cells = c.join(d, F.col("c.source").eqNullSafe(F.col("d.source")) & (F.col("c.shard") == F.col("d.shard"))).select("c.*", "d.quota")
    cells = cells.withColumn("need", F.col("quota") * F.col("block")).withColumn("rounds", F.when(F.col("shard_size") > 0, F.floor(F.col("need") / F.col("shard_size"))).otherwise(0)).withColumn("rest", F.col("need") - F.col("rounds") * F.col("shard_size"))
    cells = cells.withColumn("start", F.when(F.col("shard_size") > 0, F.pmod(F.xxhash64(F.lit(seed), F.col("source"), F.col("shard")), F.col("shard_size"))).otherwise(0))
    s, c = sized.alias("s"), cells.alias("c")
    rows = s.join(c, F.col("s.source").eqNullSafe(F.col("c.source")) & (F.col("s.bucket") == F.col("c.bucket"))).select(
        f"s.{id_col}", "s.size", "s.mixed", "s.source", "s.bucket", "c.source_size", "c.target", "c.block", "c.shard", "c.quota", "c.shard_size", "c.offset", "c.rounds", "c.rest", "c.start"
    )
    inside = Window.partitionBy("source", "bucket").orderBy("mixed", F.col(id_col).asc_nulls_last(), "size")
    rows = rows.withColumn("from", F.col("offset") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    overlap = lambda shift: F.greatest(F.least(F.col("from") + F.col("size"), F.col("start") + F.col("rest") - shift) - F.greatest(F.col("from"), F.col("start") - shift), F.lit(0))
    taken = F.col("rounds") * F.col("size") + overlap(F.lit(0)) + overlap(F.col("shard_size"))
    return rows.select(id_col, "size", "source_size", "target", taken.cast("long").alias("taken"), F.col("block").alias("block_tokens"), "shard", F.col("quota").alias("shard_quota"))
