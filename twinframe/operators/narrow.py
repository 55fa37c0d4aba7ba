"""Narrowing of large tables to a set of ids before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Graph, first_key

#: Bits that the hashes of ids fall on, in rows of 64: a million rows of two longs at most are sent to every task, however many ids there are.
BITS = 1 << 26


def within(df: DataFrame, c: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose c is one of ids (one column), and some others, which a join has to drop: their hash falls on the bit of an id.

    The bits go to every task, and the semi-join with them into every branch of a union, before anything of the other rows is made or shuffled.
    """
    at = lambda x: F.pmod(F.xxhash64(x), F.lit(BITS))
    bit = lambda x: F.pmod(at(x), F.lit(64)).cast("int")
    one = ids.columns[0]
    set_bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(one))
    words = ids.select(F.shiftright(at(one), 6).alias("_word"), set_bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    hit: Column = (F.shiftright(at(c), 6) == F.col("_word")) & (F.getbit("_bits", bit(c)) == 1)
    return df.join(F.broadcast(words), hit, "left_semi")


def shells_of(graph: Graph, ids: DataFrame) -> DataFrame:
    """(aas_id, asset, sm_id): what shells refer to, as far as it may be one of the submodels ids (one column), once for each shell; a join with ids has to follow."""
    named = F.array_distinct(F.transform("submodels", lambda r: first_key(r)))
    return within(graph.shells.select(F.col("id").alias("aas_id"), F.col("idShort").alias("asset"), F.explode(named).alias("sm_id")), "sm_id", ids)


def there(graph: Graph, of: DataFrame) -> DataFrame:
    """The rows of `of` (with sm_id) whose submodel is in the graph."""
    return of.join(graph.submodels.select(F.col("id").alias("sm_id")).distinct(), "sm_id")
