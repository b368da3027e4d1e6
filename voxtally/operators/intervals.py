"""Continuous periods and gaps of time intervals per entity.

No step gathers an entity in one task. Spans of one start are reduced to the longest, with partial sums before the
shuffle and the start in its key, so that no entity or hour is hot there. What is left is merged within blocks of the
start time by Spark's session_window, whose gap is each row's own duration; a block of one entity holds one row per
millisecond at most, whatever the number of rows. One row per block then says how far earlier blocks reach, and chains
across blocks are closed by windows over one row per block. session_window keeps spans apart that only touch; they are
joined in the second step.

Times are counted from the start of the block and durations cut at its length in the window (a longer one cannot merge
more of a block), so that no time is beyond the range of timestamps.

Defined results: rows with a null or unreadable bound, a null entity or an end not after the start are left out; a time
of more than 64 bits of milliseconds cannot be given and counts as unreadable; repeated rows change nothing; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

CLOCK = r"\A[0-9]+:[0-9]{1,2}:[0-9]{1,2}(?:\.[0-9]{1,3})?\z"
BLOCK_MS = 600_000


def clock_ms(text: Column) -> Column:
    """Milliseconds of h:m:s with up to three digits of a second; null if it cannot be read. The text is split once."""

    def value(p: Column) -> Column:
        part = lambda i: F.get(p, F.lit(i)).try_cast("long")
        rest = (part(1) * 60 + part(2)) * 1000 + F.rpad(F.coalesce(F.get(p, F.lit(3)), F.lit("")), 3, "0").try_cast("long")
        return F.try_add(F.try_multiply(part(0), F.lit(3_600_000)), rest)

    return F.when(text.rlike(CLOCK), F.get(F.transform(F.array(F.split(text, "[:.]")), value), F.lit(0)))


def _same(a: str, b: str, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


def periods_and_gaps(df: DataFrame, keys: list[str], start: str = "start_ms", end: str = "end_ms", block_ms: int = BLOCK_MS) -> DataFrame:
    """keys, kind (period, gap), start_ms, end_ms.

    block_ms bounds what one task sorts of one entity; it never changes the result.
    """
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    spans = df.select(*keys, s.alias("s"), e.alias("e")).where("e > s").groupBy(*keys, "s").agg(F.max("e").alias("e"))
    spans = spans.withColumn("block", F.expr(f"(s - pmod(s, {block_ms}L)) div {block_ms}L"))
    at = F.timestamp_millis(F.pmod("s", F.lit(block_ms).cast("long")))
    length = F.least(F.try_subtract("e", "s"), F.lit(block_ms + 1))
    gap = F.make_interval(secs=(F.coalesce(length, F.lit(block_ms + 1)) / 1000).cast("decimal(18,6)"))
    part = spans.withColumn("at", at).groupBy(*keys, "block", F.session_window("at", gap).alias("w")).agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("w")
    in_block = Window.partitionBy(*keys, "block").orderBy("s")
    part = part.withColumn("touches", F.coalesce(F.lag("e").over(in_block) >= F.col("s"), F.lit(False)))
    part = part.withColumn("n", F.sum(F.when(F.col("touches"), 0).otherwise(1)).over(in_block))
    # written once, as two steps read them
    part = cut(part.groupBy(*keys, "block", "n").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("n"))

    # how far the blocks before reach; one row per entity and block
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    reach = part.groupBy(*keys, "block").agg(F.max("e").alias("far")).withColumn("carry", F.max("far").over(before)).drop("far")
    part = part.alias("p").join(reach.alias("r"), _same("p", "r", [*keys, "block"])).select("p.*", "r.carry")
    # spans that begin within the reach of earlier blocks continue a period of theirs; of the others the last of a block is open
    new = F.coalesce(F.col("s") > F.col("carry"), F.lit(True))
    fresh = F.when(new, F.col("s"))
    later = Window.partitionBy(*keys, "block").orderBy(F.col("fresh").asc_nulls_first())
    part = cut(part.withColumn("fresh", fresh).withColumn("nxt", F.lead("fresh").over(later)))
    closed = part.where("fresh is not null and nxt is not null").select(*keys, "s", "e", "nxt")
    edge = part.groupBy(*keys, "block").agg(
        F.max(F.when(F.col("fresh").isNull(), F.col("e"))).alias("tail"), F.min("fresh").alias("first"),
        F.max(F.when(F.col("fresh").isNotNull() & F.col("nxt").isNull(), F.col("s"))).alias("s"), F.max(F.when(F.col("fresh").isNotNull() & F.col("nxt").isNull(), F.col("e"))).alias("e"),
    )
    # a chain is an open period with the tails behind it, up to the next block that begins a period of its own
    back = Window.partitionBy(*keys).orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("nxt", F.last("first", ignorenulls=True).over(back)).withColumn("chain", F.coalesce(F.count("s").over(before), F.lit(0)))
    ends = F.array(
        F.struct(F.col("chain").alias("chain"), F.lit(None).cast("long").alias("s"), F.col("tail").alias("e"), F.lit(None).cast("long").alias("nxt")),
        F.struct((F.col("chain") + 1).alias("chain"), F.col("s").alias("s"), F.col("e").alias("e"), F.col("nxt").alias("nxt")),
    )
    open_ = edge.select(*keys, F.explode(ends).alias("x")).select(*keys, "x.*").groupBy(*keys, "chain").agg(F.max("s").alias("s"), F.max("e").alias("e"), F.max(F.when(F.col("s").isNotNull(), F.col("nxt"))).alias("nxt"))
    both = closed.unionByName(open_.where("s is not null").select(*keys, "s", "e", "nxt"))
    rows = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("s").alias("start_ms"), F.col("e").alias("end_ms")),
        F.struct(F.lit("gap").alias("kind"), F.col("e").alias("start_ms"), F.col("nxt").alias("end_ms")),
    )
    return both.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*").where("end_ms is not null")


def speaking(utterances: DataFrame) -> DataFrame:
    """session_id, speaker, kind, start_ms, end_ms of every speaker's periods and silences."""
    rows = utterances.select(
        "session_id", F.upper(F.regexp_replace("speaker", r"\A[\s\p{Z}]+|[\s\p{Z}]+\z", "")).alias("speaker"),
        clock_ms(F.col("start_time")).alias("start_ms"), clock_ms(F.col("end_time")).alias("end_ms"),
    ).where("speaker is not null")
    return periods_and_gaps(rows, ["session_id", "speaker"])
