"""Chat formatting of logged conversations, after cumulative snapshots are collapsed.

A log may hold a conversation many times, each time with a turn more. Every turn gets the hash of its conversation up
to it (a rolling xor of hashes of position, role and text, twice with different seeds); a conversation whose last hash
is a prefix hash inside a longer one is a snapshot of that one and goes. Of equal conversations the one with the
smallest conv_id stays. The turns of what is left are rendered.

Turns are ordered by turn, then role, then text (null turns first); turns that are equal in all of them count once. Null
roles and texts are empty strings. Rows without conv_id belong to no conversation and aren't rendered. The turns are
range-sorted once, and positions and hashes are summed within ranges and then over a conversation's ranges, so a
conversation with very many rows, whatever their turn numbers, isn't gathered in one task; for that reason the result
has a row per turn, whose segments, in order of position, make up the conversation. Marker strings in
a text are broken by a space, so a text can't open or close a turn. Columns of other names aren't read. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, folder_bytes, written

#: Bytes of a range of turns on average.
RANGE_BYTES = 32 << 20
OPENS, CLOSES = "<|im_start|>", "<|im_end|>"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, position (from 1) and the prefix hashes x and y of every distinct turn, as a written table."""
    spark = conversations.sparkSession
    given = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))).filter("conv_id is not null")
    single, folder = written(given.distinct(), "turns")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-folder_bytes(spark, folder) // RANGE_BYTES))
    # written with its range's number, which two plans of the same ranges needn't agree on
    given, dealt = written(single.repartitionByRange(ranges, "conv_id", "turn", "role", "text").withColumn("block", F.spark_partition_id()), "dealt")
    delete(spark, folder)
    inside = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = given.groupBy("conv_id", "block").agg(F.count("*").alias("n")).select("conv_id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = given.withColumn("at", F.row_number().over(inside)).join(counts, ["conv_id", "block"]).withColumn("position", F.col("at") + F.col("before")).drop("before")
    placed = placed.withColumn("hx", F.xxhash64("position", "role", "text")).withColumn("hy", F.xxhash64(F.lit("second"), "text", "position", "role"))
    sums = placed.groupBy("conv_id", "block").agg(F.bit_xor("hx").alias("x"), F.bit_xor("hy").alias("y"))
    sums = sums.select("conv_id", "block", *(F.coalesce(F.expr(f"bit_xor({c})").over(earlier), F.lit(0)).alias(f"{c}0") for c in "xy"))
    running = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    hashed = placed.withColumn("rx", F.bit_xor("hx").over(running)).withColumn("ry", F.bit_xor("hy").over(running)).join(sums, ["conv_id", "block"])
    out = hashed.select("conv_id", "turn", "role", "text", "position", F.col("rx").bitwiseXOR(F.col("x0")).alias("x"), F.col("ry").bitwiseXOR(F.col("y0")).alias("y"))
    out, _ = written(out, "hashed")
    delete(spark, dealt)
    return out


def maximal(hashed: DataFrame) -> DataFrame:
    """conv_id, n_turns and copies (equal conversations) of the conversations that are no prefix of a longer one."""
    whole = hashed.groupBy("conv_id").agg(F.max(F.struct("position", "x", "y")).alias("end")).select("conv_id", "end.*")
    single = whole.groupBy("position", "x", "y").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    sizes = whole.select("conv_id", F.col("position").alias("n_turns"))
    inner = hashed.select("conv_id", "position", "x", "y").join(sizes, "conv_id").filter("position < n_turns").groupBy("position", "x", "y").agg(F.lit(1).alias("inner"))
    return single.join(inner, ["position", "x", "y"], "left_anti").select("conv_id", F.col("position").alias("n_turns"), "copies")


def segment(role: Column, text: Column) -> Column:
    """One turn as the template has it."""
    for marker in (OPENS, CLOSES):
        role, text = (F.replace(c, F.lit(marker), F.lit(marker[0] + " " + marker[1:])) for c in (role, text))
    return F.concat(F.lit(OPENS), role, F.lit("\n"), text, F.lit(CLOSES + "\n"))


def formatted(conversations: DataFrame) -> DataFrame:
    """A row per turn of each maximal conversation: conv_id, position, turn, role, segment, n_turns, copies."""
    hashed = turns(conversations)
    return hashed.join(maximal(hashed), "conv_id").select("conv_id", "position", "turn", "role", segment(F.col("role"), F.col("text")).alias("segment"), "n_turns", "copies")


def conversations_of(rendered: DataFrame) -> DataFrame:
    """conv_id and the whole conversation as one string, for conversations that fit in a task."""
    parts = F.array_sort(F.collect_list(F.struct("position", "segment")))
    return rendered.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["segment"]), "").alias("rendered"))


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS position FROM t),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY position) AS turns, count(*) AS n_turns FROM r GROUP BY conv_id),
d AS (SELECT turns, n_turns, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY turns, n_turns),
p AS (SELECT DISTINCT list_slice(turns, 1, k) AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM d)),
m AS (SELECT conv_id, n_turns, copies FROM d ANTI JOIN p USING (turns))
SELECT r.conv_id, r.position, r.turn, r.role,
  '<|im_start|>' || replace(replace(r.role, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || chr(10)
    || replace(replace(r.text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10) AS segment,
  m.n_turns, m.copies
FROM r JOIN m USING (conv_id)
"""
