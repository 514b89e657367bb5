"""The chunk table: rows of text that keep their place in a document's tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from treegrain.functions.text import parent_path, path_name
from treegrain.session import fresh_names, spill_table

CHUNK = StructType(
    [
        StructField("id", LongType()),
        StructField("pos", LongType()),
        StructField("text", StringType()),
        StructField("depth", IntegerType()),
        StructField("node_path", StringType()),
        StructField("parent_path", StringType()),
        StructField("name", StringType()),
        StructField("source_file", StringType()),
        StructField("start_line", IntegerType()),
        StructField("end_line", IntegerType()),
    ]
)


def with_paths(df: DataFrame) -> DataFrame:
    """Add parent_path and name to rows with a node_path."""
    return df.withColumn("parent_path", parent_path(F.col("node_path"))).withColumn("name", path_name(F.col("node_path")))


def number(df: DataFrame, order: list[str], *, start: int = 0, column: str = "pos") -> DataFrame:
    """Number rows from `start` in the given order, without a gap and without sorting everything in one task.

    Rows are sorted into ranges of that order and written out once with their place in their range, so that the ranges' sizes (one small row each) and
    the rows they are added to come from the same ranges: a second sampling would draw other bounds. The order has to tell rows apart for
    the numbers to be the same in every run. An empty table gives no rows.
    """
    spark = df.sparkSession
    place, of, before = fresh_names(df, "__place", "__range", "__before")
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    # The id is the partition's number in the upper 31 bits and the row's within it in the lower 33.
    placed = spill_table(spark, ranged.withColumn(place, F.monotonically_increasing_id()), "numbered")
    sizes = placed.groupBy(F.shiftright(place, 33).alias(of)).agg((F.max(F.col(place).bitwiseAND((1 << 33) - 1)) + 1).alias("n"))
    offsets = sizes.select(of, (F.sum("n").over(W.orderBy(of)) - F.col("n")).alias(before))
    joined = placed.withColumn(of, F.shiftright(place, 33)).join(F.broadcast(offsets), of)
    return joined.withColumn(column, (F.col(before) + F.col(place).bitwiseAND((1 << 33) - 1) + F.lit(start)).cast("long")).drop(place, of, before)


def append(corpus: DataFrame | None, new: DataFrame, order: list[str]) -> DataFrame:
    """corpus with new chunks after it: positions go on from the last one, ids of the new rows are their positions."""
    start = 0 if corpus is None else int(corpus.agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0])
    added = number(new.drop("id", "pos"), order, start=start).withColumn("id", F.col("pos"))
    added = with_paths(added).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CHUNK.fields], *[c for c in new.columns if c not in CHUNK.names])
    return added if corpus is None else corpus.unionByName(added, allowMissingColumns=True)


def text_list(texts: DataFrame, *, root: str = "text", order: str = "i") -> DataFrame:
    """Flat chunks `text0`, `text1` ... of a table (i, text): depth 0, no parent."""
    numbered = number(texts.select(order, "text"), [order])
    flat = numbered.select(F.col("pos").alias("id"), "pos", "text", F.lit(0).alias("depth"), F.concat(F.lit(root), F.col("pos").cast("string")).alias("node_path"), F.lit("<texts>").alias("source_file"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"))
    return with_paths(flat).select(*CHUNK.names)


def depth_histogram(chunks: DataFrame) -> DataFrame:
    """Chunks by depth."""
    return chunks.groupBy("depth").agg(F.count(F.lit(1)).alias("n_chunks"))


def hierarchy_warnings(chunks: DataFrame) -> DataFrame:
    """One row: the warning about a chunk table's shape, or null."""
    s = chunks.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("depth").alias("tiers"), F.coalesce(F.max("depth"), F.lit(0)).alias("deepest"))
    return s.select(F.when(F.col("n") == 0, "no chunks").when((F.col("tiers") == 1) & (F.col("deepest") > 0), "a single tier, deeper than the root").alias("warning"))
