"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


#: Slots that one row makes at most at a time.
RUN = 4096


def _unit(key: Column, shard: int, salt: str) -> Column:
    """A number in (0, 1) that key, shard and salt alone decide: 52 bits of an MD5 digest, so any other engine can recompute it."""
    digest = F.md5(F.concat_ws(":", F.lit(salt), F.lit(shard), F.coalesce(key.cast("string"), F.lit("\x00"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rendezvous_shard(key: Column, weights: Sequence[float], salt: str = "") -> Column:
    """The shard, 0 .. len(weights) - 1, with the highest score -weight / ln(u(key, shard)); the lower number on a tie.

    Each shard gets keys in proportion to its weight. A shard that is added takes keys only into itself, a shard that is
    removed (weight 0) gives up only its own, and a weight that grows only attracts: no other pair of shards exchanges keys.
    A null key counts as one key of its own.
    """
    if not weights or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must be non-negative, with one above 0")
    scores = [F.struct((F.lit(-float(w)) / F.log(_unit(key, k, salt))).alias("score"), F.lit(-k).alias("rank")) for k, w in enumerate(weights) if w > 0]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["rank"]).cast("int")


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], *, grown: Sequence[float] | None = None, salt: str = "", shard_col: str = "shard", grown_col: str = "grown_shard") -> DataFrame:
    """df with the shard of each row, and with `grown` also its shard under those weights. A projection: no row moves, every column is kept.

    Columns of df that are named like the two results are replaced.
    """
    out = df.withColumn(shard_col, rendezvous_shard(F.col(f"`{key}`"), weights, salt))
    return out.withColumn(grown_col, rendezvous_shard(F.col(f"`{key}`"), grown, salt)) if grown else out


def number_slots(df: DataFrame, shard_col: str = "shard", order: Sequence[str] = ("doc_id",), *, buckets: int = 4096, slot_col: str = "slot") -> DataFrame:
    """Number the rows of each shard 0, 1, 2 ... without gaps and without a task per shard.

    Rows that agree in all columns are counted before anything is shuffled, so a key with a third of all rows is a single
    row of the shuffle. The rest are cut into `buckets` by an MD5 digest of the columns in `order`, which any engine can recompute; the number
    of rows of each bucket (at most shards times buckets rows) gives its offset, and only within a bucket are rows sorted, by `order`
    and then the other columns. Equal rows get consecutive slots, in no particular order since nothing tells them apart; they are made in runs of at most
    RUN, each a row of a last shuffle, so neither an array nor a task depends on how many rows are equal.
    """
    cols = [f"`{c}`" for c in df.columns]
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    digest = F.md5(F.concat_ws(":", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in order]))
    counted = counted.withColumn("__b", (F.conv(F.substring(digest, 1, 6), 16, 10).cast("int") % buckets))
    counted = counted.repartition(shard_col, "__b")
    shard = f"`{shard_col}`"
    totals = counted.groupBy(shard, "__b").agg(F.sum("__n").alias("__t"))
    offsets = totals.select(F.col(shard).alias("__s"), F.col("__b").alias("__ob"), (F.sum("__t").over(W.partitionBy(shard).orderBy("__b")) - F.col("__t")).alias("__offset"))
    inner = W.partitionBy(shard, "__b").orderBy(*[f"`{c}`" for c in order], *[c for c in cols if c.strip("`") not in order])
    ranked = counted.withColumn("__end", F.sum("__n").over(inner.rowsBetween(W.unboundedPreceding, 0)))
    joined = ranked.join(offsets, ranked[shard_col].eqNullSafe(offsets["__s"]) & (ranked["__b"] == offsets["__ob"]), "left")
    last = F.col("__offset") + F.col("__end") - 1
    runs = joined.select(*cols, last.alias("__last"), (last - F.col("__n") + 1).alias("__first"))
    # A group of equal rows becomes runs of slots, and those runs of RUN slots, which are spread over all tasks before they become rows.
    for step in (RUN * RUN, RUN):
        runs = runs.select(*cols, "__last", F.explode(F.sequence("__first", "__last", F.lit(step))).alias("__first")).withColumn("__last", F.least("__last", F.col("__first") + step - 1))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartition(parts, shard, "__first").select(*cols, F.explode(F.sequence("__first", "__last")).alias(slot_col))


def shard_documents(docs: DataFrame, shards: int = 8, *, salt: str = "treegrain") -> DataFrame:
    """The digest rows of a sharded corpus: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 bytes of the text (null: none) plus 1; text_crc32 is that of an empty text for null. Rows with the same doc_id
    go to the same shard, whatever their text; a null doc_id counts as one key. Repeated rows stay apart, each with its own slot.
    An empty table gives no rows; other columns of the input are ignored.
    """
    thin = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    thin = thin.select("doc_id", (F.col("bytes") + 1).alias("size"), "text_crc32")
    assigned = assign_shards(thin, "doc_id", [1.0] * shards, grown=[1.0] * (shards + 1), salt=salt)
    slotted = number_slots(assigned, order=("doc_id", "size", "text_crc32"))
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
