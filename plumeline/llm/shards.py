"""Sharding by extendible hashing, with DataFrame functions only.

A directory of hash prefixes points to buckets; a bucket over the byte limit splits on another bit,
and others stay as they are, so depths differ. Sums are taken over prefixes a few bits deeper than an
even spread would need and rolled up to a few bits above it, so that a round settles these levels at
once; only rows whose bucket is still too large go on to a round with more bits, and only prefixes
that already fit at the top are rolled up further.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

BITS = 60
#: Bits beyond an even spread in the first round, and bits of each further round.
AHEAD = 5


def hash60(key: Column) -> Column:
    """The first 60 bits of the md5 of a key's text; null counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _rolled(cells: DataFrame, cell: Column) -> DataFrame:
    return cells.groupBy(cell.alias("cell")).agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.min("h0").alias("h0"), F.max("h1").alias("h1"))


def _leaves(cells: DataFrame, low: int, high: int, limit: int, least: int) -> DataFrame:
    """(cell, s) for cells of `high` bits that lie in a bucket which fits; s has the bucket's depth,
    the least from `least` at which it does, and its shard_bytes, shard_rows and one_key.

    Depths from `low` are looked at first; each cell becomes high - low + 1 rows.
    """
    up = cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    up = up.withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
    sums = up.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"), (F.min("h0") == F.max("h1")).alias("one_key"))
    fit = sums.where((F.col("shard_bytes") <= limit) | F.col("one_key"))
    found = up.select("cell", "depth", "prefix").join(fit, ["depth", "prefix"])
    found = found.groupBy("cell").agg(F.min(F.struct("depth", "shard_bytes", "shard_rows", "one_key")).alias("s"))
    if low == least or found.where(f"s.depth = {low}").isEmpty():
        return found
    above = _leaves(_rolled(cells, F.shiftright("cell", high - low)), max(least, low - 2 * AHEAD), low, limit, least)
    above = above.select(F.col("cell").alias("top"), F.col("s").alias("t"))
    return found.join(above, F.shiftright("cell", high - low) == above.top, "left").select("cell", F.coalesce("t", "s").alias("s"))


def _split_one_key(rows: DataFrame, limit: int) -> DataFrame:
    """Parts of buckets that hold one key and are too large: no bit can split them, so places do.

    Running sums are taken within the written table's partitions and over the partitions' sums.
    """
    rows = rows.withColumn("chunk", F.shiftright("rid", 33))
    chunks = rows.groupBy("h", "chunk").agg(F.sum("bytes").alias("s"), F.max("bytes").alias("most"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("h").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = chunks.select("h", "chunk", before.alias("before"), F.max("most").over(Window.partitionBy("h")).alias("most"))
    own = F.coalesce(F.sum("bytes").over(Window.partitionBy("h", "chunk").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    step = F.greatest(F.lit(1), F.lit(limit) - F.col("most"))
    return rows.withColumn("own", own).join(chunks, ["h", "chunk"]).withColumn("part", F.floor((F.col("before") + F.col("own")) / step).cast("long"))


def assign_shards(docs: DataFrame, limit: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, shard, depth, part, bytes, shard_bytes, shard_rows).

    shard holds the prefix as `depth` binary digits (none where all rows fit one shard); bytes is the
    text's length in UTF-8, zero for null. Buckets split until their texts fit `limit` bytes. A
    bucket of one key can't split on bits: if it is too large, its rows are dealt to parts within
    the limit by their place, and shard_bytes and shard_rows are the bucket's. A single text above
    the limit stands alone in its part. A null id hashes as the empty text; repeated ids and rows
    share a bucket. Other columns are left out.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long").alias("bytes"))
    rows = scratch.write(rows.withColumn("h", hash60(F.col("doc_id"))).withColumn("rid", F.monotonically_increasing_id()), "rows")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    even = max(1, math.ceil(math.log2(max(1, total / limit))))
    least, low, high = 0, max(0, even - AHEAD), min(BITS, even + AHEAD)
    done: list[DataFrame] = []
    while True:
        sums = rows.select(F.shiftright("h", BITS - high).alias("cell"), F.col("bytes").alias("b"), F.lit(1).cast("long").alias("n"), F.col("h").alias("h0"), F.col("h").alias("h1"))
        cells = scratch.write(_rolled(sums, F.col("cell")), f"cells{high}")
        leaf = _leaves(cells, low, high, limit, least).select("cell", "s.*")
        placed = rows.withColumn("cell", F.shiftright("h", BITS - high)).join(leaf, "cell", "left")
        placed = scratch.write(placed, f"placed{high}")
        fits = placed.where("depth is not null")
        alone = F.col("one_key") & (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
        done += [fits.where(~alone).withColumn("part", F.lit(0).cast("long")), _split_one_key(fits.where(alone), limit)]
        rest = placed.where("depth is null")
        if high >= BITS or rest.isEmpty():
            break
        rows, least, low, high = rest.select("doc_id", "bytes", "h", "rid"), high + 1, high + 1, min(BITS, high + AHEAD)
    shard = F.when(F.col("depth") > 0, F.expr(f"lpad(bin(shiftright(h, {BITS} - depth)), depth, '0')")).otherwise("")
    columns = ["doc_id", shard.alias("shard"), F.col("depth").cast("int").alias("depth"), "part", "bytes", "shard_bytes", "shard_rows"]
    out = done[0].select(*columns)
    for more in done[1:]:
        out = out.union(more.select(*columns))
    return out


def write_shards(docs: DataFrame, path: str, limit: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs as Parquet, one folder for each shard and part; every row is written once.

    A shard follows from a row's id, so rows are joined to the shards of distinct ids. Only the rows
    of one key that is too large for a shard are dealt to parts by their place. Columns of docs that
    are named shard or part are replaced by the folder's.
    """
    scratch = Scratch(docs.sparkSession, "write-shards")
    placed = assign_shards(docs, limit, id_col, text_col)
    ids = placed.groupBy(F.col("doc_id").alias("id")).agg(F.min("shard").alias("shard"), F.max("part").alias("most"))
    ids = scratch.write(ids, "ids")
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long").alias("bytes"), F.struct(*(docs[c] for c in docs.columns if c not in ("shard", "part"))).alias("row"))
    one = lambda of, how: rows.join(of.withColumnRenamed("id", "known"), F.col("id").eqNullSafe(F.col("known")), how)
    whole = one(ids.where("most = 0"), "inner").select("row.*", "shard", F.lit(0).cast("long").alias("part"))
    large = scratch.write(one(ids.where("most > 0"), "inner").select("row", "bytes", "shard", hash60(F.col("id")).alias("h"), F.monotonically_increasing_id().alias("rid")), "large")
    dealt = _split_one_key(large, limit).select("row.*", "shard", "part")
    whole.union(dealt).repartition("shard", "part").write.partitionBy("shard", "part").parquet(path)
