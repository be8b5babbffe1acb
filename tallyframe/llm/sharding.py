"""A random order of all records, and equal shards of it, by an external shuffle in two passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: What a bucket may hold, so that it can be shuffled in memory: bytes of text and records.
BUCKET_BYTES, BUCKET_ROWS = 16 << 20, 2048
#: Buckets that one task gathers.
TASK_BUCKETS = 16
#: Classes of rows, by a hash of id and text, that are looked up for copies.
COPY_CLASSES = 1 << 20
#: Buckets whose sizes are added up in one window.
RUN = 4096


def fisher_yates(n: Column, seed: int, bucket: Column) -> Column:
    """A permutation of 0 to n - 1 as an array, by the inside-out Fisher-Yates shuffle.

    The place of the i-th element is drawn from 0 to i by a hash of seed, bucket and i.
    """

    def step(done: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(F.lit(seed), bucket, i), i.cast("long") + 1).cast("int")
        moved = F.concat(
            F.slice(done, F.lit(1), j), F.array(i), F.slice(done, j + 2, i - j - 1), F.array(F.get(done, j))
        )
        return F.when(j == i, F.concat(done, F.array(i))).otherwise(moved)

    rest = F.when(n > 1, F.sequence(F.lit(1), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rest, F.array(F.lit(0)), step)


def _offsets(buckets: DataFrame) -> DataFrame:
    """How many records stand in the buckets before each one; sums of runs of buckets are added up first."""
    counts = buckets.select("bucket", "n", F.floor(F.col("bucket") / RUN).alias("run"))
    runs = counts.groupBy("run").agg(F.sum("n").alias("n_run"))
    before = F.sum("n_run").over(Window.orderBy("run")) - F.col("n_run")
    runs = runs.select("run", before.alias("run_before"))
    within = F.sum("n").over(Window.partitionBy("run").orderBy("bucket")) - F.col("n")
    return counts.withColumn("within", within).join(runs, "run").select("bucket", (F.col("run_before") + F.col("within")).alias("before"))


def shuffle_and_shard(
    df: DataFrame,
    shards: int = 24,
    seed: int = 17,
    doc_id: str = "doc_id",
    text: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """All records in a random order that the seed decides, dealt to shards of equal numbers of records.

    First pass: each record goes to a bucket by a hash of seed, id and text; there are as many
    buckets as it takes for one to hold about ``bucket_bytes`` and ``bucket_rows``. Second pass:
    each bucket is gathered, put into a canonical order, shuffled by Fisher and Yates, and written.
    The buckets in a row are the random order; shard k holds its k-th part, so numbers
    of records differ by one at most, and a bucket lies in one shard or two neighbours.

    Result: ``doc_id``, ``size`` (UTF-8 bytes of the text, and 8), ``text_crc32``, ``shard``, ``slot`` (the
    place in the shard, from 0) and ``record`` (a struct of all columns given, so that no names
    clash). A null text counts as empty; rows with a null id take part by their text. Rows that
    are equal in id and text (and the few that share one of ``COPY_CLASSES`` hash values with such) are
    told apart by their place in the input, so a third of all rows
    may be copies and still spreads evenly; the order of all other rows does not depend on how the input is cut into tasks,
    but for the numbers of copies before them. Fewer rows
    than shards leave shards empty; no rows give no rows.

    What is written is read by later steps, so a lost executor never draws anew.
    """
    value = F.col(f"`{text}`").cast("string")
    records = df.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        (F.octet_length(F.coalesce(value, F.lit(""))).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(value, F.lit(""))).alias("text_crc32"),
        F.xxhash64(value).alias("fp"),
        F.monotonically_increasing_id().alias("place"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"),
    )
    groups = records.groupBy("doc_id", "fp").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    groups = written(groups, "shards-groups")
    rows, total = (x or 0 for x in groups.agg(F.sum("n"), F.sum("size")).first())
    n_buckets = max(1, -(-rows // bucket_rows), -(-total // bucket_bytes))
    # At most COPY_CLASSES numbers are broadcast, however many rows are copies.
    of_class = F.pmod(F.xxhash64("doc_id", "fp"), F.lit(COPY_CLASSES)).alias("class")
    copies = groups.where("n > 1").select(of_class, F.lit(True).alias("copied")).distinct()
    marked = records.withColumn("class", of_class).join(F.broadcast(copies), "class", "left")
    marked = marked.withColumn("copy", F.when(F.col("copied"), F.col("place")))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "fp", "copy"), F.lit(n_buckets))
    order = F.struct(F.xxhash64(F.lit(seed + 1), "doc_id", "fp", "copy").alias("order"), "doc_id", "fp", "place")
    payload = F.struct("doc_id", "size", "text_crc32", "record")
    own_partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_tasks = max(-(-n_buckets // TASK_BUCKETS), min(n_buckets, own_partitions))
    gathered = (
        marked.withColumn("bucket", bucket)
        .repartition(n_tasks, "bucket")
        .groupBy("bucket")
        .agg(F.collect_list(F.struct(order.alias("by"), payload.alias("row"))).alias("found"))
    )
    by_key = lambda a, b: F.when(a["by"] < b["by"], -1).when(a["by"] > b["by"], 1).otherwise(0)
    ordered = F.transform(F.array_sort("found", by_key), lambda x: x["row"])
    permuted = fisher_yates(F.col("n"), seed, F.col("bucket"))
    shuffled = gathered.select("bucket", F.size("found").alias("n"), ordered.alias("found")).withColumn("permuted", permuted)
    buckets = written(shuffled, "shards-buckets")
    # Each field is taken out of its own array, so that a field that nobody asks for is not read.
    fields = ("doc_id", "size", "text_crc32", "record")
    placed = buckets.select("bucket", *[F.col(f"found.{c}").alias(c) for c in fields], F.posexplode("permuted").alias("at", "own"))
    placed = placed.select("bucket", "at", *[F.get(c, F.col("own")).alias(c) for c in fields])
    rank = F.col("before") + F.col("at")
    dealt = placed.join(_offsets(buckets), "bucket").withColumn("rank", rank)
    # Shard k begins at the rank floor(k * rows / shards).
    dealt = dealt.withColumn("shard", F.expr(f"cast(((rank + 1) * {shards} - 1) div {max(rows, 1)} as int)"))
    slot = F.expr(f"rank - (cast(shard as bigint) * {rows}) div {shards}")
    return dealt.select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"), "record")


def write_shards(df: DataFrame, path: str, shards: int = 24, seed: int = 17, **named: str) -> None:
    """Write the records in their random order: a folder for each shard, its files by slot.

    Each file holds a run of slots in order, with ``slot`` and ``record``; a large shard has several
    files, so no task writes a whole one.
    """
    dealt = shuffle_and_shard(df, shards, seed, **named).select("shard", "slot", "record")
    ordered = dealt.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
