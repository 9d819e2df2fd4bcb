"""Exact duplicates by a tree-merge of sorted digest runs, with DataFrame functions only.

1. A text is normalised (each run of white space is one space) and digested.  A run is RUN_ROWS neighbouring rows of a
   task; it is aggregated to one entry per digest, with its ids, before anything else is shuffled, so a group of copies
   of any size is split by runs from the start.
2. Runs lie in ``FAN ** rounds`` slots.  In round k, a slot's k-th digit is replaced by the digest's: partitions
   exchange parts of their runs with the FAN - 1 partners whose numbers differ in that digit only, and merge what they
   get, sorted, keeping the smallest identifier and the size of each verified digest.  After the last round equal
   digests share a slot.  A digest's entries shrink FAN-fold each round, so no partition ever gets them all at once.
3. The groups of two or more go back to the runs' entries by digest (a group meets its runs, not its rows), and each
   entry's ids are laid out again as rows.

Verified: entries are equal where the 256-bit digest and the length of the normalised text are.

Defined results: null text is empty; empty texts equal each other, and texts of white space only equal " "; of rows with
the same id and text one stays; a null id stays only where all equal texts have null ids; other columns are not read;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersift.llm.common import stored

#: Rows of a task that make one run, and runs that are merged into one in a round.
RUN_ROWS, FAN = 1 << 16, 8
#: White space runs that are not already one space.
_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _SPACE, " ")


def runs(docs: DataFrame) -> DataFrame:
    """``run, digest, chars, ids, least, n``: one entry per run and digest, its ids in order, nulls last."""
    row = F.monotonically_increasing_id()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text"))
    own = own.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.length("text").cast("long").alias("chars"), F.floor(row / RUN_ROWS).alias("run"))
    entry = own.groupBy("run", "digest", "chars").agg(F.collect_list(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("ids"))
    entry = entry.withColumn("ids", F.array_sort("ids"))
    least = F.struct(F.col("ids")[0]["none"].alias("none"), F.col("ids")[0]["doc_id"].alias("doc_id"), "run")
    return entry.select("run", "digest", "chars", F.col("ids.doc_id").alias("ids"), F.size("ids").cast("long").alias("n"), least.alias("least"))


def merged(entries: DataFrame, slots_at_least: int | None = None) -> DataFrame:
    """``digest, chars, n, least``: one row per distinct text, by rounds of exchange and sorted merge."""
    spark = entries.sparkSession
    rounds, wanted = 1, slots_at_least or int(spark.conf.get("spark.sql.shuffle.partitions"))
    while FAN**rounds < wanted:
        rounds += 1
    slots, key = FAN**rounds, ["slot", "digest", "chars"]
    mark = F.xxhash64("digest")
    now = entries.select(F.pmod(F.xxhash64("run"), F.lit(slots)).cast("int").alias("slot"), "digest", "chars", "n", "least")
    for k in range(rounds):
        unit = FAN**k
        digit = lambda x: F.pmod(F.floor(x / unit), F.lit(FAN)).cast("int")
        slot = F.col("slot") + unit * (digit(F.pmod(mark, F.lit(slots))) - digit(F.col("slot")))
        moved = now.withColumn("slot", slot.cast("int")).repartitionById(slots, "slot").sortWithinPartitions(*key)
        now = moved.groupBy(*key).agg(F.min("least").alias("least"), F.sum("n").alias("n"))
    return now.select("digest", "chars", "n", "least")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    entries = stored(runs(docs), "runs")
    groups = stored(merged(entries).where("n > 1"), "groups")
    groups = groups.select("digest", "chars", F.col("n").alias("group_size"), F.col("least").alias("first"))
    known = entries.join(groups, ["digest", "chars"], "left")
    first = F.coalesce("first", "least")
    known = known.select("run", "digest", first.alias("first"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.posexplode("ids").alias("place", "doc_id"))
    return known.select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        ((F.col("run") == F.col("first.run")) & (F.col("place") == 0)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )

