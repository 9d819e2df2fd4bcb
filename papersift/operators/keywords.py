"""Keyword rewriting: W1 W2 W3 A9.

A keyword is replaced by its mapped list when that list is non-empty, else it
is kept; the result is a set (sorted here).  Null stays null, empty stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersift.operators.dedup import latest_per_key

#: A keyword of more than one in HOT_SHARE occurrences is hot; the sketch that finds them tracks TRACKED keywords.
HOT_SHARE, TRACKED = 200, 10_000


def mapping_table(records: DataFrame, order_col: str | None = None) -> DataFrame:
    """``{key, values}`` records to a map table with one record per key: the
    last one by ``order_col``; without an order, the record whose values sort last (null first)."""
    if order_col is None:
        return records.groupBy("key").agg(F.max("values").alias("values"))
    return latest_per_key(records.select("key", "values", order_col), "key", [order_col]).select("key", "values")


def _rewrite_expr(col: Column, lookup) -> Column:
    def one(k):
        mapped = lookup(k)
        return F.when(F.size(mapped) > 0, mapped).otherwise(F.array(k))

    return F.when(col.isNull(), F.lit(None)).otherwise(
        F.array_sort(F.array_distinct(F.flatten(F.transform(col, one)))))


def rewrite_with_dict(df: DataFrame, mapping: dict[str, list[str]], col: str = "keywords") -> DataFrame:
    """W1 for a mapping held by the caller: a literal map looked up per row (a
    projection: no join, no shuffle)."""
    if col not in df.columns:  # W3
        return df
    if not mapping:
        return df.withColumn(col, _rewrite_expr(F.col(col), lambda k: F.array().cast("array<string>")))
    m = F.create_map(*[x for k, v in mapping.items()
                       for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    return df.withColumn(col, _rewrite_expr(F.col(col), lambda k: F.element_at(m, k)))


def hot_keywords(df: DataFrame, col: str = "keywords") -> list[str]:
    """The keywords that may make up more than one in HOT_SHARE of all occurrences: at most about HOT_SHARE, by one
    aggregate over a frequent-items sketch (a sketch may name some that are a little rarer, and misses none)."""
    row = df.select(F.explode(col).alias("k")).where("k IS NOT NULL").agg(
        F.expr(f"approx_top_k(k, {2 * HOT_SHARE}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    # the sketch's count is never too low
    return [t["item"] for t in row["top"] or [] if t["count"] * HOT_SHARE > row["n"]]


def rewrite_with_table(df: DataFrame, mapping: DataFrame, col: str = "keywords", id_col: str = "id") -> DataFrame:
    """W1 for a mapping table of any size: explode, join the map, regroup per row.

    Hot keywords, a bounded number, are looked up in a literal map made of their mapping records, so the join only has
    keywords that are a small share of the rows.  Rows are told apart by a hash of all their columns, so null and repeated ids keep their own keywords;
    equal rows are rewritten once and come back as often as they were.  The row travels through the one
    regrouping aggregate, so nothing is joined back.
    """
    if col not in df.columns:  # W3
        return df
    m = mapping.select(F.col("key").alias("__kw"), F.col("values").alias("__vals"))
    others = [c for c in df.columns if c != col]
    rows = df.select(F.col(col).alias("__own"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("__row"))
    rows = rows.withColumn("__key", F.sha2(F.to_json(F.struct("__row", "__own"), {"ignoreNullFields": "false"}), 256))
    # posexplode_outer: a null or empty list gives one row with a null position;
    # a null keyword inside a list keeps its position and is kept as it is.
    exploded = rows.select("__key", "__row", F.col("__own").isNull().alias("__null"), F.posexplode_outer("__own").alias("__pos", "__kw"))
    hot = hot_keywords(df, col)
    known = {r["__kw"]: r["__vals"] for r in m.where(F.col("__kw").isin(hot)).collect()} if hot else {}
    # neither hot keywords nor the rows without one (null) take part in the join
    by_join = F.col("__kw").isNotNull() & ~F.col("__kw").isin(hot)
    literal = F.lit(None).cast("array<string>")
    if any(known.values()):
        literal = F.element_at(F.create_map(*[x for k, v in known.items() if v for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))]), F.col("__kw"))
    rest = exploded.where(~by_join).select("*", literal.alias("__vals"))
    joined = exploded.where(by_join).join(m, "__kw", "left").select(*rest.columns)
    mapped = joined.union(rest).select(
        "__key", "__row", "__null",
        F.coalesce("__pos", F.lit(0)).alias("__pos"),
        F.when(F.col("__pos").isNull(), F.array().cast("array<string>"))
        .when(F.size("__vals") > 0, F.col("__vals"))
        .otherwise(F.array(F.col("__kw"))).alias("__out"))
    regrouped = mapped.groupBy("__key").agg(
        F.first("__row").alias("__row"), F.max("__null").alias("__null"),
        F.flatten(F.collect_list("__out")).alias("__flat"),
        F.count_if(F.col("__pos") == 0).alias("__times"))
    new = F.when(F.col("__null"), F.lit(None).cast("array<string>")).otherwise(F.array_sort(F.array_distinct("__flat")))
    copies = regrouped.select("__row", new.alias("__new"), F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))).alias("__copy"))
    return copies.select(*[(F.col("__new") if c == col else F.col(f"__row.`{c}`")).alias(c) for c in df.columns])


def keyword_counts(df: DataFrame, col: str = "keywords") -> DataFrame:
    """Keyword frequency over all rows (partial aggregation before the shuffle)."""
    return df.select(F.explode(col).alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
