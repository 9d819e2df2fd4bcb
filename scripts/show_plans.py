"""Print the physical plans of the key operators (used to write PLANS.md).

Usage: python scripts/show_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from papersift.functions.hashing import hash_unit  # noqa: E402
from papersift.operators import cache as cache_ops  # noqa: E402
from papersift.operators import corpus, keywords, render, sampling  # noqa: E402
from papersift.plans import catalog, catalog_runs, token_docs  # noqa: E402
from papersift.plans import testdata as td  # noqa: E402
from papersift.session import local_session  # noqa: E402

KEEP = re.compile(r"(Join|dynamicpruning|Exchange|Aggregate|TakeOrdered|Scan|PushedFilters|PartitionFilters|ReadSchema|"
                  r"WholeStageCodegen|Window|Generate|BroadcastExchange|Sort |Project|Filter|Union)")


def show(title, df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    print(f"### {title}\n\n```")
    for line in plan.splitlines():
        if KEEP.search(line):
            print(line[:220])
    print("```\n")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # show the static plan
    papers, prefs = td.papers(spark, sf), td.preferences(spark, sf)
    _, unrated = corpus.split_rated(papers, prefs)
    show("J2 unrated papers: anti join without a hint, pruned scans", unrated.select("id", "updated"))
    lc = cache_ops.latest_cached(td.cache(spark, sf), td.wanted(spark, sf), "en", ("click", "view*"))
    show("P11+D2 newest accepted digest per id: partial aggregate before the shuffle", lc)
    ev = catalog._events_scored(spark, sf)
    u = hash_unit(F.col("id"), 42, "show")
    first = ev.groupBy(sampling.stratum(F.col("score"), 0.85, 0.6).alias("_g"), F.floor(u * 16384).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    show("R3-R5 first scan of the cutoffs: rows by stratum and bucket, combined before the shuffle", first)
    show("R2-R6 the draw itself: one projection, no shuffle", sampling.adaptive_sample(ev, 0.1, 0.85, 0.6))
    kw = keywords.rewrite_with_table(catalog._part_keywords(spark, sf),
                                     keywords.mapping_table(catalog._part_keyword_map(spark, sf)))
    show("W1 keyword rewrite with a mapping table", kw)
    orders = catalog._orders_as_papers(spark, sf)
    show("P4 date window: the text predicate reaches the scan",
         corpus.date_window(orders.select("id", "updated"), "1996-03-01", "1996-06-30"))
    show("B0-B16 renderer: one exchange, of the documents", render.render(token_docs.document_titles(spark, sf)))
    show("S4 cache scan: pruned by the wanted months while it runs", catalog_runs.q_cache_scan(spark, sf))
    show("P17 late embeddings: only the files of chosen rows", catalog_runs.q_training_rows_late(spark, sf))
    spark.stop()


if __name__ == "__main__":
    main()
