"""Registered queries over the driver's tables, each with its DuckDB oracle.

Every query reads whole tables (or frames Spark derives from them); limits
appear only where a draw of a fixed size is the operator itself.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papersift.functions.hashing import sql_hash_unit
from papersift.operators import corpus, dedup, sampling, scoring, training
from papersift.plans import testdata as td

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _cte(**parts: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in parts.items()) + "\n"


EMB = list(td.EMBEDDING_COLUMNS)

# ---------------------------------------------------------------- corpus

CATEGORIES = ("en", "src3", "src7")


@register("category_any", _cte(papers=td.PAPERS_SQL) + """
SELECT id, array_to_string(categories, ',') AS categories, updated
FROM papers
WHERE list_has_any(categories, ['en', 'src3', 'src7'])
  AND emb_a IS NOT NULL AND emb_b IS NOT NULL
""")
def q_category_any(spark, sf):
    p = corpus.with_all_embeddings(corpus.category_any(td.papers(spark, sf), CATEGORIES), EMB)
    return p.select("id", F.array_join("categories", ",").alias("categories"), "updated")


@register("rated_papers", _cte(papers=td.PAPERS_SQL, prefs=td.PREFERENCES_SQL) + """
SELECT p.id, r.preference, p.updated FROM papers p JOIN prefs r ON p.id = r.id
""")
def q_rated(spark, sf):
    rated, _ = corpus.split_rated(td.papers(spark, sf), td.preferences(spark, sf))
    return rated.select("id", "preference", "updated")


@register("unrated_papers", _cte(papers=td.PAPERS_SQL, prefs=td.PREFERENCES_SQL) + """
SELECT p.id, p.updated FROM papers p
WHERE p.id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM prefs r WHERE r.id = p.id)
""")
def q_unrated(spark, sf):
    _, unrated = corpus.split_rated(td.papers(spark, sf), td.preferences(spark, sf))
    return unrated.select("id", "updated")


def _two_rating_files(spark, sf) -> DataFrame:
    """Two rating files over labels: the first rates by quality, the later one
    (ids shifted by one) by toxicity then quality.  Their ids overlap."""
    lab = td.table(spark, sf, "labels")
    first = lab.select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("quality") == 1, "like").otherwise("dislike").alias("preference"),
        F.lit("ratings/0-init.csv").alias("source_file"),
    )
    later = lab.select(
        (F.col("doc_id") + 1).cast("string").alias("id"),
        F.when(F.col("toxic") == 1, "neutral").when(F.col("quality") == 1, "like").otherwise("dislike").alias("preference"),
        F.lit("ratings/1-update.csv").alias("source_file"),
    )
    return first.unionByName(later)


@register("ratings_dedup", """
WITH r AS (
  SELECT CAST(doc_id AS VARCHAR) AS id,
         CASE WHEN quality = 1 THEN 'like' ELSE 'dislike' END AS preference,
         'ratings/0-init.csv' AS source_file FROM labels
  UNION ALL
  SELECT CAST(doc_id + 1 AS VARCHAR),
         CASE WHEN toxic = 1 THEN 'neutral' WHEN quality = 1 THEN 'like' ELSE 'dislike' END,
         'ratings/1-update.csv' FROM labels),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source_file DESC,
        list_position(['dislike', 'neutral', 'like'], preference) DESC) AS rn FROM r)
SELECT id, preference, source_file FROM k WHERE rn = 1
""")
def q_ratings_dedup(spark, sf):
    return dedup.dedupe_ratings(_two_rating_files(spark, sf)).select("id", "preference", "source_file")


def _orders_as_papers(spark, sf) -> DataFrame:
    o = td.table(spark, sf, "orders")
    return o.select(
        td.archive_id().alias("id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated"),
        "o_orderkey", "o_orderstatus", "o_totalprice",
    )


ORDERS_AS_PAPERS_SQL = f"""
SELECT {td.ARCHIVE_ID_SQL} AS id, strftime(o_orderdate, '%Y-%m-%d') AS updated,
       o_orderkey, o_orderstatus, o_totalprice FROM orders
"""


@register("not_digested", _cte(op=ORDERS_AS_PAPERS_SQL) + """
, dig AS (SELECT op.id FROM op WHERE EXISTS
          (SELECT 1 FROM lineitem l WHERE l.l_orderkey = op.o_orderkey AND l.l_returnflag = 'R'))
SELECT id, o_orderstatus FROM op WHERE NOT EXISTS (SELECT 1 FROM dig WHERE dig.id = op.id)
""")
def q_not_digested(spark, sf):
    op = _orders_as_papers(spark, sf)
    returned = td.table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("o_orderkey"))
    digested = op.join(returned, "o_orderkey", "left_semi").select("id")
    return corpus.remove_digested(op, digested).select("id", "o_orderstatus")


@register("date_range", _cte(op=ORDERS_AS_PAPERS_SQL) + """
SELECT id, updated FROM op WHERE updated >= '1996-03-01' AND updated <= '1996-06-30'
""")
def q_date_range(spark, sf):
    return corpus.date_window(_orders_as_papers(spark, sf), "1996-03-01", "1996-06-30").select("id", "updated")


@register("last_n_days", _cte(op=ORDERS_AS_PAPERS_SQL) + """
SELECT id, updated FROM op WHERE updated >= strftime(DATE '1998-08-02' - INTERVAL 30 DAY, '%Y-%m-%d')
""")
def q_last_n_days(spark, sf):
    return corpus.date_window(_orders_as_papers(spark, sf), last_n_days=30, today=_dt.date(1998, 8, 2)).select(
        "id", "updated")


@register("year_cutoff", _cte(op=ORDERS_AS_PAPERS_SQL) + """
SELECT id, updated, CAST(substr(updated, 1, 4) AS INTEGER) AS year
FROM op WHERE CAST(substr(updated, 1, 4) AS INTEGER) >= 1998
""")
def q_year_cutoff(spark, sf):
    return corpus.year_cutoff(_orders_as_papers(spark, sf), 1998).select("id", "updated", "year")


@register("id_list", _cte(op=ORDERS_AS_PAPERS_SQL) + """
, lists AS (SELECT ' ' || CAST(p_partkey * 3 AS VARCHAR) || ' ,, ' || CAST(p_partkey * 3 + 1 AS VARCHAR) || ' , ' AS arg FROM part),
ids AS (SELECT DISTINCT trim(x) AS k FROM lists, unnest(string_split(arg, ',')) AS t(x) WHERE trim(x) <> '')
SELECT id, o_orderstatus FROM op WHERE CAST(o_orderkey AS VARCHAR) IN (SELECT k FROM ids)
""")
def q_id_list(spark, sf):
    from papersift.functions.text import parse_id_list

    part = td.table(spark, sf, "part")
    arg = F.concat(F.lit(" "), (F.col("p_partkey") * 3).cast("string"), F.lit(" ,, "),
                   (F.col("p_partkey") * 3 + 1).cast("string"), F.lit(" , "))
    ids = part.select(F.explode(parse_id_list(arg)).alias("o_orderkey_text"))
    op = _orders_as_papers(spark, sf).withColumn("o_orderkey_text", F.col("o_orderkey").cast("string"))
    return corpus.id_list_filter(op, ids, "o_orderkey_text").select("id", "o_orderstatus")


# ---------------------------------------------------------------- training

BG_RATE = 1.0  # the data has fewer unrated rows than 5 per like; see SURVEY §7.3


def _training(spark, sf):
    papers = corpus.with_all_embeddings(td.papers(spark, sf), EMB)
    rated, unrated = corpus.split_rated(papers, td.preferences(spark, sf))
    return training.training_set(rated, unrated, EMB, bg_sample_rate=BG_RATE, seed=42)


TRAINING_SQL = _cte(papers="SELECT * FROM (" + td.PAPERS_SQL + ") WHERE emb_a IS NOT NULL AND emb_b IS NOT NULL",
                    prefs=td.PREFERENCES_SQL) + f"""
, rated AS (SELECT p.id, CASE WHEN r.preference = 'like' THEN 1 ELSE 0 END AS label
            FROM papers p JOIN prefs r ON p.id = r.id),
unrated AS (SELECT p.id FROM papers p WHERE NOT EXISTS (SELECT 1 FROM prefs r WHERE r.id = p.id)),
quota AS (SELECT CAST(floor({BG_RATE!r} * count(*)) AS BIGINT) AS q FROM rated WHERE label = 1),
ranked AS (SELECT id, row_number() OVER (ORDER BY {sql_hash_unit('id', 42, 'negatives')}, id) AS rn FROM unrated),
training AS (
  SELECT id, label, 'rated' AS origin FROM rated
  UNION ALL
  SELECT id, 0 AS label, 'pseudo' AS origin FROM ranked WHERE rn <= (SELECT q FROM quota))
"""


@register("training_set", TRAINING_SQL + "SELECT id, label, origin FROM training")
def q_training_set(spark, sf):
    return _training(spark, sf).select("id", "label", "origin")


@register("class_weights", TRAINING_SQL + """
, c AS (SELECT label, count(*) AS n FROM training GROUP BY label)
SELECT label, n, round((SELECT sum(n) FROM c) / (2.0 * n), 9) AS weight FROM c
""")
def q_class_weights(spark, sf):
    w = training.class_weights(_training(spark, sf))
    return w.select("label", "n", F.round("weight", 9).alias("weight"))


@register("train_and_score")
def q_train_and_score(spark, sf):
    """M1-M3: iterative fit, so no SQL oracle (rows only; pytest checks the fit)."""
    papers = corpus.with_all_embeddings(td.papers(spark, sf), EMB)
    rated, unrated = corpus.split_rated(papers, td.preferences(spark, sf))
    train = training.training_set(rated, unrated, EMB, bg_sample_rate=BG_RATE, seed=42)
    model = training.fit_logistic(train, EMB, C=1.0, max_iter=1000)
    return scoring.score(model, unrated, EMB).select("id", F.round("score", 6).alias("score"))


@register("fit_gradient", """
SELECT CAST(unnest(range(0, 65)) AS INTEGER) AS feature, 0.0 AS gradient
""")
def q_fit_gradient(spark, sf):
    """M1-M3: the gradient of the penalised loss at the fit, by feature (64 is the intercept); zero at the optimum."""
    train = _training(spark, sf)
    model = training.fit_logistic(train, EMB, C=1.0, max_iter=1000)
    weights = training.class_weights(train).select("label", "weight", F.sum("n").over(Window.partitionBy()).alias("total"))
    scored = scoring.score(model, train, EMB).join(weights, "label")
    pull = F.col("weight") * (F.col("score") - F.col("label")) / F.col("total")
    x = F.concat(F.col("emb_a"), F.col("emb_b")).cast("array<double>")
    parts = scored.select("total", pull.alias("pull"), F.posexplode(F.concat(x, F.array(F.lit(1.0)))).alias("feature", "x"))
    sums = parts.groupBy("feature").agg(F.sum(F.col("pull") * F.col("x")).alias("g"), F.max("total").alias("total"))
    own = F.array(*[F.lit(float(c)) for c in model.coefficients], F.lit(0.0))
    return sums.select("feature", F.round(F.abs(F.col("g") + F.element_at(own, F.col("feature") + 1) / F.col("total")), 3).alias("gradient"))


# ---------------------------------------------------------------- quota draw

def _events_scored(spark, sf) -> DataFrame:
    ev = td.table(spark, sf, "events")
    return ev.select(F.col("event_id").cast("string").alias("id"),
                     (F.col("value") / (F.col("value") + F.lit(35.0))).alias("score"))


EVENTS_SCORED_SQL = "SELECT CAST(event_id AS VARCHAR) AS id, value / (value + 35.0) AS score FROM events"


def sample_sql(base_sql: str, rate: float, high: float, boundary: float, seed: int = 42, purpose: str = "show") -> str:
    """DuckDB form of ``sampling.adaptive_sample``: a window per stratum ranks rows by (key, id)."""
    u = sql_hash_unit("id", seed, purpose)
    if high > boundary:
        bkey = f"-ln(u) / exp(2.0 * (score - {boundary!r}) / {high - boundary!r})"
    else:
        bkey = "u"
    return f"""
WITH base AS ({base_sql}),
s AS (SELECT *, CASE WHEN score >= {high!r} THEN 'high'
                     WHEN score >= {boundary!r} AND score < {high!r} THEN 'boundary'
                     ELSE 'low' END AS stratum, {u} AS u FROM base),
k AS (SELECT *, CASE WHEN stratum = 'boundary' THEN {bkey} ELSE u END AS key FROM s),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE stratum = 'high') AS nh,
             count(*) FILTER (WHERE stratum = 'boundary') AS nb,
             count(*) FILTER (WHERE stratum = 'low') AS nl FROM k),
t AS (SELECT CAST(greatest(1, floor(n * CAST({rate!r} AS DOUBLE))) AS BIGINT) AS t, nh, nb, nl FROM c),
q AS (SELECT least(t, nh) AS qh, least(t - least(t, nh), nb) AS qb,
             least(t - least(t, nh) - least(t - least(t, nh), nb), nl) AS ql FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY key, id) AS rn FROM k),
drawn AS (SELECT r.*, CAST(CASE WHEN (stratum = 'high' AND rn <= qh) OR (stratum = 'boundary' AND rn <= qb)
                                  OR (stratum = 'low' AND rn <= ql) THEN 1 ELSE 0 END AS TINYINT) AS "show"
          FROM r, q)
"""


SAMPLE_CASES = {
    # name: (rate, high, boundary)
    "adaptive_sample_events": (0.1, 0.85, 0.6),   # high all, weighted boundary draw
    "sample_high_only": (0.1, 0.5, 0.3),          # R3: the high stratum alone exceeds the quota
    "sample_no_boundary": (0.1, 0.85, 0.85),      # R6: empty boundary, uniform fill from the rest
    "sample_underfull": (0.2, 0.85, 0.8),         # R5: boundary too small, low fills the rest
}


def _make_sample_query(rate, high, boundary):
    def q(spark, sf):
        drawn = sampling.adaptive_sample(_events_scored(spark, sf), rate, high, boundary, seed=42)
        return drawn.select("id", F.round("score", 6).alias("score"), "show")
    return q


for _name, (_rate, _high, _boundary) in SAMPLE_CASES.items():
    register(_name, sample_sql(EVENTS_SCORED_SQL, _rate, _high, _boundary)
             + 'SELECT id, round(score, 6) AS score, "show" FROM drawn')(_make_sample_query(_rate, _high, _boundary))


def _main_draw(spark, sf):
    rate, high, boundary = SAMPLE_CASES["adaptive_sample_events"]
    return sampling.adaptive_sample(_events_scored(spark, sf), rate, high, boundary, seed=42)


_MAIN_DRAW_SQL = sample_sql(EVENTS_SCORED_SQL, *SAMPLE_CASES["adaptive_sample_events"])


@register("score_bands", _MAIN_DRAW_SQL + """
, b AS (SELECT *, CASE WHEN score >= 0.0 AND score < 0.3 THEN '0.0-0.3'
                        WHEN score >= 0.3 AND score < 0.5 THEN '0.3-0.5'
                        WHEN score >= 0.5 AND score < 0.7 THEN '0.5-0.7'
                        WHEN score >= 0.7 AND score < 0.9 THEN '0.7-0.9'
                        WHEN score >= 0.9 AND score < 1.0 THEN '0.9-1.0' END AS band FROM drawn)
SELECT band, CAST(sum("show") AS BIGINT) AS shown, count(*) AS total, round(sum("show") * 100.0 / count(*), 6) AS pct
FROM b WHERE band IS NOT NULL GROUP BY band
""")
def q_score_bands(spark, sf):
    out = scoring.score_bands(_main_draw(spark, sf))
    return out.select("band", "shown", "total", F.round("pct", 6).alias("pct"))


@register("score_summary", "WITH base AS (" + EVENTS_SCORED_SQL + """)
SELECT round(min(score), 9) AS min_score, round(max(score), 9) AS max_score, round(avg(score), 9) AS mean_score FROM base
""")
def q_score_summary(spark, sf):
    s = scoring.score_summary(_events_scored(spark, sf))
    return s.select(*[F.round(c, 9).alias(c) for c in ("min_score", "max_score", "mean_score")])


@register("shown_rate", _MAIN_DRAW_SQL + """
SELECT CAST(sum("show") AS BIGINT) AS shown, count(*) AS total, round(sum("show") * 100.0 / count(*), 6) AS pct FROM drawn
""")
def q_shown_rate(spark, sf):
    s = scoring.shown_rate(_main_draw(spark, sf))
    return s.select("shown", "total", F.round("pct", 6).alias("pct"))


@register("force_include", _cte(op=ORDERS_AS_PAPERS_SQL) + 'SELECT id, CAST(1 AS TINYINT) AS "show" FROM op')
def q_force_include(spark, sf):
    return sampling.force_include(_orders_as_papers(spark, sf)).select("id", "show")


# Fixed scorer weights: w_i = ((i mod 7) - 3) / 10 for i = 0..63, bias 0.1.
FIXED_WEIGHTS = [((i % 7) - 3) / 10.0 for i in range(64)]
FIXED_BIAS = 0.1


@register("score_fixed_weights", f"""
SELECT vec_id, label,
       round(1.0 / (1.0 + exp(-(list_dot_product(CAST(embedding AS DOUBLE[]),
             CAST({FIXED_WEIGHTS!r} AS DOUBLE[])) + {FIXED_BIAS!r}))), 6) AS score
FROM embeddings
""")
def q_score_fixed(spark, sf):
    emb = td.table(spark, sf, "embeddings")
    s = scoring.linear_score(emb, "embedding", FIXED_WEIGHTS, FIXED_BIAS)
    return s.select("vec_id", "label", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- cache

CACHE_LANG = "en"
CACHE_MODELS = ("click", "view*")  # regex alternatives: "view*" is "vie" + any w's


def _latest_cached(spark, sf):
    from papersift.operators import cache as cache_ops

    return cache_ops.latest_cached(td.cache(spark, sf), td.wanted(spark, sf), CACHE_LANG, CACHE_MODELS,
                                   tie_cols=("event_id",))


LATEST_CACHED_SQL = _cte(cache=td.CACHE_SQL, wanted=td.WANTED_SQL) + """
, ok AS (SELECT * FROM cache WHERE lang = 'en' AND regexp_matches(model, '^(click|view*)')
         AND id IN (SELECT id FROM wanted)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY summary_time DESC, event_id DESC) AS rn FROM ok),
latest AS (SELECT id, model, lang, summary_time, event_id, value, one_sentence_summary,
                  'unknown' AS preference FROM ranked WHERE rn = 1)
"""


@register("cache_latest", LATEST_CACHED_SQL + """
SELECT id, model, summary_time, event_id, one_sentence_summary, preference FROM latest
""")
def q_cache_latest(spark, sf):
    return _latest_cached(spark, sf).select("id", "model", "summary_time", "event_id", "one_sentence_summary",
                                            "preference")


@register("cache_misses", LATEST_CACHED_SQL + """
SELECT w.id, w.title FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.id = w.id)
""")
def q_cache_misses(spark, sf):
    from papersift.operators import cache as cache_ops

    return cache_ops.misses(td.wanted(spark, sf), _latest_cached(spark, sf)).select("id", "title")


RUN_TIME = "2025-06-01T00:00:00+00:00"


def _fresh_and_cached(spark, sf):
    from papersift.operators import cache as cache_ops

    cached = _latest_cached(spark, sf).select("id", "model", "summary_time", "one_sentence_summary", "preference")
    todo = cache_ops.misses(td.wanted(spark, sf), cached)
    fresh = todo.select(
        "id",
        F.lit("local-digest").alias("model"),
        F.lit(RUN_TIME).alias("summary_time"),
        F.concat(F.lit("digest of "), F.col("title")).alias("one_sentence_summary"),
        F.lit("unknown").alias("preference"),
        F.col("title"),
    )
    return cache_ops.combine(fresh, cached)


FRESH_AND_CACHED_SQL = LATEST_CACHED_SQL + f"""
, fresh AS (SELECT w.id, 'local-digest' AS model, '{RUN_TIME}' AS summary_time,
                   'digest of ' || w.title AS one_sentence_summary, 'unknown' AS preference, w.title
            FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.id = w.id)),
combined AS (SELECT * FROM fresh
             UNION ALL
             SELECT id, model, summary_time, one_sentence_summary, preference, NULL AS title FROM latest)
"""


@register("cache_union", FRESH_AND_CACHED_SQL + """
SELECT id, model, summary_time, one_sentence_summary, preference, title FROM combined
""")
def q_cache_union(spark, sf):
    return _fresh_and_cached(spark, sf).select("id", "model", "summary_time", "one_sentence_summary",
                                               "preference", "title")


@register("metadata_merge", FRESH_AND_CACHED_SQL + """
, meta AS (SELECT id, title, score, segment FROM wanted WHERE segment IN ('BUILDING', 'MACHINERY'))
SELECT c.id, c.model, c.summary_time, c.one_sentence_summary, c.preference,
       CASE WHEN m.id IS NOT NULL THEN m.title ELSE c.title END AS title,
       m.score, m.segment
FROM combined c LEFT JOIN meta m ON c.id = m.id
""")
def q_metadata_merge(spark, sf):
    from papersift.operators import cache as cache_ops

    meta = td.wanted(spark, sf).where(F.col("segment").isin("BUILDING", "MACHINERY"))
    merged = cache_ops.merge_metadata(_fresh_and_cached(spark, sf), meta)
    return merged.select("id", "model", "summary_time", "one_sentence_summary", "preference", "title",
                         "score", "segment")


# ---------------------------------------------------------------- keywords

def _part_keywords(spark, sf):
    part = td.table(spark, sf, "part")
    words = F.split("p_name", " ")
    return part.select(F.col("p_partkey").cast("string").alias("id"),
                       F.array(words[0], words[1], F.col("p_type")).alias("keywords"))


def _part_keyword_map(spark, sf):
    """Map derived from the part table: a noun maps to [NOUN, hardware]; a type maps
    to its lower-case name, except PROMO and SMALL, which map to [] (kept as is)."""
    part = td.table(spark, sf, "part")
    noun = F.split("p_name", " ")[1]
    nouns = part.select(noun.alias("key"), F.array(F.upper(noun), F.lit("hardware")).alias("values"))
    types = part.select(
        F.col("p_type").alias("key"),
        F.when(F.col("p_type").isin("PROMO", "SMALL"), F.array().cast("array<string>"))
        .otherwise(F.array(F.lower("p_type"))).alias("values"))
    return nouns.unionByName(types).distinct()


KEYWORDS_SQL = """
WITH kw AS (SELECT CAST(p_partkey AS VARCHAR) AS id,
                   unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_type]) AS k FROM part),
m AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS key, [upper(split_part(p_name, ' ', 2)), 'hardware'] AS vals FROM part
      UNION
      SELECT DISTINCT p_type, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN []::VARCHAR[] ELSE [lower(p_type)] END FROM part),
x AS (SELECT kw.id, unnest(CASE WHEN len(m.vals) > 0 THEN m.vals ELSE [kw.k] END) AS v
      FROM kw LEFT JOIN m ON kw.k = m.key)
"""


@register("keyword_rewrite", KEYWORDS_SQL + """
SELECT id, string_agg(DISTINCT v, '|' ORDER BY v) AS keywords FROM x GROUP BY id
""")
def q_keyword_rewrite(spark, sf):
    from papersift.operators import keywords as kw

    out = kw.rewrite_with_table(_part_keywords(spark, sf), kw.mapping_table(_part_keyword_map(spark, sf)))
    return out.select("id", F.array_join("keywords", "|").alias("keywords"))


@register("keyword_counts", KEYWORDS_SQL + """
, per_row AS (SELECT DISTINCT id, v FROM x)
SELECT v AS keyword, count(*) AS n FROM per_row GROUP BY v
""")
def q_keyword_counts(spark, sf):
    from papersift.operators import keywords as kw

    out = kw.rewrite_with_table(_part_keywords(spark, sf), kw.mapping_table(_part_keyword_map(spark, sf)))
    return kw.keyword_counts(out)


# ---------------------------------------------------------------- archive

def _archive_batch(spark, sf, version: int) -> DataFrame:
    """Archive rows from orders.  Version 1 covers every order; version 2 re-digests
    the finished ('F') orders.  Pending ('P') orders carry no content (null or
    blank fields), so the meaningful-row filter drops them."""
    o = td.table(spark, sf, "orders")
    pending = F.col("o_orderstatus") == "P"
    rows = o.select(
        td.archive_id().alias("id"),
        F.when(pending, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("title"),
        F.when(pending, F.lit("   ")).otherwise(
            F.concat(F.lit(f"v{version} total "), F.col("o_totalprice").cast("string"))).alias("summary"),
        F.when(pending, F.lit(None).cast("double")).otherwise(F.col("o_totalprice")).alias("score"),
        F.when(pending, F.lit(None)).otherwise(F.lit(version)).alias("version"),
    )
    if version == 2:
        rows = rows.join(o.where(F.col("o_orderstatus") == "F").select(td.archive_id().alias("id")), "id", "left_semi")
    return rows


ARCHIVE_BATCH_SQL = f"""
SELECT {td.ARCHIVE_ID_SQL} AS id,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS title,
       CASE WHEN o_orderstatus = 'P' THEN '   ' ELSE 'v' || CAST(__V__ AS VARCHAR) || ' total ' || CAST(o_totalprice AS VARCHAR) END AS summary,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS score,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE __V__ END AS version, o_orderstatus
FROM orders
"""


@register("archive_rows", _cte(
    b1=ARCHIVE_BATCH_SQL.replace("__V__", "1"),
    b2=ARCHIVE_BATCH_SQL.replace("__V__", "2") + " WHERE o_orderstatus = 'F'",
) + """
, batch AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2),
ok AS (SELECT * FROM batch WHERE coalesce(regexp_matches(title, '\\S'), false)
        OR coalesce(regexp_matches(summary, '\\S'), false) OR score IS NOT NULL OR version IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS rn FROM ok)
SELECT id, substr(id, 1, 4) AS month, title, summary, version FROM ranked WHERE rn = 1
""")
def q_archive_rows(spark, sf):
    from papersift.operators.archive import archive_rows

    batch = _archive_batch(spark, sf, 1).unionByName(_archive_batch(spark, sf, 2))
    return archive_rows(batch, order_by=["version"]).select("id", "month", "title", "summary", "version")


@register("archive_upsert", _cte(
    b1=ARCHIVE_BATCH_SQL.replace("__V__", "1"),
    b2=ARCHIVE_BATCH_SQL.replace("__V__", "2") + " WHERE o_orderstatus = 'F'",
) + """
, old AS (SELECT * FROM b1 WHERE o_orderstatus <> 'P'),
merged AS (SELECT id, title, summary, score, version FROM b2
           UNION ALL
           SELECT id, title, summary, score, version FROM old WHERE id NOT IN (SELECT id FROM b2))
SELECT id, substr(id, 1, 4) AS month, title, summary, round(score, 2) AS score, version FROM merged
""")
def q_archive_upsert(spark, sf):
    """Write version 1, upsert version 2, read the archive back (scratch folder
    under spark.checkpoint.dir)."""
    from papersift.session import ensure_checkpoint_dir, scratch_path
    from papersift.sinks.archive import upsert
    from papersift.sources.archive import read_archive
    from pyspark.sql import types as T

    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, "archive")
    schema = T.StructType([
        T.StructField("id", T.StringType()), T.StructField("title", T.StringType()),
        T.StructField("summary", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("version", T.IntegerType()),
    ])
    upsert(_archive_batch(spark, sf, 1), path, order_by=["version"], schema=schema)
    upsert(_archive_batch(spark, sf, 2), path, order_by=["version"], schema=schema)
    back = read_archive(spark, path, schema)
    return back.select("id", "month", "title", "summary", F.round("score", 2).alias("score"), "version")


# ---------------------------------------------------------------- ratings from links

# Rules over the pages table, in priority order: the page query parameter, the
# number in the URL path, then the tracking call in the page.
PAGE_ID_RULES = [
    ("url", r"[?&]page=(\d+)"),
    ("url", r"example\.[a-z]+/[a-z]{2}/(\d+)"),
    ("html", r"track\((\d+)\)"),
]


@register("extract_ids", """
WITH x AS (SELECT coalesce(nullif(regexp_extract(url, '[?&]page=(\\d+)', 1), ''),
                           nullif(regexp_extract(url, 'example\\.[a-z]+/[a-z]{2}/(\\d+)', 1), ''),
                           nullif(regexp_extract(html, 'track\\((\\d+)\\)', 1), '')) AS id FROM pages)
SELECT DISTINCT id, 'like' AS preference FROM x WHERE id IS NOT NULL
""")
def q_extract_ids(spark, sf):
    from papersift.operators import ratings

    ids = ratings.extract_ids(td.table(spark, sf, "pages"), PAGE_ID_RULES)
    return ratings.ratings_from_ids(ids, "like")


# ---------------------------------------------------------------- enrichment

FIRST_SENTENCE = r"^[ \t\r\n]*([^\n]*?[.!?])(?:[ \t\r\n]|$)"


def first_sentence_digest(row: dict) -> dict:
    """The per-paper function of the test: the first sentence, or an error."""
    import re

    m = re.match(FIRST_SENTENCE, row.get("abstract") or "")
    if not m:
        raise ValueError("no complete sentence")
    return {"one_sentence_summary": m.group(1)}


def _documents_as_papers(spark, sf):
    d = td.table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("abstract"), "lang")


def _document_cache(spark, sf):
    """Earlier digests: documents rated high quality were digested before."""
    d = td.table(spark, sf, "documents")
    lab = td.table(spark, sf, "labels").where(F.col("quality") == 1).select("doc_id")
    return d.join(lab, "doc_id", "left_semi").select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit("cached digest of "), F.col("doc_id").cast("string"), F.lit(" ("),
                 F.col("n_chars").cast("string"), F.lit(" chars)")).alias("one_sentence_summary"),
        F.lit("cache-model").alias("model"),
    )


@register("enrich_first_sentence", f"""
WITH cached AS (SELECT CAST(d.doc_id AS VARCHAR) AS id,
                       'cached digest of ' || CAST(d.doc_id AS VARCHAR) || ' (' || CAST(d.n_chars AS VARCHAR) || ' chars)' AS one_sentence_summary,
                       'cache-model' AS model
                FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
fresh AS (SELECT CAST(doc_id AS VARCHAR) AS id,
                 regexp_extract(text, '{FIRST_SENTENCE}', 1) AS one_sentence_summary, 'local-digest' AS model
          FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT id FROM cached))
SELECT id, one_sentence_summary, model FROM fresh WHERE one_sentence_summary <> ''
UNION ALL SELECT id, one_sentence_summary, model FROM cached
""")
def q_enrich_first_sentence(spark, sf):
    from papersift.operators import enrich as en
    from pyspark.sql import types as T

    fields = T.StructType([T.StructField("one_sentence_summary", T.StringType())])
    results, _failed = en.enrich(
        _documents_as_papers(spark, sf), _document_cache(spark, sf), first_sentence_digest, fields,
        provenance={"model": "local-digest", "temperature": 0.1, "top_p": 0.8, "lang": "en"},
        run_time=RUN_TIME,
    )
    return results.select("id", "one_sentence_summary", "model")


# ---------------------------------------------------------------- rendering

def _render(builder, **opts):
    def q(spark, sf):
        from papersift.operators.render import render
        from papersift.session import ensure_checkpoint_dir

        ensure_checkpoint_dir(spark)
        return render(builder(spark, sf), **opts).select("doc_id", "markdown")
    return q


def _register_renders():
    from papersift.plans import token_docs as tk

    register("render_blocks", tk.CONVERSATION_BLOCKS_MD_SQL)(_render(tk.conversation_blocks))
    register("render_footnotes", tk.CONVERSATION_FOOTNOTES_MD_SQL)(_render(tk.conversation_footnotes))
    register("render_titles", tk.DOCUMENT_TITLES_MD_SQL)(_render(tk.document_titles))
    register("render_tables", tk.PART_TABLES_MD_SQL)(_render(tk.part_tables))
    register("clean_equations", tk.DOCUMENT_EQUATIONS_MD_SQL)(_render(tk.document_equations, clean_equations=True))
    register("render_authors", tk.CUSTOMER_AUTHORS_MD_SQL)(_render(tk.customer_authors))

    @register("flatten_tokens", tk.CONVERSATION_FLAT_SQL)
    def q_flatten(spark, sf):
        """B0 block table, with this engine's paths."""
        from papersift.operators.render import flatten
        from papersift.session import ensure_checkpoint_dir

        ensure_checkpoint_dir(spark)
        blocks = flatten(tk.conversation_blocks(spark, sf))
        return blocks.select("doc_id", "path", "depth", "kind", "live")


_register_renders()


# ---------------------------------------------------------------- composed runs (§3.1, §3.2)

@register("recommend")
def q_recommend(spark, sf):
    """§3.1 daily recommendation (fit inside, so rows only; pytest checks the parts)."""
    from papersift.plans import flagship

    return flagship.recommend_on_testdata(spark, sf)


@register("digest_named", _cte(papers=td.PAPERS_SQL) + """
SELECT id, updated, 1 AS show FROM papers
WHERE categories[1] = 'de' AND emb_a IS NOT NULL AND emb_b IS NOT NULL
""")
def q_digest_named(spark, sf):
    """§3.2: the named papers (here: every German document, as a table of ids)
    are scored and all shown; the scores come from the fit (see fit_gradient)."""
    from papersift.plans import flagship
    from papersift.plans.recommend import digest_named

    named = td.table(spark, sf, "documents").where(F.col("lang") == "de").select(
        F.col("doc_id").cast("string").alias("id"))
    out = digest_named(td.papers(spark, sf), td.preferences(spark, sf), named, flagship.FLAGSHIP_SETTINGS)
    return out.where(F.col("score").between(0, 1)).select("id", "updated", F.col("show").cast("int").alias("show"))


# ---------------------------------------------------------------- more aggregates and rewrites (A5, W1 literal map)

@register("stratum_counts", "WITH base AS (" + EVENTS_SCORED_SQL + """)
SELECT count(*) AS n,
       count(*) FILTER (WHERE score >= 0.85) AS n_high,
       count(*) FILTER (WHERE score >= 0.6 AND score < 0.85) AS n_boundary,
       count(*) FILTER (WHERE NOT (score >= 0.6)) AS n_low
FROM base
""")
def q_stratum_counts(spark, sf):
    """A5, the counts that the draw takes before its cutoffs."""
    c = sampling.stratum_counts(_events_scored(spark, sf), "score", 0.85, 0.6)
    row = (c["n"], c[sampling.HIGH], c[sampling.BOUNDARY], c[sampling.LOW])
    return spark.createDataFrame([row], "n long, n_high long, n_boundary long, n_low long")


# Fixed mapping of part types (a caller-held map, applied as a literal map):
# ECONOMY -> economy, STANDARD -> standard, MEDIUM -> medium, LARGE -> large,
# PROMO -> [] and SMALL -> [] (empty: the keyword is kept).
TYPE_MAP = {"ECONOMY": ["economy"], "STANDARD": ["standard"], "MEDIUM": ["medium"], "LARGE": ["large"],
            "PROMO": [], "SMALL": []}


@register("keyword_rewrite_map", """
WITH kw AS (SELECT CAST(p_partkey AS VARCHAR) AS id,
                   unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_type]) AS k FROM part),
m AS (SELECT * FROM (VALUES ('ECONOMY', ['economy']), ('STANDARD', ['standard']), ('MEDIUM', ['medium']),
                            ('LARGE', ['large']), ('PROMO', []::VARCHAR[]), ('SMALL', []::VARCHAR[])) AS t(key, vals)),
x AS (SELECT kw.id, unnest(CASE WHEN len(m.vals) > 0 THEN m.vals ELSE [kw.k] END) AS v
      FROM kw LEFT JOIN m ON kw.k = m.key)
SELECT id, string_agg(DISTINCT v, '|' ORDER BY v) AS keywords FROM x GROUP BY id
""")
def q_keyword_rewrite_map(spark, sf):
    from papersift.operators import keywords as kw

    out = kw.rewrite_with_dict(_part_keywords(spark, sf), TYPE_MAP)
    return out.select("id", F.array_join("keywords", "|").alias("keywords"))
