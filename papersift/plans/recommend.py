"""Daily recommendation (§3.1) and digest of named papers (§3.2), composed lazily.

Actions: the thin corpus index, the positive count, the draw cutoff and the
model fit (training), the scored window and the stratum counts and cutoffs
(quota draw).  The result stays a lazy plan that the caller writes with a sink.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papersift.operators import corpus, sampling, scoring, training
from papersift.session import materialize
from papersift.settings import Settings
from papersift.sources import positions


def corpus_index(papers: DataFrame, settings: Settings) -> DataFrame:
    """One scan of the corpus: ``(id, updated)`` of the papers that pass the
    category and embedding filters, written once as a thin table.  The split, the
    negative draw and the date window then run on ids, not on embeddings.  Row positions, if
    ``papers`` has them (``positions.with_positions``), are kept."""
    cols = list(settings.embedding_columns)
    base = corpus.with_all_embeddings(corpus.category_any(papers, settings.categories), cols)
    places = [positions.FILE, positions.ROW] if positions.has_positions(papers) else []
    thin = base.where(F.col("id").isNotNull()).select("id", "updated", *places)
    return materialize(thin, "corpus-index", columnar=True, key="id")


def prepare(index: DataFrame, preferences: DataFrame, settings: Settings,
            digested_ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The split on the thin index: (rated ids with preference, unrated ids with updated)."""
    rated, unrated = corpus.split_rated(index, preferences)
    if corpus.needs_year_cutoff(settings.background_start_year, settings.preference_start_year):
        unrated = corpus.year_cutoff(unrated, settings.background_start_year)
    if digested_ids is not None:
        unrated = corpus.remove_digested(unrated, digested_ids)
    return rated, unrated


def fit(papers: DataFrame, preferences: DataFrame, settings: Settings,
        digested_ids: DataFrame | None = None):
    """Training: (model, unrated ids).  Embeddings are read once, for the chosen rows: by position, only
    from the files that hold one, where ``papers`` has positions, else by a keyed join."""
    cols = list(settings.embedding_columns)
    index = corpus_index(papers, settings)
    rated, unrated = prepare(index, preferences, settings, digested_ids)
    keys = training.training_keys(rated, unrated, settings.bg_sample_rate, settings.seed)
    if positions.has_positions(papers):
        chosen = keys.join(index.select("id", positions.FILE, positions.ROW), "id")
        rows = positions.fetch(chosen, T.StructType([papers.schema[c] for c in cols]))
    else:
        rows = papers.join(keys, "id", "inner").select("id", "label", "origin", *cols)
    model = training.fit_logistic(rows, cols, settings.C, settings.max_iter)
    return model, unrated


def recommend(
    papers: DataFrame,
    preferences: DataFrame,
    settings: Settings,
    digested_ids: DataFrame | None = None,
    today: _dt.date | str | None = None,
    apply_window: bool = True,
) -> DataFrame:
    """Rated + pseudo-negatives -> balanced logistic regression -> score -> quota draw.

    Returns the shown rows without embedding columns (``show = 1``).  The corpus
    is read three times: the thin index, the training rows, and the target window
    (whose date predicate reaches the scan).
    """
    cols = list(settings.embedding_columns)
    model, unrated = fit(papers, preferences, settings, digested_ids)
    target_ids = unrated
    target = papers
    if apply_window:
        target_ids = corpus.date_window(unrated, settings.start_date, settings.end_date, settings.last_n_days, today)
        target = corpus.date_window(papers, settings.start_date, settings.end_date, settings.last_n_days, today)
    if "year" in target_ids.columns:  # P5 ran: the result keeps its year column
        target = target.drop("year").join(target_ids.select("id", "year"), "id", "inner")
    else:
        target = target.join(target_ids.select("id"), "id", "left_semi")
    # The draw reads the scored window several times (counts, cutoffs, result):
    # score it once and keep it under spark.checkpoint.dir.
    scored = materialize(scoring.score(model, target, cols), "scored")
    shown = sampling.adaptive_sample(
        scored, settings.sample_rate, settings.high_threshold, settings.boundary_threshold, settings.seed
    )
    return scoring.recommended(scoring.drop_embeddings(shown, [*cols, positions.FILE, positions.ROW]))


def digest_named(papers: DataFrame, preferences: DataFrame, ids: list[str] | DataFrame,
                 settings: Settings, digested_ids: DataFrame | None = None) -> DataFrame:
    """§3.2: named papers are scored and all shown (no window, no draw).  Digested papers are
    no pseudo-negatives, as in the daily run."""
    cols = list(settings.embedding_columns)
    model, _ = fit(papers, preferences, settings, digested_ids)
    target = corpus.with_all_embeddings(corpus.id_list_filter(papers, ids), cols)
    scored = scoring.score(model, target, cols)
    return scoring.drop_embeddings(sampling.force_include(scored), [*cols, positions.FILE, positions.ROW])
