"""Explicit schemas of the tables in SURVEY §1.1 (never inferred on the hot path)."""

from pyspark.sql import types as T

S, D = T.StringType(), T.DoubleType()
ARR_S = T.ArrayType(T.StringType())

PREFERENCES = T.StructType([T.StructField("id", S), T.StructField("preference", S)])

KEYWORD_MAP = T.StructType([T.StructField("key", S), T.StructField("values", ARR_S)])

# Archive row; every field nullable except id (enforced by the archive writer).
ARCHIVE = T.StructType([
    T.StructField("id", S),
    T.StructField("title", S), T.StructField("abstract", S),
    T.StructField("authors", ARR_S), T.StructField("categories", ARR_S),
    T.StructField("created", S), T.StructField("updated", S), T.StructField("date", S),
    T.StructField("license", S),
    T.StructField("score", D), T.StructField("show", T.ByteType()), T.StructField("year", T.IntegerType()),
    T.StructField("preference", S),
    T.StructField("institution", ARR_S),
    T.StructField("reasoning_step", S), T.StructField("problem_background", S),
    T.StructField("method", S), T.StructField("experiment", S),
    T.StructField("one_sentence_summary", S), T.StructField("slug", S),
    T.StructField("keywords", ARR_S), T.StructField("further_thoughts", S),
    T.StructField("model", S), T.StructField("temperature", D), T.StructField("top_p", D),
    T.StructField("lang", S), T.StructField("summary_time", S), T.StructField("source_file", S),
])

EMPTY_ARCHIVE = T.StructType([T.StructField("id", S), T.StructField("summary", S)])
