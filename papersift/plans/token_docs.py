"""Token-tree documents built by Spark from the driver's tables, for the renderer.

Each builder writes JSON with ``to_json`` / ``concat`` per row; only the
conversation builders group (one conversation = one document, bounded by the
conversation's own size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papersift.plans import testdata as td
from papersift.session import spread


def _text_token(content: Column, styles: list[str] | None = None) -> Column:
    fields = [F.lit("text").alias("type"), content.alias("content")]
    if styles:
        fields.append(F.array(*[F.lit(s) for s in styles]).alias("styles"))
    return F.struct(*fields)


def _doc(tokens_json: Column) -> Column:
    return F.concat(F.lit('{"tokens":['), tokens_json, F.lit("]}"))


def _per_conversation(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, tok) -> (doc_id, json) with tokens in turn order."""
    return turns.groupBy(F.col("conv_id").alias("doc_id")).agg(
        _doc(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "tok"))),
                                      lambda x: x["tok"]), ",")).alias("json"))


def conversation_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """system -> section titled 'system' holding a paragraph; user -> bold paragraph;
    assistant -> bullet list, one item per line."""
    c = td.table(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    para = F.struct(F.lit("paragraph").alias("type"), F.array(_text_token(F.col("text"))).alias("content"))
    section = F.to_json(F.struct(
        F.lit("section").alias("type"), F.lit(1).alias("level"),
        F.array(_text_token(F.lit("system"))).alias("title"), F.array(para).alias("content")))
    user = F.to_json(F.struct(F.lit("paragraph").alias("type"),
                              F.array(_text_token(F.col("text"), ["bold"])).alias("content")))
    items = F.transform(F.split("text", "\n"), lambda line: F.struct(F.array(_text_token(line)).alias("content")))
    assistant = F.to_json(F.struct(F.lit("list").alias("type"), F.lit("itemize").alias("name"),
                                   F.lit(0).alias("depth"), items.alias("content")))
    tok = F.when(F.col("role") == "system", section).when(F.col("role") == "user", user).otherwise(assistant)
    return _per_conversation(c.select("conv_id", "turn", tok.alias("tok")))


CONVERSATION_BLOCKS_MD_SQL = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
md AS (SELECT conv_id, turn,
         CASE WHEN role = 'system' THEN '## system' || chr(10)
                   || CASE WHEN text <> '' THEN text || chr(10) || chr(10) ELSE '' END || chr(10)
              WHEN role = 'user' THEN '<b>' || text || '</b>' || chr(10) || chr(10)
              ELSE array_to_string(list_transform(string_split(text, chr(10)), lambda x: '- ' || x), chr(10)) || chr(10)
         END AS md FROM t)
SELECT conv_id AS doc_id, string_agg(md, '' ORDER BY turn) AS markdown FROM md GROUP BY conv_id
"""


def conversation_footnotes(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn is a paragraph: its text and a footnote 'turn N by ROLE'; an
    assistant's footnote holds a nested footnote 'nested N'."""
    c = td.table(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    label = F.concat(F.lit("turn "), F.col("turn").cast("string"), F.lit(" by "), F.col("role"))
    inner = F.to_json(F.struct(F.lit("footnote").alias("type"), F.array(_text_token(
        F.concat(F.lit("nested "), F.col("turn").cast("string")))).alias("content")))
    outer_plain = F.to_json(F.struct(F.lit("footnote").alias("type"), F.array(_text_token(label)).alias("content")))
    outer_nested = F.concat(F.lit('{"type":"footnote","content":['), F.to_json(_text_token(label)), F.lit(","),
                            inner, F.lit("]}"))
    outer = F.when(F.col("role") == "assistant", outer_nested).otherwise(outer_plain)
    tok = F.concat(F.lit('{"type":"paragraph","content":['), F.to_json(_text_token(F.col("text"))), F.lit(","),
                   outer, F.lit("]}"))
    return _per_conversation(c.select("conv_id", "turn", tok.alias("tok")))


CONVERSATION_FOOTNOTES_MD_SQL = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text,
                  CASE WHEN role = 'assistant' THEN 2 ELSE 1 END AS cnt FROM conversations),
n AS (SELECT *, 1 + coalesce(sum(cnt) OVER (PARTITION BY conv_id ORDER BY turn
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fn FROM t),
body AS (SELECT conv_id, string_agg(text || '[^' || fn || ']' || chr(10) || chr(10), '' ORDER BY turn) AS body
         FROM n GROUP BY conv_id),
entries AS (
  SELECT conv_id, turn, 0 AS sub, '[^' || (fn + 1) || ']: nested ' || turn AS e FROM n WHERE role = 'assistant'
  UNION ALL
  SELECT conv_id, turn, 1 AS sub, '[^' || fn || ']: turn ' || turn || ' by ' || role
         || CASE WHEN role = 'assistant' THEN '[^' || (fn + 1) || ']' ELSE '' END FROM n),
notes AS (SELECT conv_id, string_agg(e, chr(10) ORDER BY turn, sub) AS notes FROM entries GROUP BY conv_id)
SELECT b.conv_id AS doc_id, b.body || chr(10) || chr(10) || n.notes AS markdown
FROM body b JOIN notes n ON b.conv_id = n.conv_id
"""


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def document_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of a document becomes a title token (repeated lines repeat titles)."""
    d = td.table(spark, sf, "documents")
    toks = F.transform(_lines(F.col("text")), lambda line: F.to_json(F.struct(
        F.lit("title").alias("type"), F.array(_text_token(line)).alias("content"))))
    return d.select("doc_id", _doc(F.array_join(toks, ",")).alias("json"))


DOCUMENT_TITLES_MD_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS rn FROM l)
SELECT d.doc_id, coalesce(string_agg('# ' || f.line || chr(10), '' ORDER BY f.pos), '') AS markdown
FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id AND f.rn = 1 GROUP BY d.doc_id
"""


def document_equations(spark: SparkSession, sf: str) -> DataFrame:
    """Every line holding a dollar sign becomes an equation (block if it holds $$)."""
    d = td.table(spark, sf, "documents")
    eq_lines = F.filter(_lines(F.col("text")), lambda line: line.contains("$"))
    toks = F.transform(eq_lines, lambda line: F.to_json(F.struct(
        F.lit("equation").alias("type"), line.alias("content"),
        F.when(line.contains("$$"), F.lit("block")).otherwise(F.lit("inline")).alias("display"))))
    return d.select("doc_id", _doc(F.array_join(toks, ",")).alias("json"))


DOCUMENT_EQUATIONS_MD_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
e AS (SELECT doc_id, pos, contains(line, '$$') AS block,
             regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'),
               '\\[a-zA-Z]+\[.*?]\{.*?\}\{.*?\}', '', 'g'), '\$\$', '', 'g'), '\$', '', 'g') AS c
      FROM l WHERE contains(line, '$')),
m AS (SELECT doc_id, pos, CASE WHEN block THEN '$$ ' || c || ' $$' || chr(10) ELSE '$' || c || '$' END AS md FROM e)
SELECT d.doc_id, coalesce(string_agg(m.md, '' ORDER BY m.pos), '') AS markdown
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id
"""


def _json_str(c: Column) -> Column:
    """A JSON string literal (quoted and escaped) for a text column."""
    return F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1)


def part_tables(spark: SparkSession, sf: str) -> DataFrame:
    """One table per part, captioned with its brand: a header row and a data row.
    Parts of size 5 or less get only the header row (a one-row table vanishes);
    parts of size 46 or more get a row-spanning header cell (kept as JSON)."""
    p = spread(td.table(spark, sf, "part"), "p_partkey")
    name_cell = F.when(F.col("p_size") >= 46,
                       F.lit('{"content":[{"type":"text","content":"name"}],"rowspan":2}')).otherwise(F.lit('"name"'))
    header = F.concat(F.lit("["), name_cell, F.lit(',"type","size"]'))
    data = F.to_json(F.array(F.col("p_name"), F.col("p_type"), F.col("p_size").cast("string")))
    rows = F.when(F.col("p_size") <= 5, F.concat(F.lit("["), header, F.lit("]"))) \
        .otherwise(F.concat(F.lit("["), header, F.lit(","), data, F.lit("]")))
    table = F.concat(
        F.lit('{"type":"table","numbering":"'), F.col("p_partkey").cast("string"), F.lit('","content":[{"tabular":'),
        rows, F.lit('},{"type":"caption","content":'), _json_str(F.col("p_brand")), F.lit("}]}"))
    return p.select(F.col("p_partkey").alias("doc_id"), _doc(table).alias("json"))


PART_TABLES_MD_SQL = r"""
WITH p AS (SELECT p_partkey, p_name, p_type, p_size, p_brand,
  '{"type":"table","numbering":"' || p_partkey || '","content":[{"tabular":['
  || '[' || CASE WHEN p_size >= 46 THEN '{"content":[{"type":"text","content":"name"}],"rowspan":2}' ELSE '"name"' END
  || ',"type","size"]'
  || CASE WHEN p_size <= 5 THEN '' ELSE ',["' || p_name || '","' || p_type || '","' || p_size || '"]' END
  || ']},{"type":"caption","content":"' || p_brand || '"}]}' AS node FROM part)
SELECT p_partkey AS doc_id,
  CASE WHEN p_size >= 46 THEN '[Table ' || p_partkey || ']: ' || p_brand || chr(10)
            || 'Following table is represented in JSON:' || chr(10) || '```json' || chr(10) || node || chr(10) || '```' || chr(10)
       WHEN p_size <= 5 THEN ''
       ELSE '[Table ' || p_partkey || ']: ' || p_brand || chr(10) || '| name | type | size |' || chr(10)
            || '|---|---|---|' || chr(10) || '| ' || p_name || ' | ' || p_type || ' | ' || p_size || ' |' || chr(10)
  END AS markdown
FROM p
"""


def customer_authors(spark: SparkSession, sf: str) -> DataFrame:
    """One author block per customer: name, nation as superscript, then a
    comma-led second author (the market segment) with the balance as superscript."""
    c = td.table(spark, sf, "customer")
    group = F.array(
        F.struct(F.lit("text").alias("type"), F.col("c_name").alias("content"),
                 F.array().cast("array<string>").alias("styles")),
        F.struct(F.lit("text").alias("type"), F.col("c_nationkey").cast("string").alias("content"),
                 F.array(F.lit("superscript")).alias("styles")),
        F.struct(F.lit("text").alias("type"), F.concat(F.lit(", "), F.col("c_mktsegment")).alias("content"),
                 F.array().cast("array<string>").alias("styles")),
        F.struct(F.lit("text").alias("type"), F.format_number("c_acctbal", 2).alias("content"),
                 F.array(F.lit("superscript")).alias("styles")),
    )
    group = F.transform(group, lambda x: F.to_json(x))
    tok = F.concat(F.lit('{"type":"author","content":[['), F.array_join(group, ","), F.lit("]]}"))
    return c.select(F.col("c_custkey").alias("doc_id"), _doc(tok).alias("json"))


CUSTOMER_AUTHORS_MD_SQL = r"""
SELECT c_custkey AS doc_id,
  '## Authors' || chr(10) || '<b>' || trim(c_name) || '</b><sup>' || c_nationkey || '</sup>, <b>'
  || trim(c_mktsegment) || '</b><sup>' || format('{:,.2f}', c_acctbal) || '</sup>' || chr(10) AS markdown
FROM customer
"""


def part_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Per part: an abstract in italics, a math environment in three forms, a citation with and without a title, a
    reference, a command, a numbered list at three depths, a bibliography and a token of no known type."""
    p = spread(td.table(spark, sf, "part"), "p_partkey")  # a small file of many parts: its JSON is built on all cores
    third = F.col("p_size") % 3
    math = F.when(third == 0, F.concat(F.lit("\\begin{x} "), F.col("p_type"))).when(third == 1, F.concat(F.lit(" "), F.col("p_type"), F.lit(" "))).otherwise(F.lit("  "))
    keys = F.array("p_brand", F.concat(F.lit("size "), F.col("p_size").cast("string")))
    text = lambda c: F.struct(F.array(_text_token(c)).alias("content"))
    cited = F.when(F.col("p_size") % 2 == 1, F.to_json(F.struct(
        F.lit("citation").alias("type"), keys.alias("content"), F.array(_text_token(F.col("p_type"))).alias("title")))).otherwise(
        F.to_json(F.struct(F.lit("citation").alias("type"), keys.alias("content"))))
    tokens = [
        F.to_json(F.struct(F.lit("abstract").alias("type"), F.array(_text_token(F.col("p_name"), ["italic"])).alias("content"))),
        F.to_json(F.struct(F.lit("math_env").alias("type"), math.alias("content"))),
        cited,
        F.to_json(F.struct(F.lit("ref").alias("type"), F.array(F.concat(F.lit("sec:"), F.col("p_size").cast("string"))).alias("content"))),
        F.lit('{"type":"command","content":"skipped"}'),
        F.to_json(F.struct(F.lit("list").alias("type"), F.lit("enumerate").alias("name"), third.alias("depth"),
                           F.array(text(F.col("p_brand")), text(F.col("p_type"))).alias("content"))),
        F.to_json(F.struct(F.lit("bibliography").alias("type"), F.array(
            F.struct(F.col("p_brand").alias("cite_key"), F.col("p_name").alias("content")),
            F.struct(F.col("p_type").alias("cite_key"), F.lit("second").alias("content"))).alias("content"))),
        F.lit('{"type":"mystery"}'),
    ]
    return p.select(F.col("p_partkey").alias("doc_id"), _doc(F.concat_ws(",", *tokens)).alias("json"))


def part_rules_sql(ignore_reference: bool = False, drop_bibliography: bool = False) -> str:
    cited = "''" if ignore_reference else "'[' || p_brand || ', size ' || p_size || CASE WHEN p_size % 2 = 1 THEN ', ' || p_type ELSE '' END || ']'"
    listed = "'## References' || chr(10) || '[' || p_brand || ']: ' || p_name || chr(10) || '[' || p_type || ']: second' || chr(10)"
    if ignore_reference:
        listed = "''" if drop_bibliography else "'<!-- Unknown token type: bibliography -->'"
    return f"""
SELECT p_partkey AS doc_id,
  '## Abstract' || chr(10) || '<i>' || p_name || '</i>' || chr(10)
  || CASE p_size % 3 WHEN 0 THEN '$$ \\begin{{x}} ' || p_type || ' $$' || chr(10) WHEN 1 THEN p_type || chr(10) ELSE '' END
  || {cited} || '[sec:' || p_size || ']'
  || repeat('  ', p_size % 3) || '1. ' || p_brand || chr(10) || repeat('  ', p_size % 3) || '1. ' || p_type || chr(10)
  || {listed} || '<!-- Unknown token type: mystery -->' AS markdown
FROM part
"""


#: The block table of ``conversation_blocks`` (B0), as this engine's paths.
CONVERSATION_FLAT_SQL = r"""
WITH t AS (SELECT conv_id AS doc_id, role, coalesce(text, '') AS text,
                  'c' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS VARCHAR), 10, '0') AS p FROM conversations),
z AS (SELECT '0000000000' AS z),
l AS (SELECT doc_id, p, unnest(range(len(string_split(text, chr(10))))) AS i FROM t WHERE role NOT IN ('system', 'user')),
li AS (SELECT doc_id, p || '/c' || lpad(CAST(i AS VARCHAR), 10, '0') AS p FROM l)
SELECT doc_id, p AS path, 0 AS depth, CASE role WHEN 'system' THEN 'section' WHEN 'user' THEN 'paragraph' ELSE 'list' END AS kind, true AS live FROM t
UNION ALL SELECT doc_id, p || '/a' || z, 1, 'text', true FROM t, z WHERE role = 'system'
UNION ALL SELECT doc_id, p || '/c' || z, 1, 'paragraph', true FROM t, z WHERE role = 'system'
UNION ALL SELECT doc_id, p || '/c' || z || '/c' || z, 2, 'text', true FROM t, z WHERE role = 'system'
UNION ALL SELECT doc_id, p || '/c' || z, 1, 'text', true FROM t, z WHERE role = 'user'
UNION ALL SELECT doc_id, p, 1, 'item', true FROM li
UNION ALL SELECT doc_id, p || '/c' || z, 2, 'text', true FROM li, z
"""
