import json

from papersift.operators.render import DIGITS, flatten, render

ZERO = "0" * DIGITS

DOC = {"tokens": [
    {"type": "title", "content": [{"type": "text", "content": "My Paper"}]},
    {"type": "text", "content": "top-level text is skipped"},
    {"type": "author", "content": [[
        {"type": "text", "content": "Ann Lee"}, {"type": "text", "content": "1", "styles": ["superscript"]},
        {"type": "text", "content": ", Bob Ray"}, {"type": "text", "content": "2", "styles": ["superscript"]}]]},
    {"type": "abstract", "content": [{"type": "text", "content": "We study "},
                                     {"type": "text", "content": "things", "styles": ["bold", "italic"]}]},
    {"type": "section", "level": 1, "numbering": "1", "title": [{"type": "text", "content": "Intro"}], "content": [
        {"type": "paragraph", "content": [
            {"type": "text", "content": "See"},
            {"type": "footnote", "content": [{"type": "text", "content": "outer"},
                                             {"type": "footnote", "content": [{"type": "text", "content": "inner"}]}]},
            {"type": "equation", "content": " x^2 ", "display": "inline"}]},
        {"type": "list", "name": "enumerate", "depth": 1, "content": [
            {"content": [{"type": "text", "content": "one"}]}, {"content": [{"type": "text", "content": "two"}]}]},
        {"type": "title", "content": [{"type": "text", "content": "My Paper"}]},
    ]},
    {"type": "table", "numbering": "2", "content": [
        {"tabular": [["a", "b"], [{"content": [{"type": "text", "content": "c"}]}, None]]},
        {"type": "caption", "content": "cap"}]},
    {"type": "table", "numbering": "3", "content": [{"tabular": [["only", "row"]]}]},
    {"type": "figure", "numbering": "1", "content": [{"type": "caption", "content": [{"type": "text", "content": "fig cap"}]}]},
    {"type": "citation", "content": ["k1", "k2"]},
    {"type": "bibliography", "content": [{"cite_key": "k1", "content": "Ref one"}]},
    {"type": "weird"},
]}

EXPECTED = (
    "# My Paper\n"
    "## Authors\n<b>Ann Lee</b><sup>1</sup>, <b>Bob Ray</b><sup>2</sup>\n"
    "## Abstract\nWe study <b><i>things</i></b>\n"
    "## 1. Intro\nSee[^1]$x^2$\n\n  1. one\n  1. two\n\n"
    "[Table 2]: cap\n| a | b |\n|---|---|\n| c |  |\n"
    "[Figure 1]: fig cap\n"
    "[k1, k2]## References\n[k1]: Ref one\n"
    "<!-- Unknown token type: weird -->"
    "\n\n[^2]: inner\n[^1]: outer[^2]"
)


def _docs(spark, *docs):
    return spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "doc_id long, json string")


def test_render_full_document(spark):
    out = render(_docs(spark, DOC)).first().markdown
    assert out == EXPECTED


def test_ignore_reference(spark):
    out = render(_docs(spark, DOC), ignore_reference=True).first().markdown
    assert "[k1, k2]" not in out
    assert "<!-- Unknown token type: bibliography --><!-- Unknown token type: weird -->" in out
    dropped = render(_docs(spark, DOC), ignore_reference=True, drop_bibliography=True).first().markdown
    assert "bibliography" not in dropped and "<!-- Unknown token type: weird -->" in dropped


def test_complex_table_kept_as_json_and_equation_cleaning(spark):
    tok = {"type": "table", "numbering": "4", "content": [
        {"tabular": [[{"content": "h", "rowspan": 2}, "x"], ["y", "z"]]}]}
    eq = {"type": "equation", "content": "  a + \\foo[b]{c}{d} $$e$ ", "display": "block"}
    md = render(_docs(spark, {"tokens": [tok, eq]}), clean_equations=True).first().markdown
    raw = json.dumps(tok, separators=(",", ":"))
    assert md == f"[Table 4]: \nFollowing table is represented in JSON:\n```json\n{raw}\n```\n$$ a +  e $$\n"


def test_sections_lists_math_and_empty_docs(spark):
    d1 = {"tokens": [
        {"type": "section", "level": 2, "title": [], "content": []},
        {"type": "section", "level": 0, "title": "Plain", "content": [{"type": "math_env", "content": " \\begin{x} "}]},
        {"type": "math_env", "content": [{"type": "text", "content": " y "}]},
        {"type": "list", "content": [{"content": []}]},
        {"type": "ref", "content": ["sec:1"]},
        {"type": "command", "content": "ignored"},
        {"type": "group", "content": [{"type": "text", "content": "g", "styles": ["italic"]}]},
    ]}
    d2 = {"tokens": []}
    got = {r.doc_id: r.markdown for r in render(_docs(spark, d1, d2)).collect()}
    assert got[0] == "# Plain\n$$ \\begin{x} $$\n\ny\n- \n[sec:1]<i>g</i>"
    assert got[1] == ""


def test_flatten_marks_unvisited_blocks(spark):
    doc = {"tokens": [{"type": "figure", "content": [
        {"type": "caption", "content": "first"}, {"type": "caption", "content": "second"},
        {"type": "paragraph", "content": []}]}]}
    rows = {r.path: r.live for r in flatten(_docs(spark, doc)).collect()}
    assert rows == {
        f"c{ZERO}": True, f"c{ZERO}/c{ZERO}": True, f"c{ZERO}/c{ZERO[1:]}1": False, f"c{ZERO}/c{ZERO[1:]}2": False}


def test_tree_deeper_than_one_expansion_pass(spark):
    node = {"type": "text", "content": "deep", "styles": ["bold"]}
    for _ in range(12):
        node = {"type": "group", "content": [node]}
    md = render(_docs(spark, {"tokens": [node]})).first().markdown
    assert md == "<b>deep</b>"
    blocks = flatten(_docs(spark, {"tokens": [node]}))
    assert blocks.count() == 13 and blocks.agg({"depth": "max"}).first()[0] == 12


def _md(spark, tokens, **opts):
    docs = spark.createDataFrame([(1, json.dumps({"tokens": tokens}))], "doc_id long, json string")
    return render(docs, **opts).first()["markdown"]


def _text(t):
    return {"type": "text", "content": t}


def test_more_siblings_than_five_digits(spark):
    words = [f"w{k} " for k in range(100_012)]
    paragraph = {"type": "paragraph", "content": [_text(w) for w in words]}
    assert _md(spark, [paragraph]) == "".join(words) + "\n\n"


def test_forty_levels(spark):
    token = _text("deep")
    for _ in range(40):
        token = {"type": "group", "content": [token]}
    assert _md(spark, [{"type": "paragraph", "content": [token]}]) == "deep\n\n"


def test_private_use_characters_are_text(spark):
    odd = "a\ue000b\ue001c\ue002d"
    assert _md(spark, [{"type": "paragraph", "content": [_text(odd)]}]) == odd + "\n\n"


def test_repeated_title_leaves_nothing_behind(spark):
    title = {"type": "title", "content": [_text("T")]}
    tokens = [title, {"type": "paragraph", "content": [title]}, {"type": "section", "level": 1, "content": [title]}, {"type": "paragraph", "content": [title, _text("x")]}]
    assert _md(spark, tokens) == "# T\nx\n\n"


def test_caption_after_a_string_item(spark):
    caption = {"type": "caption", "content": "cap"}
    assert _md(spark, [{"type": "figure", "numbering": "1", "content": ["raw", caption]}]) == "[Figure 1]: cap\n"
    table = {"type": "table", "numbering": "2", "content": [{"tabular": [["a"], ["b"]]}, "raw", caption]}
    assert _md(spark, [table]).startswith("[Table 2]: cap\n")


def test_json_table_is_ascii(spark):
    table = {"type": "table", "numbering": "1", "content": [{"type": "caption", "content": "é 😀"}]}
    assert json.dumps(table, separators=(",", ":")) in _md(spark, [table])


def test_one_exchange(spark):
    plan = render(_docs(spark, DOC))._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[-1]
    assert final.count("Exchange") == 1 and "hashpartitioning(doc_id" in final


def test_same_and_missing_ids(spark):
    docs = spark.createDataFrame([(1, json.dumps({"tokens": [{"type": "paragraph", "content": [_text(t)]}]})) for t in "ab"]
                                 + [(None, json.dumps({"tokens": [{"type": "title", "content": [_text(t)]}]})) for t in "cc"]
                                 + [(2, None), (3, "broken"), (4, "{}")], "doc_id long, json string")
    got = sorted((str(r.doc_id), r.markdown) for r in render(docs).collect())
    assert got == [("1", "a\n\n"), ("1", "b\n\n"), ("2", ""), ("3", ""), ("4", ""), ("None", "# c\n"), ("None", "# c\n")]


def test_titles_in_titles(spark):
    inner = {"type": "title", "content": [_text("in")]}
    outer = {"type": "title", "content": [_text("out "), inner]}
    # the outer title is compared by its whole text, the inner one is finished first
    assert _md(spark, [outer, inner, outer, {"type": "title", "content": [_text("out # in\n")]}]) == "# out # in\n\n"


def test_empty_table_content(spark):
    assert _md(spark, [{"type": "table", "numbering": "1", "content": []}, {"type": "ref", "content": []}]).endswith("[]")


def test_strings_that_begin_like_lists_are_text(spark):
    from papersift.operators.render import render

    tokens = '{"type":"paragraph","content":[{"type":"text","content":"[\\"a\\"]"},{"type":"text","content":"[b"},{"type":"text","content":5}]}'
    section = '{"type":"section","level":1,"title":"[1]","content":[{"type":"paragraph","content":"[c]"}]}'
    docs = spark.createDataFrame([("d", f'{{"tokens":[{tokens},{section}]}}')], "doc_id string, json string")
    assert render(docs).collect()[0].markdown == '["a"][b5\n\n## [1]\n\n'


def test_part_documents_are_built_on_all_cores(spark, tmp_path):
    from papersift.plans import token_docs

    row = (1, "n", "Brand#1", "t", 3)
    spark.createDataFrame([row, (2, *row[1:])], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for made in (token_docs.part_rules, token_docs.part_tables):
        assert made(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
