"""Token trees to Markdown as a Spark job: B0-B16.

A document is a unit of work.  The only exchange deals the documents out; all that follows stays in its partition.

*Flatten* (B0): a fold expands a document's JSON one tree level after the other (open nodes become blocks with compact
attributes, their children are the next open nodes) until none is open, to any depth.  The result is one row per block.
A block's ``path`` is its position from the root: segments of one slot letter (``a`` title list, ``c`` content list,
``r`` table rows) and a 10-digit position, joined by ``/``, so sorting paths gives document order.  Every block knows
whether the renderer visits it (``live``) and under which options (``ir`` ignore references, ``ce`` clean equations;
some edges turn them off, see B16).

*Render*: prefix counts number the footnotes (B7) and titles in document order and tell each block where its children
stand in the next level.  Then one grouped aggregate collects a document's levels, and a fold renders them, deepest
first: a block gets the slice of its rendered children, and each block type's rule is a column expression.  The work is
in proportion to the blocks.  Footnote texts are listed at the end in the order they are completed.  Repeated titles
(B1): a first fold renders the title subtrees alone, and a title whose text an earlier one of the document has is
rendered as nothing in the second.  A title inside a title is compared by its whole text.

Rows with the same or no document id are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papersift.functions.text import clean_equation
from papersift.session import spread

#: ``content`` and ``title`` are a string or a list, whose JSON is read here as it is.
NODE_SCHEMA = (
    "struct<type:string,content:string,title:string,level:int,numbering:string,"
    "name:string,depth:int,display:string,styles:array<string>,cite_key:string>"
)

#: Digits of a position in a path: no array has more elements than ten digits count, so none is ever cut.
DIGITS = 10

# Fixed type names of the token format.
PROCESS_TOKENS_TYPES = ["document", "group", "section", "paragraph", "footnote"]
PROCESS_CONTENT_TYPES = ["title", "abstract", "caption", "bibitem", "math_env"]


# A cell dict with a truthy rowspan or colspan.  The raw JSON text here is the
# compact re-serialisation made by the JSON reader, so the keys appear as
# "rowspan": directly followed by the value; falsy values are 0, false, null,
# "", [] and {}.  Text inside strings cannot match: its quotes are escaped.
COMPLEX_CELL = r'"(rowspan|colspan)":(?!(0|0\.0|false|null|""|\[\]|\{\})[,}\]])'


def _is_complex(first_content: Column) -> Column:
    """The table's first content item has a spanning cell."""
    return F.coalesce(first_content.rlike(COMPLEX_CELL), F.lit(False))


def _ascii_json(text: Column) -> Column:
    """JSON text with every non-ASCII character as an escape, a surrogate pair above U+FFFF."""
    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        over = code - 0x10000
        pair = F.concat(unit(F.shiftright(over, 10) + 0xD800), unit(over.bitwiseAND(F.lit(0x3FF)) + 0xDC00))
        return F.when(code < 128, c).when(code < 0x10000, unit(code)).otherwise(pair)

    # the JSON reader writes surrogates as escapes of its own, in capitals
    parts = F.split(text, r"(?<!\\)\\u(?=D[89A-F][0-9A-F]{2})")
    small = F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(F.concat(F.lit("\\u"), F.lower(F.substring(p, 1, 4)), F.substring(p, 5, 1 << 30))))
    text = F.array_join(small, "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(text, ""), escaped), "")).otherwise(text)


def _first_caption(node: Column) -> Column:
    """1-based position of the first caption among the content items (0 if none)."""
    items = F.from_json(node, "struct<content:array<string>>")["content"]
    types = F.transform(items, lambda x: F.get_json_object(x, "$.type"))  # null for items that are no objects
    return F.coalesce(F.array_position(F.transform(types, lambda t: F.coalesce(t, F.lit(""))), "caption"), F.lit(0)).cast("int")


# Attributes a block keeps after expansion (name, type).
ATTRS = [
    ("kind", "string"), ("typ", "string"), ("lvl", "int"), ("numbering", "string"), ("lname", "string"),
    ("ldepth", "int"), ("display", "string"), ("styles", "array<string>"), ("cite_key", "string"),
    ("has_clist", "boolean"), ("has_tlist", "boolean"), ("text", "string"), ("title_str", "string"),
    ("keys", "array<string>"), ("table_mode", "string"), ("cap_pos", "int"), ("cell_kind", "string"),
    ("raw", "string"),
]
POSITION = ["doc_id", "path", "parent_path", "ptype", "depth", "slot", "pkind", "ir", "ce", "live", "top", "in_title"]
BLOCK_COLUMNS = POSITION + [n for n, _ in ATTRS]


def _list_of(node: Column, a: Column, name: str) -> Column:
    """The elements' JSON if the field is a list, else null.  Only a value that begins like a list is parsed as one (a
    string may begin so, too)."""
    return F.when(a[name].startswith("["), F.from_json(node, f"struct<{name}:array<string>>")[name])


def _attr_columns(kind: Column, a: Column, content: Column, title: Column, node: Column) -> dict:
    """Attributes of an expanded node (``a``: the node parsed as a token, ``content`` and ``title``: its lists).
    The subtree JSON is not kept, except where a rule prints it: tables shown as JSON, and plain-text table cells."""
    first = F.get(content, F.lit(0))
    tabular = F.from_json(first, "struct<tabular:array<string>>")["tabular"]
    table_mode = F.when(kind != "table", F.lit(None)).when(
        content.isNull() | (F.size(content) == 0) | F.get_json_object(first, "$.tabular").isNull()
        | tabular.isNull() | (F.size(tabular) == 0) | _is_complex(first), F.lit("json")).otherwise(F.lit("pipe"))
    cell_kind = F.when(kind != "tcell", F.lit(None)).when(node.isNull(), F.lit("null")) \
        .when(node.startswith("["), F.lit("list")).when(node.startswith("{"), F.lit("dict")).otherwise(F.lit("str"))
    return {
        "kind": kind, "typ": a["type"], "lvl": a["level"], "numbering": a["numbering"], "lname": a["name"],
        "ldepth": a["depth"], "display": a["display"], "styles": a["styles"], "cite_key": a["cite_key"],
        "has_clist": content.isNotNull(), "has_tlist": title.isNotNull(),
        "text": F.when(content.isNull(), a["content"]), "title_str": F.when(title.isNull(), a["title"]),
        "keys": F.when(kind.isin("citation", "ref"), content),
        "table_mode": table_mode,
        "cap_pos": F.when(kind.isin("figure", "table"), _first_caption(node)),
        "cell_kind": cell_kind,
        "raw": F.when(table_mode == "json", _ascii_json(node)).when(cell_kind == "str", node),
    }


def _child_lists(kind: Column, content: Column, title: Column, node: Column, live: Column, ir: Column, ce: Column,
                 cap_pos: Column, table_mode: Column, typ: Column) -> Column:
    """Which child lists a node's renderer visits, with the options it passes on:
    an array of (slot, list, kind given by the parent, live, ir, ce, only_pos)."""
    def spec(slot, arr, pkind, child_live, child_ir, child_ce, only_pos=None):
        return F.struct(
            F.lit(slot).alias("slot"), arr.alias("arr"), F.lit(pkind).cast("string").alias("pkind"),
            child_live.alias("live"), child_ir.alias("ir"), child_ce.alias("ce"),
            (only_pos if only_pos is not None else F.lit(-1)).alias("only_pos"))

    k = kind
    as_list = F.from_json(node, "array<string>")
    tabular = F.from_json(F.get(content, F.lit(0)), "struct<tabular:array<string>>")["tabular"]
    off = F.lit(False)
    return F.array(
        # title lists: section (content rules, ir kept), citation and url (references always kept)
        F.when(k == "section", spec("a", title, None, live, ir, off))
        .when(k == "citation", spec("a", title, None, live & ~ir, off, off))
        .when(k == "aitem", spec("a", title, None, live & (typ == "url"), off, off)),
        # content lists: token lists pass the options on; content values stop equation cleaning
        F.when(k.isin(*PROCESS_TOKENS_TYPES, "item"), spec("c", content, None, live, ir, ce))
        .when(k.isin(*PROCESS_CONTENT_TYPES), spec("c", content, None, live, ir, off))
        .when(k == "list", spec("c", content, "item", live, ir, ce))
        .when(k == "bibliography", spec("c", content, "bibitem", live & ~ir, ir, off))
        .when(k == "author", spec("c", content, "agroup", live, off, off))
        .when(k == "agroup", spec("c", F.coalesce(as_list, F.array(node)), "aitem", live, off, off))
        # figure and table: only the first caption is visited (only_pos 0: none)
        .when(k == "figure", spec("c", content, None, live, off, off, cap_pos))
        .when(k == "table", spec("c", content, None, live, ir, off, cap_pos))
        .when(k == "tcell", spec("c", F.coalesce(content, as_list), None, live, ir, off)),
        # table rows, then cells
        F.when(k == "table", spec("r", tabular, "trow", live & (table_mode == "pipe"), ir, off))
        .when(k == "trow", spec("r", as_list, "tcell", live, ir, off)),
    )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once.  (A fold over nothing: unlike ``transform`` it copies no value.)"""
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, body)


OPEN = ("struct<path:string,parent_path:string,ptype:string,depth:int,slot:string,pkind:string,ir:boolean,ce:boolean,"
        "live:boolean,top:boolean,in_title:boolean,node:string>")
BLOCK = OPEN.removesuffix(",node:string>") + "," + ",".join(f"{n}:{t}" for n, t in ATTRS) + ",n_kids:int>"
LEVELS = f"struct<levels:array<array<{BLOCK}>>,open:array<{OPEN}>>"


def _closed(open_nodes: Column, unvisited: bool) -> Column:
    """Each open node as its block and its children, which are open."""
    def parsed(o):
        a = F.from_json(o["node"], NODE_SCHEMA)
        return _let(a, lambda a: _let(F.struct(
            o.alias("o"), a.alias("a"), F.coalesce(o["pkind"], a["type"], F.lit("None")).alias("k"),
            _list_of(o["node"], a, "content").alias("content"), _list_of(o["node"], a, "title").alias("title")), described))

    def described(x):
        o, k = x["o"], x["k"]
        # A top-level text token is skipped; a command token is never rendered.
        live = o["live"] & (k != "command") & ~(o["top"] & (k == "text"))
        attrs = _attr_columns(k, x["a"], x["content"], x["title"], o["node"])
        return _let(F.struct(x.alias("x"), live.alias("live"), F.struct(*[attrs[n].cast(t).alias(n) for n, t in ATTRS]).alias("attrs")), with_children)

    def with_children(y):
        o, at, live = y["x"]["o"], y["attrs"], y["live"]
        specs = _child_lists(at["kind"], y["x"]["content"], y["x"]["title"], o["node"], live, o["ir"], o["ce"], at["cap_pos"], at["table_mode"], at["typ"])
        in_title = o["in_title"] | F.coalesce(at["kind"] == "title", F.lit(False))

        def children_of(s):
            def child(e, i):
                keep = (s["only_pos"] == -1) | (i + 1 == s["only_pos"])
                path = F.concat(o["path"], F.lit("/"), s["slot"], F.lpad(i.cast("string"), DIGITS, "0"))
                return F.struct(
                    path.alias("path"), o["path"].alias("parent_path"), at["kind"].alias("ptype"), (o["depth"] + 1).alias("depth"),
                    s["slot"].alias("slot"), s["pkind"].alias("pkind"), s["ir"].alias("ir"), s["ce"].alias("ce"), (s["live"] & keep).alias("live"),
                    F.lit(False).alias("top"), in_title.alias("in_title"), e.alias("node"))
            return F.transform(s["arr"], child)

        kids = F.flatten(F.transform(F.filter(specs, lambda s: s.isNotNull() & s["arr"].isNotNull()), children_of))
        if not unvisited:
            kids = F.when(live, kids).otherwise(F.array().cast(f"array<{OPEN}>"))
        return _let(kids, lambda kids: block(y, kids))

    def block(y, kids):
        own = [(y["live"] if c == "live" else y["x"]["o"][c]).alias(c) for c in POSITION if c != "doc_id"]
        own += [y["attrs"][n].alias(n) for n, _ in ATTRS] + [F.size(kids).alias("n_kids")]
        return F.struct(F.struct(*own).alias("block"), kids.alias("kids"))

    return F.transform(open_nodes, parsed)


def _levels(json: Column, ignore_reference: bool, clean_equations: bool, unvisited: bool) -> Column:
    """The blocks of one document, an array for each tree level, each in document order."""
    tokens = F.from_json(json, "struct<tokens:array<string>>")["tokens"]

    def root(node, i):
        return F.struct(
            F.concat(F.lit("c"), F.lpad(i.cast("string"), DIGITS, "0")).alias("path"), F.lit("").alias("parent_path"), F.lit("root").alias("ptype"),
            F.lit(0).alias("depth"), F.lit("c").alias("slot"), F.lit(None).cast("string").alias("pkind"), F.lit(ignore_reference).alias("ir"),
            F.lit(clean_equations).alias("ce"), F.lit(True).alias("live"), F.lit(True).alias("top"), F.lit(False).alias("in_title"), node.alias("node"))

    start = F.struct(F.array().cast(f"array<array<{BLOCK}>>").alias("levels"),
                     F.transform(F.coalesce(tokens, F.array().cast("array<string>")), root).cast(f"array<{OPEN}>").alias("open"))

    def deeper(state, _):
        def added(closed):
            return F.struct(
                F.concat(state["levels"], F.array(F.transform(closed, lambda z: z["block"]))).alias("levels"),
                F.flatten(F.transform(closed, lambda z: z["kids"])).alias("open"))
        return F.when(F.size(state["open"]) == 0, state).otherwise(_let(_closed(state["open"], unvisited), added))

    # every level but those of author items has a list of its own in the text, so a document has no more levels than this
    lists = F.coalesce(F.length(json) - F.length(F.replace(json, F.lit("["), F.lit(""))), F.lit(0))
    return F.aggregate(F.sequence(F.lit(0), 2 * lists), start.cast(LEVELS), deeper)["levels"]


def flatten(docs: DataFrame, ignore_reference: bool = False, clean_equations: bool = False,
            doc_col: str = "doc_id", json_col: str = "json") -> DataFrame:
    """One row per block of every document, with compact attributes.  Narrow: nothing is stored or shuffled
    (small inputs are spread over all cores first)."""
    docs = spread(docs, doc_col)
    levels = _levels(F.col(json_col), ignore_reference, clean_equations, unvisited=True)
    return docs.select(F.col(doc_col).alias("doc_id"), F.explode(F.flatten(levels)).alias("b")).select("doc_id", "b.*").select(*BLOCK_COLUMNS)


# ---------------------------------------------------------------- render


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


ITEM_TYPE = "struct<kind:string,text:string,sup:boolean,link:string>"
TITLE_TYPE = "struct<text:string,key:string,number:int>"
RENDERED = (f"struct<slot:string,kind:string,live:boolean,md:string,item:{ITEM_TYPE},items:array<{ITEM_TYPE}>,"
            f"notes:array<string>,title:{TITLE_TYPE}>")


def _of_children(kids: Column) -> Column:
    """What a block's rule takes from its rendered children, which are in document order."""
    def md(cond):
        return F.transform(F.filter(kids, cond), lambda k: k["md"])

    return F.struct(
        F.array_join(md(lambda k: k["slot"] == "c"), "").alias("content_md"),
        F.array_join(md(lambda k: k["slot"] == "a"), "").alias("title_md"),
        md(lambda k: k["slot"] == "c").alias("parts"),
        md(lambda k: k["slot"] == "r").alias("rows"),
        F.array_join(md(lambda k: k["kind"] == "caption"), "").alias("caption_md"),
        F.flatten(F.transform(F.filter(kids, lambda k: k["kind"] == "agroup"), lambda k: k["items"])).alias("aitems"),
        F.transform(F.filter(kids, lambda k: k["kind"] == "aitem"), lambda k: k["item"]).alias("group_items"),
        F.flatten(F.transform(kids, lambda k: k["notes"])).alias("notes"),
    )


def _author_md(items: Column) -> Column:
    """B15 as a fold over the ordered author items (a group ends with an 'end' item)."""
    empty = F.array().cast("array<string>")
    init = F.struct(empty.alias("parts"), empty.alias("cur"), empty.alias("sups"))

    def sup(s):
        return F.concat(F.lit("<sup>"), F.array_join(s, ","), F.lit("</sup>"))

    def flushed_parts(st):
        cur = F.when(F.size(st["sups"]) > 0, F.concat(st["cur"], F.array(sup(st["sups"])))).otherwise(st["cur"])
        return F.when((F.size(st["cur"]) > 0) | (F.size(st["sups"]) > 0),
                      F.concat(st["parts"], F.array(F.array_join(cur, "")))).otherwise(st["parts"])

    def step(st, x):
        kind = x["kind"]
        t = F.coalesce(x["text"], F.lit(""))
        lead = t.startswith(",")
        # after a leading comma: flush the current author, then strip the commas
        parts1 = F.when(lead, flushed_parts(st)).otherwise(st["parts"])
        cur1 = F.when(lead, empty).otherwise(st["cur"])
        sups1 = F.when(lead, empty).otherwise(st["sups"])
        t1 = F.when(lead, _strip(F.regexp_replace(t, "^,+", ""))).otherwise(t)
        skip = (t1 == "") | t1.isin(",", ";")
        as_sup = ~skip & F.coalesce(x["sup"], F.lit(False))
        as_name = ~skip & ~F.coalesce(x["sup"], F.lit(False))
        cur_name = F.concat(
            F.when(F.size(sups1) > 0, F.concat(cur1, F.array(sup(sups1)))).otherwise(cur1),
            F.array(F.concat(F.lit("<b>"), t1, F.lit("</b>"))))
        text_state = F.struct(
            parts1.alias("parts"),
            F.when(as_name, cur_name).otherwise(cur1).alias("cur"),
            F.when(as_sup, F.concat(sups1, F.array(t1))).when(as_name, empty).otherwise(sups1).alias("sups"))
        url_state = F.struct(st["parts"].alias("parts"), F.concat(st["cur"], F.array(x["link"])).alias("cur"),
                             st["sups"].alias("sups"))
        end_state = F.struct(flushed_parts(st).alias("parts"), empty.alias("cur"), empty.alias("sups"))
        return F.when(kind == "text", text_state).when(kind == "url", url_state) \
            .when(kind == "end", end_state).otherwise(st)

    parts = F.aggregate(items, init, step)["parts"]
    return F.when(F.size(parts) > 0, F.concat(F.lit("## Authors\n"), F.array_join(parts, ", "), F.lit("\n"))) \
        .otherwise(F.lit(""))


def _rendered(b: Column, kids: Column, again: Column, drop_bibliography: bool) -> Column:
    """A block's RENDERED from its live rendered children; ``again``: a title whose text came before."""
    return _let(kids, lambda kids: _let(_of_children(kids), lambda c: _by_rule(b, c, again, drop_bibliography)))


def _by_rule(b: Column, c: Column, again: Column, drop_bibliography: bool) -> Column:
    """The per-type rendering rules."""
    k = b["kind"]
    content_md, title_md, caption, parts, rows = c["content_md"], c["title_md"], c["caption_md"], c["parts"], c["rows"]
    # process_content: a string is taken as it is, a list is rendered
    content_value = F.when(~b["has_clist"], F.coalesce(b["text"], F.lit(""))).otherwise(content_md)
    title_value = F.when(~b["has_tlist"], F.coalesce(b["title_str"], F.lit(""))).otherwise(title_md)
    numbering = F.coalesce(b["numbering"], F.lit(""))
    styles = F.coalesce(b["styles"], F.array().cast("array<string>"))
    text = F.coalesce(b["text"], F.lit(""))

    styled = (
        F.when(F.array_contains(styles, "bold") & F.array_contains(styles, "italic"),
               F.concat(F.lit("<b><i>"), text, F.lit("</i></b>")))
        .when(F.array_contains(styles, "bold"), F.concat(F.lit("<b>"), text, F.lit("</b>")))
        .when(F.array_contains(styles, "italic"), F.concat(F.lit("<i>"), text, F.lit("</i>")))
        .otherwise(text))

    eq = _strip(text)
    eq = F.when(b["ce"], clean_equation(eq)).otherwise(eq)
    equation = F.when(b["display"] == "block", F.concat(F.lit("$$ "), eq, F.lit(" $$\n"))) \
        .otherwise(F.concat(F.lit("$"), eq, F.lit("$")))

    keys = F.coalesce(b["keys"], F.array().cast("array<string>"))
    citation = F.concat(F.lit("["), F.array_join(keys, ", "),
                        F.when(title_value != "", F.concat(F.lit(", "), title_value)).otherwise(F.lit("")),
                        F.lit("]"))
    ref = F.concat(F.lit("["), F.coalesce(F.get(b["keys"], F.lit(0)), F.lit("")), F.lit("]"))

    menv = _strip(content_value)
    math_env = F.when(menv == "", F.lit("")).when(
        menv.startswith("\\begin{"), F.concat(F.lit("$$ "), menv, F.lit(" $$\n"))).otherwise(F.concat(menv, F.lit("\n")))

    title = F.when(again, F.lit("")).otherwise(F.concat(F.lit("# "), content_value, F.lit("\n")))
    abstract = F.when(content_value != "", F.concat(F.lit("## Abstract\n"), content_value, F.lit("\n"))).otherwise(F.lit(""))
    sec_title = F.when(numbering != "", F.concat(numbering, F.lit(". "), title_value)).otherwise(title_value)
    section = F.when((sec_title != "") | (content_md != ""),
                     F.concat(F.repeat(F.lit("#"), F.coalesce(b["lvl"], F.lit(1)) + 1), F.lit(" "), sec_title,
                              F.lit("\n"), content_md, F.lit("\n"))).otherwise(F.lit(""))
    paragraph = F.when(content_md != "", F.concat(content_md, F.lit("\n\n"))).otherwise(F.lit(""))
    prefix = F.concat(F.repeat(F.lit("  "), F.coalesce(b["ldepth"], F.lit(0))),
                      F.when(b["lname"] == "enumerate", F.lit("1. ")).otherwise(F.lit("- ")))
    lst = F.when(F.size(parts) > 0,
                 F.concat(F.array_join(F.transform(parts, lambda x: F.concat(prefix, x)), "\n"), F.lit("\n"))) \
        .otherwise(F.lit(""))
    figure = F.when(caption != "", F.concat(F.lit("[Figure "), numbering, F.lit("]: "), caption, F.lit("\n"))) \
        .otherwise(F.lit(""))

    head = F.concat(F.lit("[Table "), numbering, F.lit("]: "), caption, F.lit("\n"))
    as_json = F.concat(head, F.lit("Following table is represented in JSON:\n```json\n"), b["raw"], F.lit("\n```\n"))
    n_cols = F.size(F.split(F.get(rows, F.lit(0)), r"\|")) - 2
    sep = F.concat(F.lit("|"), F.repeat(F.lit("---|"), n_cols))
    pipe = F.concat(head, F.get(rows, F.lit(0)), F.lit("\n"), sep,
                    F.when(F.size(rows) > 1, F.concat(F.lit("\n"), F.array_join(F.slice(rows, 2, 1 << 30), "\n")))
                    .otherwise(F.lit("")), F.lit("\n"))
    table = (F.when(b["table_mode"] == "json", as_json)
             .when(F.size(rows) > 1, pipe).otherwise(F.lit("")))
    trow = F.concat(F.lit("| "), F.array_join(rows, " | "), F.lit(" |"))
    cell = b["cell_kind"]
    tcell = (F.when(cell == "null", F.lit(""))
             .when(cell == "list", content_md)
             .when(cell == "dict", content_value)
             .otherwise(b["raw"]))
    footnote = F.concat(F.lit("[^"), b["fn_no"].cast("string"), F.lit("]"))
    bibitem = F.concat(F.lit("["), F.coalesce(b["cite_key"], F.lit("")), F.lit("]: "), content_value)
    # With references ignored, the bibliography falls through to the unknown-type
    # comment (kept by default so results agree); drop_bibliography removes it.
    ignored_bib = F.lit("") if drop_bibliography else F.lit("<!-- Unknown token type: bibliography -->")
    bibliography = F.when(b["ir"], ignored_bib).when(
        F.size(parts) > 0, F.concat(F.lit("## References\n"), F.array_join(parts, "\n"), F.lit("\n"))
    ).otherwise(F.lit(""))
    unknown = F.concat(F.lit("<!-- Unknown token type: "), k, F.lit(" -->"))

    md = (
        F.when(k == "text", F.when(b["top"], F.lit("")).otherwise(styled))
        .when(k == "equation", equation)
        .when(k == "citation", F.when(b["ir"], F.lit("")).otherwise(citation))
        .when(k == "ref", ref)
        .when(k == "math_env", math_env)
        .when(k == "title", title)
        .when(k == "author", _author_md(c["aitems"]))
        .when(k == "abstract", abstract)
        .when(k == "section", section)
        .when(k == "paragraph", paragraph)
        .when(k == "list", lst)
        .when(k == "item", content_md)
        .when(k == "figure", figure)
        .when(k == "table", table)
        .when(k == "trow", trow)
        .when(k == "tcell", tcell)
        .when(k == "caption", content_value)
        .when(k == "footnote", footnote)
        .when(k == "bibliography", bibliography)
        .when(k == "bibitem", bibitem)
        .when(k.isin("document", "group"), content_md)
        .when(k == "command", F.lit(""))
        .when(k.isin("agroup", "aitem"), F.lit(""))
        .otherwise(unknown)
    )
    item = F.when(k == "aitem", F.when(
        b["typ"] == "text",
        F.struct(F.lit("text").alias("kind"), _strip(text).alias("text"),
                 F.array_contains(styles, "superscript").alias("sup"), F.lit(None).cast("string").alias("link")))
        .when(b["typ"] == "url",
              F.struct(F.lit("url").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("sup"),
                       F.concat(F.lit("["), title_value, F.lit("]("), text, F.lit(")")).alias("link")))
        .otherwise(F.struct(F.lit("skip").alias("kind"), F.lit(None).cast("string").alias("text"),
                            F.lit(False).alias("sup"), F.lit(None).cast("string").alias("link"))))
    end_item = F.struct(F.lit("end").alias("kind"), F.lit(None).cast("string").alias("text"),
                        F.lit(False).alias("sup"), F.lit(None).cast("string").alias("link"))
    items = F.when(k == "agroup", F.concat(
        c["group_items"], F.array(end_item)))
    entry = F.concat(F.lit("[^"), b["fn_no"].cast("string"), F.lit("]: "), content_md)
    notes = F.when(k == "footnote", F.concat(c["notes"], F.array(entry))).otherwise(c["notes"])
    as_title = F.when(k == "title", F.struct(content_value.alias("text"), F.concat(b["path"], F.lit("~")).alias("key"), b["title_no"].alias("number")))
    return F.struct(b["slot"].alias("slot"), k.alias("kind"), b["live"].alias("live"), md.alias("md"), item.cast(ITEM_TYPE).alias("item"),
                    items.cast(f"array<{ITEM_TYPE}>").alias("items"), notes.alias("notes"), as_title.cast(TITLE_TYPE).alias("title")).cast(RENDERED)


def _live_children(kids: Column, first: Column, n: Column) -> Column:
    return F.filter(F.slice(kids, first, n), lambda k: k["live"])


def _repeats(levels: Column) -> Column:
    """For each title, by its number, whether a title that is finished before it has the same text (B1)."""
    start = F.struct(F.array().cast(f"array<{RENDERED}>").alias("kids"), F.array().cast(f"array<{TITLE_TYPE}>").alias("found"))

    def higher(state, level):
        own = F.filter(level["blocks"], lambda b: b["in_title"] | (b["kind"] == "title"))
        rendered = F.transform(own, lambda b: _rendered(b, _live_children(state["kids"], b["title_first"], b["n_kids"]), F.lit(False), False))
        return _let(rendered, lambda r: F.struct(r.alias("kids"), F.concat(
            state["found"], F.transform(F.filter(r, lambda x: x["live"] & x["title"].isNotNull()), lambda x: x["title"])).alias("found")))

    def marked(found):
        numbered = F.transform(found, lambda x, i: F.struct(
            x["number"].alias("number"), F.coalesce(x["text"] == F.get(found, i - 1)["text"], F.lit(False)).alias("again")))
        return F.transform(F.array_sort(numbered), lambda x: x["again"])

    found = F.aggregate(levels, start, higher)["found"]
    return _let(F.array_sort(found), marked)


def _document(levels: Column, again: Column, drop_bibliography: bool) -> Column:
    """The top level's rendered blocks."""
    def higher(kids, level):
        return F.transform(level["blocks"], lambda b: _rendered(
            b, _live_children(kids, b["first"], b["n_kids"]), F.coalesce(F.get(again, b["title_no"] - 1), F.lit(False)), drop_bibliography))

    return F.aggregate(levels, F.array().cast(f"array<{RENDERED}>"), higher)


def render(docs: DataFrame, ignore_reference: bool = False, clean_equations: bool = False,
           doc_col: str = "doc_id", json_col: str = "json", drop_bibliography: bool = False) -> DataFrame:
    """Markdown per document: ``(doc_id, markdown)``.

    Options (B16): ``ignore_reference`` drops citations and the bibliography
    (which then prints as an unknown-type comment unless ``drop_bibliography``);
    ``clean_equations`` strips commands and dollar signs from equations."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    dealt = docs.select(F.col(doc_col).alias("doc_id"), F.col(json_col).alias("json")).repartition(parts, "doc_id")
    dealt = dealt.withColumn("doc", F.monotonically_increasing_id())
    levels = _levels(F.col("json"), ignore_reference, clean_equations, unvisited=False)
    blocks = dealt.select("doc_id", "doc", F.explode_outer(F.flatten(levels)).alias("b")).select("doc_id", "doc", "b.*")

    one = lambda cond: F.sum(F.when(cond & F.col("live"), 1).otherwise(0))
    before = Window.partitionBy("doc_id", "doc").orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = Window.partitionBy("doc_id", "doc", "depth").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    is_title = F.col("kind") == "title"
    place = lambda n: (1 + F.coalesce(F.sum(n).over(level), F.lit(0))).cast("int")
    blocks = blocks.withColumns({
        "fn_no": one(F.col("kind") == "footnote").over(before).cast("int"),
        "title_no": F.when(is_title, one(is_title).over(before)).cast("int"),
    }).withColumns({"first": place(F.col("n_kids")), "title_first": place(F.when(F.col("in_title") | is_title, F.col("n_kids")).otherwise(0))})

    fields = ["path", "slot", "live", "in_title", "top", "ir", "ce", *[n for n, _ in ATTRS], "n_kids", "fn_no", "title_no", "first", "title_first"]
    own = F.collect_list(F.when(F.col("path").isNotNull(), F.struct(*fields)))
    by_level = blocks.groupBy("doc_id", "doc", "depth").agg(F.array_sort(own).alias("blocks"))
    by_doc = by_level.groupBy("doc_id", "doc").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("up"), "blocks"))).alias("levels"))
    text = _let(_repeats(F.col("levels")), lambda again: _let(
        _document(F.col("levels"), again, drop_bibliography), lambda top: F.concat(
            F.array_join(F.transform(F.filter(top, lambda k: k["live"]), lambda k: k["md"]), ""),
            _let(F.flatten(F.transform(top, lambda k: k["notes"])), lambda notes: F.when(
                F.size(notes) > 0, F.concat(F.lit("\n\n"), F.array_join(notes, "\n"))).otherwise(F.lit(""))))))
    return by_doc.select("doc_id", F.coalesce(text, F.lit("")).alias("markdown"))
