import hashlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from papersift.llm import chat, html_text
from tests.llm.helpers import prose

TURNS = "conv_id long, turn long, role string, text string, formatted string"
TEXTS = st.text(max_size=12) | st.text(alphabet="<|s>/\\[INST]turnend é", max_size=24) | st.sampled_from([c.decode() for c in chat.CONTROLS] + ["\\", "\\\\<|end|>", "<|turn|>user<|text|>"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS), min_size=1, max_size=6))
def test_round_trip(turns):
    clean = [(a.encode("utf-8", "replace").decode(), b.encode("utf-8", "replace").decode()) for a, b in turns]
    made, start, end = chat.assemble(pa.array([a for a, _ in clean]), pa.array([b for _, b in clean]))
    for (role, text), own, a, b in zip(clean, made.to_pylist(), start, end):
        raw = own.encode()
        assert chat.parse(raw) == (role.encode(), text.encode())
        assert chat.unescaped(raw[a:b]).decode() == text
        inside = raw[len(chat.TURN) : a - len(chat.TEXT)], raw[a:b]
        assert not any(c in part for c in chat.CONTROLS for part in inside)


def digest(turns):
    text = "".join(t for r, t in turns if r == "assistant")
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(text), hashlib.sha256(text.encode()).hexdigest()


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "é\\<|end|>"), (2, 1, "assistant", None), (2, 0, None, "x"),
            (3, 0, "user", "same"), (3, 0, "user", "same"), (3, 0, "assistant", "tie"), (None, 5, "user", "no id"), (4, None, "user", "no turn"), (4, 0, "tool", "a" * 100_000)]
    table = spark.createDataFrame([(*r, None) for r in rows], TURNS)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.format_turns(table.repartition(4))).collect()}
    assert got == {
        1: digest([("user", "hi"), ("assistant", "</s>[INST] ok [/INST]"), ("assistant", "é\\<|end|>")]),
        2: digest([("", "x"), ("assistant", "")]),
        3: digest([("assistant", "tie"), ("user", "same"), ("user", "same")]),
        4: digest([("user", "no turn"), ("tool", "a" * 100_000)]),
        None: digest([("user", "no id")]),
    }


def test_long_conversation_streams(spark):
    turns = [(k, "assistant" if k % 2 else "user", prose(k, 5)) for k in range(5000)]
    table = spark.createDataFrame([(9, k, r, t, None) for k, r, t in turns], TURNS).repartition(6)
    row = chat.read_back(chat.format_turns(table)).first()
    assert tuple(row)[1:5] == digest([(r, t) for _, r, t in turns])


def test_no_turns(spark):
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], TURNS))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy</div><aside>More</aside><article><header><h1>Title &amp; more</h1></header><p>First&nbsp;para <b>bold</b>
 line<br>two<p>Second &lt;p&gt; &#233; &am</p><form><input><p>Mail</p></form><ul><li>One<li>Two</ul><!-- c --><div id="comments"><p>Nice!</p></div></article>
<footer>&copy; site</footer></body></html>"""
PAGES = "page_id long, url string, html string, text string"


def test_article_blocks():
    assert [t for _, t in html_text.blocks(PAGE)] == ["Title & more", "First para bold line two", "Second <p> é &am", "One", "Two"]
    assert html_text.blocks("") == [] and html_text.blocks("plain & simple") == [(html_text.OPEN, "plain & simple")]
    assert html_text.blocks("<article><p>open end") == [(html_text.ARTICLE, "open end")]
    assert html_text.blocks("<div><p>a</div><script>x") == [(html_text.OPEN, "a")]


def page(k, body):
    return f"<body><div>Welcome to our little site about everything you like</div>{body}<div>All rights reserved by the owner {k % 1}</div></body>"


def expected(n):
    return {k: prose(100 + k, 30) for k in range(n)}


def run(spark, rows):
    return {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.main_text(spark.createDataFrame([(*r, None) for r in rows], PAGES).repartition(4)).collect()}


def test_host_boilerplate(spark, monkeypatch):
    want = expected(12)
    rows = [(k, f"https://a.example/{k}", page(k, f"<p>{t}</p>")) for k, t in want.items()] + [(50, "https://b.example/", page(0, "<p>alone here</p>")), (51, None, None), (52, "odd", "")]
    for shard in (400_000, 60):  # one shard, and many
        monkeypatch.setattr(html_text, "SHARD_TOKENS", shard)
        got = run(spark, rows)
        for k, t in want.items():
            assert got[(k, f"https://a.example/{k}")] == (t, len(t))
        # on a host of its own nothing repeats
        assert got[(50, "https://b.example/")][0].startswith("Welcome to our little site") and got[(51, None)] == ("", 0) and got[(52, "odd")] == ("", 0)


def brute_kept(pages):
    """Unique runs of open blocks by comparing all windows of all pages of a host."""
    need = lambda w: [(k, tuple(w[k : k + html_text.RUN])) for k in range(len(w) - html_text.RUN + 1)] if len(w) >= html_text.RUN else [(0, (*w, None))]
    seen = {}
    for i, blocks in pages.items():
        for b in blocks:
            for _, run in need(b.split(" ")):
                seen.setdefault(run, set()).add(i)
    out = {}
    for i, blocks in pages.items():
        kept = []
        for b in blocks:
            w = b.split(" ")
            covered = {x for k, run in need(w) if len(seen[run]) > 1 for x in range(k, k + html_text.RUN)}
            left = " ".join(x for k, x in enumerate(w) if k not in covered)
            kept += [left] if left else []
        out[i] = "\n\n".join(kept)
    return out


def test_suffix_array_against_all_windows(spark, monkeypatch):
    import random

    r = random.Random(4)
    pages = {k: [" ".join(r.choice("abcd") for _ in range(r.randint(1, 14))) for _ in range(r.randint(1, 4))] for k in range(40)}
    rows = [(k, "http://h.example/x", "".join(f"<p>{b}</p>" for b in blocks)) for k, blocks in pages.items()]
    for shard in (400_000, 50):
        monkeypatch.setattr(html_text, "SHARD_TOKENS", shard)
        assert {k: t for (k, _), (t, _) in run(spark, rows).items()} == brute_kept(pages)


def test_no_pages(spark):
    assert html_text.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_prose_on_a_large_host_stays_whole(spark, monkeypatch):
    """2,000 pages without article: common phrases, and a passage that three pages quote, are no boilerplate."""
    import random

    r = random.Random(12)
    phrases, quote, menu = [prose(2000 + k, 8) for k in range(150)], prose(3000, 40), prose(3001, 25)
    bodies = {k: [" ".join(r.sample(phrases, 4) + [prose(4000 + k, 6)]) for _ in range(3)] + ([quote] if k in (3, 700, 1900) else []) for k in range(2000)}
    rows = [(k, f"http://big.example/{k}", f"<div>Home and search</div><div>{menu}</div>" + "".join(f"<p>{b}</p>" for b in body)) for k, body in bodies.items()]
    for shard in (400_000, 20_000):
        monkeypatch.setattr(html_text, "SHARD_TOKENS", shard)
        got = run(spark, rows)
        assert {k: got[k, f"http://big.example/{k}"][0] for k in bodies} == {k: "\n\n".join(body) for k, body in bodies.items()}


def test_long_tags_are_read_once():
    import time

    began = time.time()
    for page, text in [("<p>x</p><" + "a" * 1_000_000, "x"), ("<p>x</p>" + "<a " * 500_000, "x"), ("<p>x</p>" + "<!" * 500_000, "x")]:
        assert html_text.blocks(page)[0][1] == text
    assert time.time() - began < 20


def test_article_inside_frames():
    texts = lambda page: [t for _, t in html_text.blocks(page)]
    assert texts('<div class="with-sidebar"><article><p>a</p></article></div>') == ["a"]
    assert texts("<form><p>name</p><article>b</article></form>") == ["b"]
    assert texts('<div class="page-header-fixed nav-open"><main>m</main></div>') == ["m"]
    assert texts('<article><header class="entry-header"><h1>T</h1></header><p>c</p><div class="post-comments">no</div></article>') == ["T", "c"]
    assert texts('<nav><article>no</article></nav><div class="related"><article>no</article></div><div hidden><main>no</main></div><div class="ad">no</div>') == []
    assert texts('<div class="site-footer">no</div><div class="main-nav">no</div><div class="cookie-banner">no</div>') == []
