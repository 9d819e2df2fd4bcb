"""Main text of web pages, with boilerplate found by a suffix array over each host's pages.

1. Parsing cuts a page into blocks and gives each a place by its own markup: ``article`` (inside an article or main
   element, whose own words are the page's content), ``chrome`` (menus, headers, footers, sidebars, notices, adverts,
   forms, comments, never content) or ``open`` (neither; markup does not tell).
2. The token streams of the open blocks of a host's pages are concatenated, a separator after each block, and a suffix
   array with its common prefixes shows every run of at least RUN tokens, or whole shorter block, that occurs on
   PAGES_SHARE of the host's distinct pages, and on two at least.  Covered words are boilerplate; the runs between them
   are kept.
3. A page's text is its article blocks and the uncovered runs of its open blocks, in page order.

Scale: a host's pages are dealt into shards of bounded size, so a host may hold any share of all pages; the pages that
shards count for a run are added up across shards by the hash of the run, so the result doesn't depend on the dealing.

Defined results: null or empty html gives an empty text; a null or odd url belongs to the host ''; repeated rows are
parsed row by row, and rows with the same page_id and url count as one page when runs are compared; an empty table gives no
rows.  Unclosed elements end with their parent; text cut inside a character reference stays as it is.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersift.llm.common import bounded_batches, column, stored

RUN = 20  # phrases of a few words recur on any large host
PAGES_SHARE = 0.05
SHARD_TOKENS = 400_000

# Element names and parts of class or id names, by what they hold.
RAW = frozenset("script style template noscript iframe svg math object textarea title".split())
CHROME = frozenset("nav footer aside button select menu dialog head".split())
FRAMES = frozenset("form header".split())
BLOCK = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset(["article", "main"])
_CHROME_NAMES = re.compile(r"ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|newsletter|notice|pagination|popup|promo\w*|related|replies|share|sharing|social|sponsor\w*|subscribe|toolbar")
# Names of page frames, which may also enclose the article.
_FRAME_NAMES = re.compile(r"header|masthead|menu|modal|nav\w*|sidebar|widget")
# First parts of a class name that says how the page looks, not what the element is.
_STATES = frozenset("with has no without is show hide content page layout".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
# possessive, so an unclosed tag is read once
_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_HOST = re.compile(r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
# Elements that an opening tag closes.
_CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"])}

ARTICLE, OPEN = 1, 2
#: Chrome, whatever it holds; a frame, whose article or main element is none.
DROPPED, FRAME = 0, -1


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found.group(1).lower() if found else ""


def _chrome(name: str, attributes: str, in_content: bool) -> int | None:
    """DROPPED or FRAME for an element that is chrome, else None."""
    if name in CHROME:
        return DROPPED
    if name == "header" and in_content:
        return None
    frame = FRAME if name in FRAMES else None
    if not attributes or name in ("body", "html", "article", "main"):
        return frame
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in _ROLES:
            return DROPPED
        if key not in ("class", "id"):
            continue
        for token in value.split():
            parts = re.split("[_-]+", token)
            if len(parts) > 1 and parts[0] in _STATES:
                continue
            # the first or the last part says what the element is: ad-slot, site-footer
            if _CHROME_NAMES.fullmatch(parts[0]) or _CHROME_NAMES.fullmatch(parts[-1]):
                return DROPPED
            if not in_content and (_FRAME_NAMES.fullmatch(parts[0]) or _FRAME_NAMES.fullmatch(parts[-1])):
                frame = FRAME
    return frame


def blocks(page: str) -> list[tuple[int, str]]:
    """(ARTICLE or OPEN, text) of the blocks that are not chrome, in page order."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # element, place of its content
    parts: list[str] = []
    place, at = OPEN, 0

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and place > 0:
                out.append((place, text))
            parts.clear()

    size, last = len(page), max(page.rfind(">"), page.rfind("<!--"))
    while at < size:
        tag = _TAG.search(page, at) if at <= last else None
        if tag is None:
            parts.append(page[at:])
            break
        parts.append(page[at : tag.start()])
        at, name = tag.end(), (tag.group(2) or "").lower()
        if not name:
            continue
        if name in RAW and not tag.group(1):
            if not tag.group(3).endswith("/"):
                closing = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = closing.end() if closing else size
            continue
        if name == "br":
            parts.append(" ")
            continue
        is_block = name in BLOCK
        if is_block:
            end_block()
        if tag.group(1):
            if any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
                place = stack[-1][1] if stack else OPEN
            continue
        if name in VOID or tag.group(3).endswith("/") and not is_block:
            continue
        while stack and stack[-1][0] in _CLOSES.get(name, ()):
            stack.pop()
        if name == "p":
            _close_paragraph(stack)
        place = stack[-1][1] if stack else OPEN
        if not is_block and not tag.group(3).strip():
            continue  # plain inline markup
        content = name in CONTENT or 'role="main"' in tag.group(3)
        if place == DROPPED or place == FRAME and not content:
            inside = place
        else:
            chrome = _chrome(name, tag.group(3), place == ARTICLE)
            inside = chrome if chrome is not None else ARTICLE if content else place
        if inside != place and not is_block:
            end_block()
        stack.append((name, inside))
        place = inside
    end_block()
    return out


def _close_paragraph(stack: list[tuple[str, int]]) -> None:
    """An opening p closes an open p that only inline elements follow."""
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] == "p":
            del stack[k:]
            return
        if stack[k][0] in BLOCK:
            return


PARSED = "row long, page_id long, url string, host string, places array<int>, texts array<string>"


def parsed(pages: DataFrame) -> DataFrame:
    """One row per page with its blocks; ``row`` tells repeated rows apart."""
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(x) for x in column(batch, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                column(batch, "row"), column(batch, "page_id"), column(batch, "url"), pa.array([host_of(u) for u in column(batch, "url").to_pylist()], pa.string()),
                pa.array([[p for p, _ in x] for x in found], pa.list_(pa.int32())), pa.array([[t for _, t in x] for x in found], pa.list_(pa.string())),
            ], names=["row", "page_id", "url", "host", "places", "texts"])

    return rows.mapInArrow(run, PARSED)


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, by doubling, and the common prefix of each with the one before, up to RUN tokens."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        order = np.lexsort((after, rank))
        pair = np.stack([rank[order], after[order]])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum((pair[:, 1:] != pair[:, :-1]).any(axis=0))]) if n else 0
        step *= 2
        if step >= RUN or not n or rank.max() == n - 1:
            break
    common = np.zeros(n, dtype=np.int64)
    still = np.ones(max(0, n - 1), dtype=bool)
    for k in range(RUN):  # neighbours whose first k tokens are equal
        a, b = order[:-1] + k, order[1:] + k
        inside = (a < n) & (b < n)
        still &= inside
        still[still] = tokens[a[still]] == tokens[b[still]]
        common[1:] += still
    return order, common


def _stream(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, page and need of each place: how long a run from there must be (RUN, or the whole of a shorter block).

    A block ends with a token of its own; a block shorter than RUN needs that token too, so only a whole block counts.
    """
    tokens, pages, need = [], [], []
    for number, (page, texts) in enumerate(rows):
        for text in texts:
            words = text.split(" ")
            n = len(words)
            tokens += [xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) for w in words] + [1]
            pages += [page] * (n + 1)
            need += ([RUN] * max(0, n - RUN + 1) + [0] * min(n, RUN - 1)) if n >= RUN else [n + 1] + [0] * (n - 1)
            need.append(0)
    return np.array(tokens, dtype=np.uint64), np.array(pages, dtype=np.int64), np.array(need, dtype=np.int64)


def _repeated(tokens: np.ndarray, pages: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place, the number of distinct pages that hold the run it needs, and a hash of that run."""
    order, common = suffix_array(tokens)
    found = np.zeros(len(tokens), dtype=np.int64)
    names, page = np.unique(pages, return_inverse=True)
    back = np.argsort(order)
    for length in np.unique(need[need > 0]).tolist():
        group = np.cumsum(common < length)[back]  # places whose next ``length`` tokens are equal
        wanted = np.flatnonzero(need == length)
        held = np.unique(group[wanted] * len(names) + page[wanted]) // len(names)
        found[wanted] = np.bincount(held, minlength=group.max() + 1)[group[wanted]]
    hashes = np.zeros(len(tokens), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(RUN + 1):
            use = np.flatnonzero(need > k)
            hashes[use] = hashes[use] * np.uint64(0x9E3779B97F4A7C15) + tokens[use + k]
    return found, hashes


RUNS = "row long, host string, shard long, place int, run long, pages long, needed long, repeated boolean"


def host_runs(open_blocks: DataFrame) -> DataFrame:
    """Places where a run starts: row, place (in the page's own open tokens), the shard's pages that hold the run, and
    whether these are enough.  A host of one shard has rows for runs on enough pages only."""
    tokens = F.aggregate("texts", F.lit(0), lambda n, t: n + F.size(F.split(t, " ")) + 1)
    sized = open_blocks.withColumn("tokens", tokens).withColumn("page", F.xxhash64("page_id", "url"))
    needed = F.greatest(F.lit(2), F.ceil(PAGES_SHARE * F.count_distinct("page"))).cast("long")
    shards = sized.groupBy("host").agg((1 + F.floor(F.sum("tokens") / SHARD_TOKENS)).cast("long").alias("shards"), needed.alias("needed"))
    # one row per host; AQE splits the join where a host holds a large share of the pages
    dealt = sized.join(shards, "host").select("row", "host", "shards", "needed", "texts", "page", F.pmod("page", F.col("shards")).alias("shard"))
    rows = dealt.repartition("host", "shard").sortWithinPartitions("host", "shard", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row, host, shards, needed, shard, page, texts in zip(*(column(batch, c).to_pylist() for c in ("row", "host", "shards", "needed", "shard", "page", "texts"))):
                if now is not None and now[:2] != (host, shard):
                    yield _runs_of(now, held)
                    held = []
                now = (host, shard, shards, needed)
                held.append((row, page, texts))
        if now is not None:
            yield _runs_of(now, held)

    return rows.mapInArrow(run, RUNS)


def _runs_of(shard: tuple, held: list[tuple]) -> pa.RecordBatch:
    host, number, shards, needed = shard
    tokens, pages, need = _stream([(page, texts) for _, page, texts in held])
    found, hashes = _repeated(tokens, pages, need)
    sizes = [sum(len(t.split(" ")) + 1 for t in texts) for _, _, texts in held]
    row = np.repeat(np.array([r for r, _, _ in held], dtype=np.int64), sizes)
    place = np.arange(len(tokens)) - np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
    # with several shards, what is on too few pages here may be on enough with those of another
    use = np.flatnonzero(found >= needed if shards == 1 else need > 0)
    n = len(use)
    return pa.RecordBatch.from_arrays([
        pa.array(row[use]), pa.array([host] * n, pa.string()), pa.array(np.full(n, number, dtype=np.int64)), pa.array(place[use].astype(np.int32)),
        pa.array(hashes[use].view(np.int64)), pa.array(found[use]), pa.array(np.full(n, needed, dtype=np.int64)), pa.array(found[use] >= needed),
    ], names=["row", "host", "shard", "place", "run", "pages", "needed", "repeated"])


def _kept(places: list[int], texts: list[str], starts: list[int] | None) -> str:
    """The page's text: article blocks, and what no repeated run covers of the open ones."""
    if not starts:
        return "\n\n".join(texts)
    runs, at, out = set(starts), 0, []
    for place, text in zip(places, texts):
        if place == ARTICLE:
            out.append(text)
            continue
        words = text.split(" ")
        covered = np.zeros(len(words), dtype=bool)
        for k in range(len(words)):
            if at + k in runs:
                covered[k : k + RUN] = True
        at += len(words) + 1
        kept = " ".join(w for w, c in zip(words, covered) if not c)
        out += [kept] if kept else []
    return "\n\n".join(out)


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    bounded_batches(pages.sparkSession)
    table = stored(parsed(pages), "pages")
    own = F.transform(F.filter(F.arrays_zip("places", "texts"), lambda b: b["places"] == OPEN), lambda b: b["texts"])
    open_blocks = table.select("row", "page_id", "url", "host", own.alias("texts")).where(F.size("texts") > 0)
    runs = stored(host_runs(open_blocks), "host-runs")
    # a page lies in one shard, so the pages of a run's shards add up; hosts of one shard have repeated runs only
    counted = runs.groupBy("host", "run", "shard").agg(F.max("pages").alias("pages"), F.max("needed").alias("needed"))
    across = counted.groupBy("host", "run").agg(F.sum("pages").alias("pages"), F.max("needed").alias("needed")).where("pages >= needed").select("host", "run")
    more = runs.where("NOT repeated").join(across, ["host", "run"]).select("row", "place")
    starts = runs.where("repeated").select("row", "place").union(more).groupBy("row").agg(F.collect_list("place").alias("starts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_kept(*x) for x in zip(*(column(batch, c).to_pylist() for c in ("places", "texts", "starts")))]
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    wanted = ["page_id", "url", "places", "texts"]
    any_open = F.exists("places", lambda p: p == OPEN)
    # only pages whose markup leaves something open are joined; the others aren't shuffled
    whole = table.where(any_open).join(starts, "row", "left").select(*wanted, "starts")
    whole = whole.unionByName(table.where(~any_open).select(*wanted, F.lit(None).cast("array<int>").alias("starts")))
    return whole.mapInArrow(run, "page_id long, url string, text string, n_chars long")
