"""Main text of HTML pages: markup structure, and a host's repeated passages by suffix array.

A page is read into blocks. Each block is *main* (inside the article, or the element marked as the
main one), *chrome* (inside navigation, headers, footers, asides, forms, adverts, comments and the
like, as tags, roles, classes and ids tell), or *loose* (neither). Of every page, marked up or not,
the token streams of the loose and chrome blocks go through the host's suffix array: the streams of a
host's pages are concatenated, the array groups the suffixes that share their first RUN tokens (or a
whole shorter block), and groups on at least PAGES distinct pages are repeated passages; a longer
repeat is a chain of such groups. Pages of one host with equal text count as one page. Every page then
looks up its own runs among the repeated passages: covered runs are cut out of loose blocks, unique runs
stay, and ``n_covered`` counts the covered words outside the article. The markup is checked after that:
main blocks stay whole, as an article may quote what other pages also hold, and chrome goes, as menus
and adverts may differ from page to page.

Pages are dealt by host, so that one array holds a whole host. A host of more than HOST_PAGES pages is
dealt to several tasks and a long array is cut after ARRAY_WORDS words; as a page is in one array only,
such arrays pass on the number of pages of each group by a hash of its tokens, and the sums are what one
array over the whole host would give. The repeated passages lie as sorted hashes in the shared folder,
so no text crosses a shuffle but the blocks outside the articles, once.

Defined cases: a null html is empty and gives an empty text; broken markup is read as far as it goes
(unclosed elements end with their parent, an unclosed comment or script with the page); a null or odd
url is the host ''; repeated rows are pages of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.common import table
from mosaiq.llm.language_model import mix, part_of
from mosaiq.llm.store import Store
from mosaiq.plans.scratch import fresh_path, materialise
from mosaiq.plans.ship import ship

#: A repeated passage has so many tokens at least, on so many pages of its host.
RUN, PAGES = 8, 3
#: Pages of a host in one task, words of an array, and repeated passages in a file of the shared folder (of which there are FILES at least).
HOST_PAGES, ARRAY_WORDS, FILE_RUNS, FILES = 1000, 1_000_000, 2_000_000, 64

MAIN, LOOSE, CHROME = 2, 1, 0
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "canvas", "audio", "video", "head", "select"}
NOT_MAIN = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "label", "input", "option"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that end when one of these begins beside them.
ENDED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: Words in a class or id that mark chrome.
WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "aside", "banner", "breadcrumb", "breadcrumbs", "byline-share", "comment", "comments", "consent",
    "cookie", "cookies", "copyright", "disclaimer", "disqus", "dropdown", "footer", "gdpr", "header", "hidden", "login", "masthead", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notification", "overlay", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "reply",
    "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget",
}
#: Words that may stand beside them in a name; with any other word the name is an ordinary one (share-price, related-work).
BESIDE = {
    "area", "article", "articles", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "card", "cards", "col", "column", "container", "content", "fixed", "form", "global",
    "group", "icon", "icons", "inline", "inner", "item", "items", "js", "label", "left", "link", "links", "list", "main", "media", "mobile", "outer", "page", "panel", "policy", "post",
    "posts", "primary", "right", "row", "secondary", "section", "site", "slot", "stories", "story", "sub", "thread", "title", "to", "tools", "top", "unit", "up", "us", "wrap", "wrapper",
}
MAIN_WORDS = {"article-body", "article-content", "articlebody", "content-body", "entry-content", "main-content", "maincontent", "post-body", "post-content", "story-body"}
KEEPS = {"html", "body", "article", "main", *HEADINGS}

#: A quote opens a value right after the equals sign only; elsewhere it is a letter like others.
VALUE = r"""\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>={VALUE}|[^>=])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
PARTS = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")


def marks_chrome(name: str) -> bool:
    """Whether a class or id as a whole says so: one of WORDS, alone or with words and numbers that say nothing else."""
    parts = name.split("-")
    return name in WORDS or not WORDS.isdisjoint(parts) and all(w in WORDS or w in BESIDE or w[0].isdigit() for w in parts)


def kind_of(tag: str, raw: str, parent: int, in_main: bool) -> int:
    """What the blocks of an element are, given those of its parent."""
    if parent == CHROME:
        return CHROME
    chrome = tag in NOT_MAIN
    main = tag in ("article", "main")
    if raw and not raw.isspace():
        found = {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(raw)}
        if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
            return CHROME
        role = found.get("role", "")
        chrome |= role in ROLES
        main |= role == "main" or found.get("itemprop") == "articlebody"
        names = set(PARTS.findall(re.sub(r"_", "-", f"{found.get('class', '')} {found.get('id', '')}")))
        main |= bool(names & MAIN_WORDS)
        if names and tag not in KEEPS or tag == "article" and names & {"comment", "comments", "reply"}:
            chrome |= any(map(marks_chrome, names)) and not main or tag == "article"
    if chrome:
        return CHROME
    return MAIN if main or in_main else parent


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of a page's blocks in order, texts with white space made single blanks."""
    page = page or ""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("", LOOSE)]
    text: list[str] = []
    at, size = 0, len(page)

    def close() -> None:
        if text:
            joined = " ".join(_html.unescape("".join(text)).split())
            if joined:
                out.append((stack[-1][1], joined))
            text.clear()

    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                text.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                close()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    if any(t in BLOCK for t, _ in stack[depth:]) or stack[depth][1] != stack[depth - 1][1]:
                        close()
                    del stack[depth:]
                    break
                if stack[depth][0] in BLOCK and tag not in BLOCK:
                    break  # an inline end tag does not end a block around it
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>|<body\b" if tag == "head" else rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = size if end is None else end.start() if end[0].lower().startswith("<body") else end.end()
            text.append(" ")
            continue
        if tag in BLOCK:
            close()
            # p, li and the like end here, with the inline elements left open in them
            for depth in range(len(stack) - 1, 0, -1):
                if tag in ENDED_BY.get(stack[depth][0], ()):
                    del stack[depth:]
                    break
                if stack[depth][0] in BLOCK:
                    break
        elif tag in ("br", "wbr"):
            text.append(" " if tag == "br" else "")
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        parent = stack[-1][1]
        kind = kind_of(tag, m[3], parent, parent == MAIN)
        if tag == "header" and parent == MAIN:
            kind = LOOSE  # an article's own header: its headings are the article's
        if tag in HEADINGS and parent == LOOSE and any(k == MAIN for _, k in stack):
            kind = MAIN
        if kind != parent:
            close()
        stack.append((tag, kind))
    close()
    if any(k == MAIN for k, _ in out):
        return [(k if k == MAIN else CHROME, t) for k, t in out]
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower() if m else ""


def suffix_groups(tokens: np.ndarray, run: int = RUN) -> np.ndarray:
    """The group of each suffix of the concatenated streams: a suffix array sorted on the first ``run``
    tokens by doubling; equal groups share them."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    have = 1
    while have < run:
        step = min(have, run - have)
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        have += step
    return rank


def _streams(hosts: list[str], others: list[list[dict]], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, places where a run begins, their rows, their words' numbers in the page) of the blocks of parsed pages.

    The streams stand one after another, each block followed by ends, so no run crosses blocks. A run is
    ``run`` words of a block, or the whole of a shorter one. Tokens tell hosts apart.
    """
    kept: dict[str, int] = {}
    words, size, row, host = [], [], [], []
    digest = xxhash.xxh3_64_intdigest
    for r, (h, found) in enumerate(zip(hosts, others, strict=True)):
        own = digest(h)
        for x in found:
            some = x["t"].split(" ")
            for w in some:
                if w not in kept:
                    kept[w] = digest(w)
            words += [kept[w] for w in some]
            size.append(len(some))
            row.append(r)
            host.append(own)
    size, row, host = np.asarray(size, np.int64), np.asarray(row, np.int64), np.asarray(host, np.uint64)
    start = np.cumsum(size + run - 1) - (size + run - 1)
    token = np.zeros(int((size + run - 1).sum()), np.uint64)
    word = np.arange(int(size.sum()))  # over all blocks
    block = np.repeat(np.arange(len(size)), size)
    first = np.cumsum(size) - size
    within = word - first[block]
    token[start[block] + within] = mix(np.asarray(words, np.uint64) + mix(host)[block]) | np.uint64(1)  # an end is 0
    begins = (within + run <= size[block]) | (within == 0)
    page = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    page_first = np.maximum.accumulate(np.where(page, first, 0)) if len(row) else first
    block, within, word = block[begins], within[begins], word[begins]
    return token, start[block] + within, row[block], word - page_first[block]


def _grouped(hosts: list[str], others: list[list[dict]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a hash for each group of equal runs, group of each place, its row, its word's number in the page)."""
    token, at, row, word = _streams(hosts, others)
    groups = suffix_groups(token)[at]
    _, first, group = np.unique(groups, return_index=True, return_inverse=True)
    h = np.zeros(len(first), np.uint64)
    for k in range(RUN):  # one hash for a group, by which other tasks know it
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + token[at[first] + k]) if len(first) else h
    return h, group, row, word


def counted(hosts: list[str], others: list[list[dict]], cut: set[str]) -> pa.RecordBatch:
    """(hash, pages) of the groups of one array over distinct pages; of hosts that are whole, not in ``cut``, the repeated ones only."""
    hashes, of, row, _ = _grouped(hosts, others)
    pages = np.bincount(np.unique(of * len(hosts) + row) // max(len(hosts), 1), minlength=len(hashes))  # a page counts once for a group
    a_row = np.zeros(len(hashes), np.int64)
    a_row[of] = row
    keep = (pages >= PAGES) | np.asarray([h in cut for h in hosts], bool)[a_row]
    return pa.RecordBatch.from_arrays([pa.array(hashes[keep].view(np.int64)), pa.array(pages[keep].astype(np.int64))], names=["run", "pages"])


def repeated_runs(parsed: DataFrame) -> tuple[str, list[int]]:
    """Where the hashes of the hosts' repeated passages lie, sorted, and the number in each file."""
    spark = parsed.sparkSession

    def arrays(batches):
        hosts, others, cut, words = [], [], set(), 0
        for batch in batches:
            for host, shares, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shares > 1:
                    cut.add(host)
                if hosts and words >= (ARRAY_WORDS if host == hosts[-1] else ARRAY_WORDS // 4):
                    if host == hosts[-1]:
                        cut.add(host)
                    yield counted(hosts, others, cut)
                    hosts, others, words = [], [], 0
                hosts.append(host)
                others.append(other)
                words += sum(x["t"].count(" ") + 1 for x in other)
        if hosts:
            yield counted(hosts, others, cut)

    # at most one row for each HOST_PAGES pages
    large = parsed.groupBy("host").count().where(F.col("count") > HOST_PAGES).select("host", F.ceil(F.col("count") / HOST_PAGES).alias("shares"))
    once = parsed.select("host", "same", "other").dropDuplicates(["host", "same"]).join(F.broadcast(large), "host", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    dealt = once.repartition("host", F.pmod("same", "shares")).sortWithinPartitions("host")
    repeated = dealt.select("host", "shares", "other").mapInArrow(arrays, "run long, pages long").groupBy("run").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= PAGES)
    repeated = materialise(repeated.select("run"), "pages-repeated")
    uri, files = fresh_path(spark, "pages-runs"), max(FILES, -(-repeated.count() // FILE_RUNS))

    def ranges(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part_of(batch.column(0).to_numpy().view(np.uint64), files).astype(np.int32))], names=["run", "part"])

    def write(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        Store(uri).write(f"runs-{part}", np.sort(group["run"].to_numpy().view(np.uint64)))
        return pa.table({"part": pa.array([part], pa.int32()), "n": pa.array([group.num_rows], pa.int64())})

    sizes = {r["part"]: r["n"] for r in repeated.mapInArrow(ranges, "run long, part int").groupBy("part").applyInArrow(write, "part int, n long").collect()}  # one row per file
    return uri, [sizes.get(p, 0) for p in range(files)]


def among(hashes: np.ndarray, uri: str, sizes: list[int], kept: dict[int, np.ndarray]) -> np.ndarray:
    """Which hashes are repeated passages; ``kept`` holds the files opened so far."""
    order = np.argsort(hashes)
    asked, out = hashes[order], np.zeros(len(hashes), bool)
    cuts = np.searchsorted(part_of(asked, len(sizes)), np.arange(len(sizes) + 1))
    for p, n in enumerate(sizes):
        some = slice(cuts[p], cuts[p + 1])
        if n and some.start < some.stop:
            if p not in kept:
                kept[p] = Store(uri).array(f"runs-{p}", np.uint64, n)
            out[order[some]] = kept[p][np.minimum(np.searchsorted(kept[p], asked[some]), n - 1)] == asked[some]
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars, n_repeated: loose blocks removed for repetition, n_covered: words outside the article in repeated passages)."""
    ship(pages.sparkSession)
    asked = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = asked.schema["page_id"].dataType.simpleString()
    item = pa.struct([("t", pa.string()), ("loose", pa.bool_())])

    def parse(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            main, other, same = [], [], []
            for text in batch.column(2).to_pylist():
                found = blocks(text)
                main.append("\n".join(t for k, t in found if k == MAIN))
                other.append([{"t": t, "loose": k == LOOSE} for k, t in found if k != MAIN])
                same.append(xxhash.xxh3_64_intdigest("\n\n".join([main[-1], *(f"{x['loose']:d}{x['t']}" for x in other[-1])])))
            hosts = [host_of(u) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hosts), pa.array(np.asarray(same, np.uint64).view(np.int64)), pa.array(main), pa.array(other, pa.list_(item))],
                names=["page_id", "url", "host", "same", "main", "other"],
            )

    parsed = asked.mapInArrow(parse, f"page_id {kind}, url string, host string, same long, main string, other array<struct<t:string,loose:boolean>>")
    parsed = materialise(parsed, "pages-parsed")
    uri, sizes = repeated_runs(parsed)

    def finish(batches):
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            mains, others = batch.column("main").to_pylist(), batch.column("other").to_pylist()
            hashes, of, row, word = _grouped(batch.column("host").to_pylist(), others)
            again = among(hashes, uri, sizes, kept)[of]
            row, word = row[again], word[again]
            cuts = np.searchsorted(row, np.arange(len(mains) + 1))
            texts, dropped, covered = [], [], []
            for r, (main, found) in enumerate(zip(mains, others, strict=True)):
                sizes_of = [x["t"].count(" ") + 1 for x in found]
                ends = np.cumsum(sizes_of, dtype=np.int64)
                cover = np.zeros(sum(sizes_of), bool)
                for p in word[cuts[r] : cuts[r + 1]]:
                    cover[p : min(p + RUN, ends[np.searchsorted(ends, p, "right")])] = True
                left = [
                    " ".join(w for w, c in zip(x["t"].split(" "), cover[e - n : e], strict=True) if not c) if cover[e - n : e].any() else x["t"]
                    for x, e, n in zip(found, ends, sizes_of, strict=True) if x["loose"]
                ]
                texts.append("\n".join(t for t in [main, *left] if t))
                dropped.append(left.count(""))
                covered.append(int(cover.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(dropped, pa.int32()), pa.array(covered, pa.int32())],
                names=["page_id", "url", "text", "n_chars", "n_repeated", "n_covered"],
            )

    return parsed.select("page_id", "url", "host", "main", "other").mapInArrow(finish, f"page_id {kind}, url string, text string, n_chars long, n_repeated int, n_covered int")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "n_repeated", "n_covered")
