"""Main text of web pages: structure first, then a suffix array per host.

A page becomes a stream of text blocks. Scripts, styles, forms and comments are left out. Blocks of elements that name
themselves menus, headers, footers, asides, notices, adverts or reader comments are in the stream, but never in the text. If a
page has an article element (or main), its blocks are the text: they are kept though other pages may hold them, since true
paragraphs recur too. Where a page has neither, what the structure doesn't settle is settled by repetition. The whole streams of all pages of
a host, settled or not, are concatenated as block IDs (an article's blocks have IDs of their own, so an article's paragraph is never
a reason to drop a block elsewhere), a suffix array is built by prefix doubling, and every run of blocks that a different page of the host holds
as well (common prefix of neighbours with different pages) is boilerplate, be it that page's menu; runs of one page stay.

A host may hold a third of all pages, so streams are first made distinct with their number of pages summed before
the shuffle, and hosts are split into groups of about GROUP streams, or fewer long ones, by hash. Groups only bound memory: each one reports
its blocks outside articles and whether they repeat within it, and a block that repeats in a group or occurs in two groups of a host
repeats in the host (a run of one block is enough). It goes from all of the host's unsettled pages.

Null html is an empty text. Pages without a host share the empty host. Repeated rows and equal ids are
pages of their own, but the same html under one url counts as one page. Broken and unclosed markup is read as far as
it goes: paragraphs and items that need no end tag end at the next one, a quote that nothing closes ends with its tag, and an unfinished
tag at the end is dropped. Equal blocks of a page are blocks of their own. An empty table gives an empty result; other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import small_batches, stored

GROUP = 500
LONG = 40  # blocks a stream, on the whole, from which on a group takes fewer
SHORTEST = 1

#: Element names by their part in a page.
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "select", "textarea", "button", "form", "head", "title"}
ASIDE = {"nav", "header", "footer", "aside", "dialog", "menu"}
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "table", "tr", "td", "th", "caption", "blockquote", "pre", "section", "article", "main", "figure", "figcaption", "address", "hr", "body", "html", "thead", "tbody", "tfoot", "details", "summary", "fieldset", *ASIDE}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
MARKS = re.compile(r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|side|footer|masthead|cookies?|consent|notice|newsletter|subscribe|signup|popup|modal|comments?|disqus|respond|replies|share|sharing|social|related|recommended|widget|toolbar|copyright)(?:$|[\s_-])")
#: The last form is of a tag with a quote that nothing closes.
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"""(?i)\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
SPACE = re.compile(r"\s+")
INLINE = {"span", "a", "b", "i", "em", "strong", "small", "u", "font", "label", "ins"}
#: Elements that another one of these ends, and those that end a paragraph: all blocks.
ITEMS = ({"li"}, {"dt", "dd"}, {"td", "th"}, {"tr"})
KEPT = {"body", "html", "article", "main"}


def stream_of(page: str) -> tuple[list[str], list[bool], bool]:
    """All text blocks in the order of their ends, which of them structure leaves in the text, and whether an article or main element settles that."""
    blocks: list[tuple[str, int, bool]] = []
    text: list[str] = []
    aside: list[str] = []  # text of what is left out, but for forms and the like
    stack: list[tuple[str, bool]] = []  # open elements that matter, and whether they are left out
    hidden = silent = inside = 0
    at, end = 0, len(page)

    def close():
        parts = aside if hidden else text
        joined = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if joined:
            blocks.append((joined, inside, not hidden))

    def leave():
        nonlocal hidden, silent, inside
        name, out = stack.pop()
        if out and hidden == 1:
            close()
        hidden -= out
        silent -= name in SILENT
        inside -= name in ("article", "main") and not hidden and not out and inside > 0

    while at < end:
        m = TOKEN.search(page, at)
        if not hidden:
            text.append(page[at : m.start() if m else end])
        elif not silent:
            aside.append(page[at : m.start() if m else end])
        if not m:
            break
        at = m.end()
        ending, name, rest = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        name = (name or "").lower()
        if not name:
            continue
        if not ending:
            if name in BLOCKS:
                close()
            elif name == "br":
                (aside if hidden else text).append(" ")
            if name in ("script", "style", "textarea", "title", "noscript", "template", "svg", "iframe"):
                over = re.compile(rf"</{name}\s*[^>]*(?:>|$)", re.I).search(page, at)
                at = over.end() if over else end
                continue
            # What needs no end tag ends here: a paragraph and what is open in it, or the item before this one.
            peers = next((x for x in ITEMS if name in x), ())
            while stack and name in BLOCKS and (stack[-1][0] in INLINE or stack[-1][0] == "p" or stack[-1][0] in peers):
                leave()
            if name in VOID or rest.endswith("/"):
                continue
            marked = any(MARKS.search(v.strip("\"'")) for v in ATTRIBUTE.findall(rest)) if rest else False
            out = name in SILENT or (name in ASIDE and not (name == "header" and inside)) or (marked and name not in KEPT)
            if out or name in ("article", "main", "div", "section", "ul", "ol", "li", "table", "span", "a", *SILENT, *ASIDE):
                stack.append((name, out))
                hidden += out
                silent += name in SILENT
                inside += name in ("article", "main") and not hidden
        else:
            if name in BLOCKS:
                close()
            if any(n == name for n, _ in stack):
                while stack[-1][0] != name:
                    leave()
                leave()
    close()
    settled = any(i for _, i, seen in blocks if seen)
    return [b for b, _, _ in blocks], [seen and (i > 0 or not settled) for _, i, seen in blocks], settled


def blocks_of(page: str) -> tuple[list[str], bool]:
    """Text blocks that structure leaves in the text, in page order, and whether an article or main element settles them."""
    blocks, kept, settled = stream_of(page)
    return [b for b, k in zip(blocks, kept, strict=True) if k], settled


def block_id(block: Column, article: Column) -> Column:
    """63 bits of hash: the last one tells blocks of an article from others."""
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(block), 2), 1) + article.cast("long")


def page_blocks(pages: DataFrame, html: str) -> DataFrame:
    """pages with __blocks (what structure leaves), __settled, and __stream: IDs of all blocks."""
    at = pages.columns.index(html)
    kept = [c for i, c in enumerate(pages.columns) if i != at]

    def run(batches):
        for batch in batches:
            made = [stream_of(t or "") for t in batch.column(at).to_pylist()]
            rest = [batch.column(i) for i in range(len(kept) + 1) if i != at]
            new = [pa.array([b for b, _, _ in made], pa.list_(pa.string())), pa.array([k for _, k, _ in made], pa.list_(pa.bool_())), pa.array([s for _, _, s in made], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*rest, *new], names=[*kept, "__all", "__kept", "__settled"])

    small_batches(pages.sparkSession)
    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept] + ["__all array<string>", "__kept array<boolean>", "__settled boolean"])
    blocks = F.filter("__all", lambda b, i: F.get("__kept", i)).alias("__blocks")
    stream = F.transform("__all", lambda b, i: block_id(b, F.col("__settled") & F.get("__kept", i))).alias("__stream")
    return pages.mapInArrow(run, schema).select(*(f"`{c}`" for c in kept), blocks, "__settled", stream)


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by prefix doubling, and the common prefix length of each suffix with the one before it, from the ranks of all rounds."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
    while True:
        rank, step = ranks[-1], 1 << len(ranks) - 1
        second = np.full(n, -1, np.int64)
        second[: n - step] = rank[step:]
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        if new.max() == n - 1 or 2 * step >= n:
            break
        ranks.append(new)
    lcp, i, j = np.zeros(n - 1, np.int64), order[1:], order[:-1]
    for level in range(len(ranks) - 1, -1, -1):
        size, rank = 1 << level, ranks[level]
        fits = np.maximum(i, j) + lcp + size <= n
        lcp += size * (fits & (rank[np.minimum(i + lcp, n - 1)] == rank[np.minimum(j + lcp, n - 1)]))
    return order, np.concatenate([[0], lcp])


def repeated_blocks(sequences: list[list[int]], pages: list[int], shortest: int = SHORTEST) -> set[int]:
    """Block IDs in runs of at least `shortest` blocks that different pages hold."""
    if not sequences:
        return set()
    ids, owner = [], []
    for k, s in enumerate(sequences):
        ids += [*s, -1 - k]  # a mark of its own ends each page
        owner += [k] * (len(s) + 1)
    ids, owner = np.array(ids, np.int64), np.array(owner)
    order, lcp = suffix_array(ids)
    covered = np.zeros(len(ids) + 1, np.int64)
    both = 1 + np.flatnonzero((lcp[1:] >= shortest) & (owner[order[1:]] != owner[order[:-1]]))
    for at in (order[both], order[both - 1]):
        np.add.at(covered, at, 1)
        np.add.at(covered, at + lcp[both], -1)
    on = np.cumsum(covered)[:-1] > 0
    own = np.array([n > 1 for n in pages])[owner]  # a sequence of several pages repeats whole
    return set(ids[(on | own) & (ids >= 0)].tolist())


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars)."""
    spark = pages.sparkSession
    small_batches(spark)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.col(html).alias("html"))
    made = stored(page_blocks(rows, "html"), "blocks")
    # The streams of all pages, once for each url.
    streams = made.where("size(__stream) > 0").select("host", "url", F.col("__stream").alias("ids"))
    distinct = streams.distinct().groupBy("host", "ids").agg(F.count(F.lit(1)).alias("n"))
    sizes = distinct.groupBy("host").agg(F.greatest(F.count(F.lit(1)), F.sum(F.size("ids")) / LONG).alias("m"))
    grouped = distinct.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("ids"), F.ceil(F.col("m") / GROUP)))

    def run(group: pa.Table) -> pa.Table:
        sequences = group.column("ids").to_pylist()
        found = repeated_blocks(sequences, group.column("n").to_pylist())
        every = sorted(i for i in set().union(*sequences) if not i & 1)  # an article's blocks stay
        pages = [1 + (i in found) for i in every]  # 2: two at least
        return pa.table({"host": pa.array([group.column("host")[0].as_py()] * len(every), pa.string()), "id": pa.array(every, pa.int64()), "pages": pa.array(pages, pa.int64())})

    parts = grouped.select("host", "part", "ids", "n").groupBy("host", "part").applyInArrow(run, "host string, id long, pages long")
    common = stored(parts.groupBy("host", "id").agg(F.sum("pages").alias("pages")).where("pages > 1").select("host", "id"), "host-runs")
    blocks = made.where("NOT __settled").select("page_id", "url", "host", F.xxhash64("__blocks").alias("row"), F.posexplode("__blocks").alias("at", "block"))
    gone = blocks.withColumn("id", block_id(F.col("block"), F.lit(False))).join(common, ["host", "id"], "left_semi")
    gone = gone.groupBy(F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("row").alias("r")).agg(F.collect_set("at").alias("gone"))
    # Only pages that the structure doesn't settle meet the runs found; the others' texts are not moved.
    unsettled = made.where("NOT __settled")
    unsettled = unsettled.join(gone, unsettled.page_id.eqNullSafe(gone.p) & unsettled.url.eqNullSafe(gone.u) & (F.xxhash64("__blocks") == gone.r), "left")
    kept = F.when(F.col("gone").isNull(), F.col("__blocks")).otherwise(F.filter("__blocks", lambda b, i: ~F.array_contains("gone", i)))
    out = made.where("__settled").select("page_id", "url", "__blocks").union(unsettled.select("page_id", "url", kept))
    text = F.array_join("__blocks", "\n")
    return out.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
