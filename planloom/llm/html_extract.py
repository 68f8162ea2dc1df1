"""Main text of web pages: structure first, then nearest-URL page differencing.

A page becomes lines, one per block, in page order.  A line is *chrome* (inside a
menu, footer, sidebar, form, notice, advert, comment list, script ...), *article*
(inside ``article`` or ``main``) or *open* (neither).  Then pages are differenced:

1. Within a host, distinct pages are put in order of their URL path and each is
   paired with the neighbour whose path has the longer common start.
2. All lines of a pair, chrome and article too, are aligned by a longest common subsequence.
3. Shared lines are deleted, except within an article: a passage that two articles
   share is theirs.  If the two share nearly all their text (``COPY_SHARE``), they are either
   mostly template or copies of each other: then the neighbour on the other side (at the
   end of a host, the partner's) decides, and the lines go that it shares too.

The markup settles what differencing can't: what is left of chrome (lines no other page has) goes,
and if the page has an article, its text is the article lines, else the open lines.
``differenced`` tells how many lines differencing deletes.

Differencing moves hashes of lines only.  The order within a host comes from range
partitions plus the ends of each partition, so a host with a large part of all
pages is spread over many tasks.  The deleted lines, few in practice, return to
the pages by a join that is broadcast only when they are counted to be few.

Defined cases: null or empty html has no text; a null url is a host of its own;
copies of a page share its result; repeated rows give repeated results; an empty
table gives an empty result; other columns are ignored; an element that is
never closed does not hide the rest of the page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planloom.llm.tables import settled

COPY_SHARE = 0.8
BROADCAST_ROWS = 200_000

# Element names by role, and words that name chrome in class, id and role.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math", "canvas", "select", "object", "audio", "video")
CHROME = frozenset("aside button datalist dialog fieldset footer form head menu nav search".split())
ARTICLE = frozenset("article main".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus "
    "footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related replies respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)

#: A page's header is chrome, an article's holds its title.
PAGE_WORDS = CHROME_WORDS | {"header", "topbar"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I) for name in RAW}
_ARTICLE_AREA, _OPEN_AREA, _CHROME_AREA = 2, 1, 0


def _names_chrome(attributes: str, words: frozenset[str]) -> bool:
    for match in _NAMES.finditer(attributes):
        if not words.isdisjoint(_WORD.findall((match[1] or match[2] or match[3] or "").lower())):
            return True
    return False


def page_lines(page: str) -> list[tuple[int, str]]:
    """The page's lines as (area, text), chrome included."""
    lines: list[tuple[int, str]] = []
    parts: list[str] = []
    hidden: list[str] = []
    stack: list[tuple[str, int]] = []
    area, at, lower = _OPEN_AREA, 0, None
    shown = area
    unclosed: set[str] = set()

    def flush() -> None:
        # chrome within a line is a line of its own
        for held, where in ((parts, shown), (hidden, _CHROME_AREA)):
            text = " ".join("".join(held).split()) if held else ""
            if text:
                lines.append((where, text))
            held.clear()

    def say(raw: str) -> None:
        nonlocal shown
        if raw:
            if area != _CHROME_AREA:
                shown = area
            (parts if area != _CHROME_AREA else hidden).append(html.unescape(raw) if "&" in raw else raw)

    while True:
        token = _TOKEN.search(page, at)
        say(page[at : token.start() if token else len(page)])
        if not token:
            break
        at = token.end()
        name = (token[2] or "").lower()
        if not name:
            continue
        if not token[1] and name in RAW:
            # scripts and styles run to the end of the page, as in browsers; others are empty
            to_end = name in ("script", "style")
            if to_end or not (name in unclosed or token[3].rstrip().endswith("/")):
                end = _RAW_END[name].search(page, at)
                if end[0] or to_end:
                    at = end.end()
                else:
                    unclosed.add(name)
            continue
        if name == "br":
            say(" ")
            continue
        if name in BLOCKS:
            flush()
        if token[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    area = stack[i][1]
                    del stack[i:]
                    break
        elif name not in VOID and not token[3].rstrip().endswith("/"):
            new = area
            if area != _CHROME_AREA:
                hides = name in CHROME or (name == "header" and area != _ARTICLE_AREA) or (name not in ("html", "body") and token[3] and _names_chrome(token[3], CHROME_WORDS if area == _ARTICLE_AREA else PAGE_WORDS))
                if hides:
                    lower = page.lower() if lower is None else lower
                    if lower.find(f"</{name}", at) >= 0:
                        new = _CHROME_AREA
                elif name in ARTICLE:
                    new = _ARTICLE_AREA
            if name == "p":  # a paragraph ends the one before it
                while stack and stack[-1][0] in ("p", "b", "i", "em", "strong", "a", "span", "font", "u"):
                    area_before = stack.pop()[1]
                    new = area_before if new != _CHROME_AREA and area != _CHROME_AREA else new
            stack.append((name, area))
            area = new
    flush()
    return lines


def main_text(page: str | None, deleted: Iterable[int] = ()) -> str:
    """The text of one page; ``deleted`` are numbers of lines that differencing removes."""
    lines = page_lines(page or "")
    gone = set(deleted)
    has_article = any(area == _ARTICLE_AREA for area, _ in lines)
    wanted = _ARTICLE_AREA if has_article else _OPEN_AREA
    return "\n".join(text for i, (area, text) in enumerate(lines) if area == wanted and i not in gone)


def deletable(areas: list[int], sizes: list[int], mine: list[int], others: list[int], beyond: list[int] | None) -> list[int]:
    """Places of the lines that differencing deletes: shared with the nearest page, not of an article."""
    shared = shared_lines(mine, others)
    if sum(sizes[i] for i in shared if areas[i] != _CHROME_AREA) > COPY_SHARE * sum(n for a, n in zip(areas, sizes, strict=True) if a != _CHROME_AREA):
        both = set(shared_lines(mine, beyond)) if beyond is not None else ()
        shared = [i for i in shared if i in both or areas[i] == _CHROME_AREA]
    return [i for i in shared if areas[i] != _ARTICLE_AREA]


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of both."""
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    places: dict[int, list[int]] = {}
    for j in range(len(b) - end - 1, start - 1, -1):
        places.setdefault(b[j], []).append(j)
    tails: list[int] = []
    chain: list[tuple[int, tuple | None]] = []
    for i in range(start, len(a) - end):
        for j in places.get(a[i], ()):
            k = bisect_left(tails, j)
            link = (i, chain[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                chain.append(link)
            else:
                tails[k], chain[k] = j, link
    middle = []
    link = chain[-1] if chain else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(start), *reversed(middle), *range(len(a) - end, len(a))]


def _place(url: str | None) -> tuple[str | None, str]:
    try:
        parts = urlsplit(url or "")
        host = (parts.netloc or "").lower().rpartition("@")[2]
        return (host if url is not None else None), parts.path
    except ValueError:
        return url, ""


def deleted_lines(pages: DataFrame, html_col: str, url_col: str) -> DataFrame:
    """Rows (row_key, deleted, n_lines, n_deleted): the lines of each page that differencing deletes; ``deleted`` are those that are no chrome."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hosts, paths, hashes, areas, sizes = [], [], [], [], [], []
            for key, url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = page_lines(page or "")
                host, path = _place(url)
                keys.append(key)
                hosts.append(host)
                paths.append(path)
                hashes.append([xxhash.xxh64_intdigest(t) - (1 << 63) for _, t in lines])
                areas.append([area for area, _ in lines])
                sizes.append([len(t) for _, t in lines])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(hashes, pa.list_(pa.int64())), pa.array(areas, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))], names=["row_key", "host", "path", "hashes", "areas", "sizes"])

    parsed = settled(pages.select("row_key", url_col, html_col).mapInArrow(parse, "row_key bigint, host string, path string, hashes array<bigint>, areas array<int>, sizes array<int>"))
    content = F.xxhash64("hashes").alias("content")
    # copies within a host stand as one page, under their first path
    distinct = parsed.groupBy("host", content).agg(F.min(F.struct("path", "row_key")).alias("m")).select("host", "content", "m.path", F.col("m.row_key").alias("row_key"))
    order = ["host", "path", "row_key"]
    ranged = settled(distinct.repartitionByRange(*order).withColumn("share", F.spark_partition_id()))
    place = F.struct("host", "path", "row_key")
    near = Window.partitionBy("share").orderBy(*order)
    rows = ranged.withColumn("before", F.lag(place).over(near)).withColumn("after", F.lead(place).over(near))
    ends = ranged.groupBy("share").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    along = Window.partitionBy(F.lit(0)).orderBy("share")  # one row per partition
    ends = ends.select("share", F.lag("last").over(along).alias("last_before"), F.lead("first").over(along).alias("first_after"))
    rows = rows.join(F.broadcast(ends), "share").withColumn("before", F.coalesce("before", "last_before")).withColumn("after", F.coalesce("after", "first_after"))

    def common(side: str):
        # length of the common start of both paths, -1 for another host or none
        same = F.expr(f"aggregate(sequence(1, least(length(path), length({side}.path))), struct(0 AS n, true AS go), (s, i) -> struct(if(s.go AND substr(path, i, 1) = substr({side}.path, i, 1), i, s.n) AS n, s.go AND substr(path, i, 1) = substr({side}.path, i, 1) AS go), s -> s.n)")
        usable = F.col(side).isNotNull() & F.col(f"{side}.host").eqNullSafe(F.col("host"))
        return F.when(usable, F.when((F.length("path") > 0) & (F.length(f"{side}.path") > 0), same).otherwise(F.lit(0))).otherwise(F.lit(-1))

    rows = rows.withColumn("c_before", common("before")).withColumn("c_after", common("after")).where("c_before >= 0 OR c_after >= 0")
    nearer = F.col("c_after") > F.col("c_before")
    partner = F.when(nearer, F.col("after.row_key")).otherwise(F.col("before.row_key"))
    # whoever else is next to the page, or to its partner
    side = {x: F.when(F.col(f"c_{x}") >= 0, F.col(f"{x}.row_key")) for x in ("before", "after")}
    rows = rows.select("row_key", F.col("host").alias("p_host"), F.col("content").alias("p_content"), partner.alias("partner"), F.when(nearer, side["before"]).otherwise(side["after"]).alias("across"), *(c.alias(x) for x, c in side.items()))
    around = rows.select(F.col("row_key").alias("partner"), F.col("before").alias("b"), F.col("after").alias("a"))
    pairs = rows.drop("before", "after").join(around, "partner", "left")
    other = F.coalesce("across", F.when(F.col("b") != F.col("row_key"), F.col("b")), F.when(F.col("a") != F.col("row_key"), F.col("a")))
    pairs = pairs.select("p_host", "p_content", "partner", other.alias("other"))
    own = parsed.where("size(hashes) > 0").withColumn("content", content)
    met = own.join(pairs, F.col("host").eqNullSafe(F.col("p_host")) & (F.col("content") == F.col("p_content")))
    lines = distinct.select("row_key").join(parsed.select("row_key", "hashes"), "row_key").dropDuplicates(["row_key"])
    met = met.join(lines.select(F.col("row_key").alias("partner"), F.col("hashes").alias("others")), "partner")
    met = met.join(lines.select(F.col("row_key").alias("other"), F.col("hashes").alias("beyond")), "other", "left").select("row_key", "areas", "sizes", "hashes", "others", "beyond")

    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, gone, counts, deleted = [], [], [], []
            for key, areas, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = deletable(areas, *rest)
                if found:
                    keys.append(key)
                    gone.append([i for i in found if areas[i] == _OPEN_AREA])
                    counts.append(len(areas))
                    deleted.append(len(found))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(gone, pa.list_(pa.int32())), pa.array(counts, pa.int32()), pa.array(deleted, pa.int32())], names=["row_key", "deleted", "n_lines", "n_deleted"])

    return met.mapInArrow(align, "row_key bigint, deleted array<int>, n_lines int, n_deleted int").dropDuplicates(["row_key"])


def _keyed(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return df.select(F.col(id_col), F.col(url_col), F.col(html_col), F.xxhash64(id_col, url_col, html_col).alias("row_key"))


def differenced(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (id, n_lines, n_deleted) of the pages of which differencing deletes lines, chrome or not."""
    pages = _keyed(df, id_col, url_col, html_col)
    return pages.select(id_col, "row_key").join(deleted_lines(pages, html_col, url_col), "row_key").select(id_col, "n_lines", "n_deleted")


def extract(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (id, url, text, n_chars), one per page."""
    pages = _keyed(df, id_col, url_col, html_col)
    # chrome goes by the markup in any case: only other deletions return to the pages
    deleted = settled(deleted_lines(pages, html_col, url_col).where("size(deleted) > 0").select("row_key", "deleted"))
    deleted = F.broadcast(deleted) if deleted.count() <= BROADCAST_ROWS else deleted.hint("merge")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page, gone or ()) for page, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = pages.join(deleted, "row_key", "left").select(id_col, url_col, html_col, "deleted")
    return rows.mapInArrow(texts, f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars bigint").withColumnsRenamed({"id": id_col, "url": url_col})
