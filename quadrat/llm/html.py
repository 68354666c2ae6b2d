"""Main text of web pages by nearest-URL page differencing.

Every page is parsed into lines (its blocks of text). Pages of a host are sorted by URL path over range
partitions, so a large host spreads over many tasks, and each page is paired with the neighbour that shares
the longer path. Hashes of the two pages' lines, of all of them, are aligned by longest common subsequence
and shared lines are deleted. Marks then check the result both ways: lines of an article or main element
come back, so an article that two pages carry is not lost, and lines of boilerplate elements (menus,
headers, footers, sidebars, notices, adverts, forms, comments) go though the pages differ in them, as menus and adverts that are
made anew for each page do. Marked paragraphs inside an article, and all lines under no mark, are left to differencing.
A page that shares all its unmarked lines says nothing about them and keeps them.

Defined cases: null html or html without text gives an empty string; a null url is a page of the empty
host; rows equal in page_id, url and html are one page with the same result each; copies under other
ids or URLs are ordinary neighbours; an empty table gives an empty result; extra columns are ignored. Malformed html of any length is read in one scan:
a tag whose quotes run to the end of the page ends at its first ``>``, as do all tags behind it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.shared import staged
from quadrat.llm.urls import host_and_path

#: Elements whose content is no text, elements that are boilerplate, and block elements: fixed by HTML.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "select", "button", "head")
BOILERPLATE = {"nav", "footer", "aside", "form", "dialog", "menu", "fieldset", "header"}
MAIN = {"article", "main"}
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SPACE = set("br td th".split())
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|side|aside|widget|footer|foot|header|masthead|topbar|toolbar"
    r"|cookies?|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended"
    r"|comments?|commentlist|disqus|replies|reply|respond|pagination|pager|skip|search|searchbox|legal|copyright|disclaimer|hidden)(?:$|[\s_-])", re.I)
#: Of these, what holds no article of the page itself.
FIRM = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|nav\w*|menu\w*|sidebar|aside|widget|footer|cookies?|consent|popup|modal|related|recommended|comments?|commentlist|disqus|replies|reply|respond)(?:$|[\s_-])", re.I)
#: Names of a layout that has or lacks a part.
LAYOUT = re.compile(r"(?:^|(?<=[\s_-]))(?:with|has|no|without)[_-][^\s]*", re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
BODY = re.compile(r"<body[\s>]", re.I)
NAMED = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
END_OF = {name: re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I) for name in RAW}

#: No mark; article or main; boilerplate; boilerplate that an article may stand in; a marked paragraph of an article.
OPEN_, MAIN_, BOILER_, SOFT_, ASIDE_ = 0, 1, 2, 3, 4


def boilerplate(name: str, attributes: str, inside_main: bool) -> int:
    """BOILER_, SOFT_ or ASIDE_ if an element is boilerplate, else OPEN_."""
    if name in BOILERPLATE and not (name == "header" and inside_main):
        return SOFT_ if name in ("form", "fieldset") else BOILER_
    if not attributes or name in ("html", "body"):
        return OPEN_
    for key, *values in NAMED.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return BOILER_
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return BOILER_
        if key == "role" and value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"):
            return BOILER_
        if key in ("class", "id"):
            value = LAYOUT.sub("", value)
            if MARKED.search(value) and not (inside_main and re.search(r"header|head", value, re.I) and name in ("h1", "h2", "h3", "header", "hgroup")):
                if FIRM.search(value):
                    return BOILER_
                return ASIDE_ if inside_main and name == "p" else SOFT_
    return OPEN_


def page_lines(page: str | None) -> tuple[list[str], list[int]]:
    """The blocks of text of a page in order, with white space made single and references decoded; and their marks."""
    page = page or ""
    lines: list[str] = []
    marks: list[int] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []
    open_: dict[str, int] = {}
    mark, at, n = OPEN_, 0, len(page)
    last, last_data, quotes, in_head = page.rfind(">"), page.rfind("]]>"), True, False

    def flush() -> None:
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if line:
                lines.append(line)
                marks.append(mark)

    def pop() -> int:
        name, before = stack.pop()
        open_[name] -= 1
        return before

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text.append(page[at:])
            break
        if lt > at:
            text.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
            continue
        if lt > last:
            end = page.find("<!--", lt)
            text.append(page[lt : end if end >= 0 else n])
            break
        if page.startswith("<![CDATA[", lt) and last_data > lt:
            end = page.find("]]>", lt)
            text.append(page[lt + 9 : end])
            at = end + 3
            continue
        if page[lt + 1] in "!?":
            at = page.find(">", lt) + 1
            continue
        m = TAG.match(page, lt) if quotes else None
        if m is None:
            m = LOOSE.match(page, lt)
            quotes = quotes and m is None
        if m is None:
            text.append("<")
            at = lt + 1
            continue
        at = m.end()
        close, name, attributes = m.group(1), m.group(2).lower(), m.group(3)
        if name in END_OF and not close and not attributes.endswith("/") and not (name == "head" and in_head):
            end = END_OF[name].search(page, at)
            if name != "head":
                at = end.end() if end else n
                continue
            # an unclosed head ends at the body
            in_head = True
            body = BODY.search(page, at)
            stop = end if end and not (body and body.start() < end.start()) else body
            at = (stop.start() if stop is body and stop else stop.end()) if stop else at
            continue
        if name in SPACE:
            text.append(" ")
        if name in BLOCK:
            flush()
        if name in VOID:
            continue
        if close:
            if open_.get(name):
                while stack[-1][0] != name:
                    pop()
                if name not in BLOCK and stack[-1][1] != mark:
                    flush()
                mark = pop()
            continue
        if name == "p" and stack and stack[-1][0] == "p":
            mark = pop()
        stack.append((name, mark))
        open_[name] = open_.get(name, 0) + 1
        if mark != BOILER_:
            said = boilerplate(name, attributes, mark == MAIN_)
            after = said if said == BOILER_ or said and mark != SOFT_ else MAIN_ if name in MAIN else mark
            if after != mark and name not in BLOCK:
                flush()
            mark = after
    flush()
    return lines, marks


def shared_positions(a: list[int], b: list[int]) -> set[int]:
    """Positions of ``a`` in one longest common subsequence with ``b``.

    Common ends and lines that only one side has are set aside; the rest is solved bit-parallel, one
    whole-row operation on a big integer for each line.
    """
    lo, end_a, end_b = 0, len(a), len(b)
    while lo < min(end_a, end_b) and a[lo] == b[lo]:
        lo += 1
    while end_a > lo and end_b > lo and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    out = set(range(lo)) | set(range(end_a, len(a)))
    both = set(a[lo:end_a]) & set(b[lo:end_b])
    at_a = [i for i in range(lo, end_a) if a[i] in both]
    right = [x for x in b[lo:end_b] if x in both]
    where: dict[int, int] = {}
    for j, x in enumerate(right):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(right)) - 1
    rows, v = [], full
    for i in at_a:
        rows.append(v)
        u = v & where[a[i]]
        v = ((v + u) | (v - u)) & full
    # a zero bit at j in row i: the subsequence of a[:i] and right[:j+1] is longer than that of right[:j]
    rows.append(v)
    j = len(right) - 1
    for i in range(len(at_a) - 1, -1, -1):
        while j >= 0 and rows[i + 1] >> j & 1:
            j -= 1
        if j < 0:
            break
        if rows[i] >> j & 1:
            out.add(at_a[i])
            j -= 1
    return out


def deleted_lines(marks: list[int], hashes: list[int], mate: list[int] | None) -> list[int]:
    """Lines that differencing deletes: what both pages share, but for lines of the article; a page that shares all its unmarked lines keeps them."""
    shared = shared_positions(hashes, mate) if mate else set()
    unmarked = [i for i, m in enumerate(marks) if m == OPEN_]
    whole = all(i in shared for i in unmarked)
    return [i for i in sorted(shared) if marks[i] != MAIN_ and not (whole and marks[i] == OPEN_)]


def kept_lines(lines: list[str], marks: list[int], gone: list[int] | None) -> list[str]:
    """What is left of a page after differencing and the check against the marks."""
    out = set(gone or ())
    return [x for i, (x, m) in enumerate(zip(lines, marks)) if m not in (BOILER_, SOFT_) and i not in out]


def row_key() -> Column:
    """Two hashes of a row, as text."""
    one = lambda *more: F.lpad(F.hex(F.xxhash64("page_id", "url", "html", *more)), 16, "0")
    return F.concat(one(), one(F.lit(7)))


def page_keys(pages: DataFrame) -> DataFrame:
    """host, path, _k (row key), marks and hashes of the lines: no text."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(host.alias("host"), path.alias("path"), row_key().alias("_k"), "html")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names = ["host", "path", "_k", "marks", "hashes"]
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                got = [page_lines(x) for x in part.column(3).to_pylist()]
                hashes = [[xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in lines] for lines, _ in got]
                new = [pa.array([g[1] for g in got], pa.list_(pa.int8())), pa.array(hashes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *new], names=names)

    return rows.mapInArrow(work, "host string, path string, _k string, marks array<tinyint>, hashes array<long>")


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def mates(keys: DataFrame) -> DataFrame:
    """(_k, mate): for each page the neighbour in its host's path order that shares the longer path, the earlier on ties.

    ``keys`` has host, path, _k. Range partitions are sorted and scanned; what lies on both sides of a
    partition's edge (two rows a partition) is matched on the driver.
    """
    spark = keys.sparkSession

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import itertools

        names = ["part", "edge", "host", "path", "_k", "mate", "same"]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        before, made, first, last = None, [], True, None
        now = next(rows, None)
        for after in itertools.chain(rows, [None]) if now else ():
            best, same = None, -1
            for other in (before, after):
                if other is not None and other[1] == now[1] and (score := common_prefix(other[2], now[2])) > same:
                    best, same = other[3], score
            edge = ("first" if first else "") + ("last" if after is None else "")
            made.append((now[0], edge, now[1] if edge else None, now[2] if edge else None, now[3], best, same))
            first, before, now = False, now, after
            if len(made) == 4096:
                yield out(made)
                made = []
        if made:
            yield out(made)

    ordered = keys.distinct().repartitionByRange("host", "path", "_k").sortWithinPartitions("host", "path", "_k")
    numbered = ordered.select(F.spark_partition_id().alias("part"), "host", "path", "_k")
    found = staged(numbered.mapInArrow(scan, "part int, edge string, host string, path string, _k string, mate string, same int"), "mates")
    edges = sorted(found.where("edge != ''").select("part", "edge", "host", "path", "_k", "same").collect(), key=lambda r: (r["part"], "first" not in r["edge"]))
    better: dict[str, tuple[int, str]] = {}
    for left, right in zip(edges, edges[1:]):
        if left["part"] != right["part"] and left["host"] == right["host"]:
            score = common_prefix(left["path"], right["path"])
            for me, other, wins in ((left, right, score > left["same"]), (right, left, score >= right["same"])):
                if wins and score > better.get(me["_k"], (-1, ""))[0]:
                    better[me["_k"]] = score, other["_k"]
    if not better:
        return found.select("_k", "mate")
    patch = spark.createDataFrame([(k, v[1]) for k, v in better.items()], "_k string, new string")
    # two rows a partition at most
    return found.join(F.broadcast(patch), "_k", "left").select("_k", F.coalesce("new", "mate").alias("mate"))


def deletions(pages: DataFrame) -> DataFrame:
    """(_k, gone) for the pages that lose lines to their neighbour; only hashes of lines are moved."""
    keys = staged(page_keys(pages).dropDuplicates(["_k"]), "page-lines")
    pairs = mates(keys.select("host", "path", "_k"))
    other = keys.select(F.col("_k").alias("_m"), F.col("hashes").alias("mate_hashes"))
    with_mate = pairs.join(other, pairs.mate == other._m).select(F.col("_k").alias("_p"), "mate_hashes")
    joined = keys.join(with_mate, keys._k == with_mate._p).select("_k", "marks", "hashes", "mate_hashes")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [deleted_lines(*r) for r in zip(*[batch.column(k).to_pylist() for k in range(1, 4)])]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.list_(pa.int32()))], names=["_k", "gone"])
            yield out.filter(pa.array([bool(g) for g in gone], pa.bool_()))

    return staged(joined.mapInArrow(work, "_k string, gone array<int>"), "deleted-lines")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (lines joined by line feeds), n_chars, n_lines, n_deleted, n_shared (of these, deleted by differencing)."""
    id_type = pages.schema["page_id"].dataType.simpleString()
    gone = deletions(pages).select(F.col("_k").alias("_d"), "gone")
    rows = pages.select("page_id", "url", "html", row_key().alias("_k"))
    if gone.isEmpty():
        joined = rows.select("page_id", "url", "html", F.lit(None).cast("array<int>").alias("gone"))
    else:
        joined = rows.join(gone, rows._k == gone._d, "left").select("page_id", "url", "html", "gone")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                parsed = [page_lines(x) for x in part.column(2).to_pylist()]
                kept = [kept_lines(*p, g) for p, g in zip(parsed, part.column(3).to_pylist())]
                text = ["\n".join(k) for k in kept]
                cols = [pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array([len(p[0]) for p in parsed], pa.int64()), pa.array([len(p[0]) - len(k) for p, k in zip(parsed, kept)], pa.int64()), pa.array([len(g or ()) for g in part.column(3).to_pylist()], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=["page_id", "url", "text", "n_chars", "n_lines", "n_deleted", "n_shared"])

    return joined.mapInArrow(work, f"page_id {id_type}, url string, text string, n_chars long, n_lines long, n_deleted long, n_shared long")
