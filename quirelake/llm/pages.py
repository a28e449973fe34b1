"""Main text of web pages: structure first, then differencing against the nearest URLs of the host.

A page is cut into lines, one per block of text. Lines inside menus, headers, footers, sidebars, notices, adverts,
forms and reader comments go by what their elements are called. Pages are then paired by URL, sorted by path
within each host. Exact and near-whole copies that follow one another (``COPY``) are one neighbour: every page is
compared with the last page before its copies and the first one after them. Lines are aligned by longest
common subsequence, and lines that both pages share are deleted as the site's furniture. Where a page marks its
article, the lines in it are its own text whatever they share with others (quotes and copies stay), and lines
outside it are not main text. A page with nothing but copies beside it keeps all its lines.

Sorting never brings a host into one task: keys and a number per line are sorted into ranges first, and the html is
then dealt out by those ranges, along with the pages that the groups of copies at either end are compared with,
however many ranges away. So every page meets both neighbours whatever the number of partitions. The driver
sees four keys with their lines' numbers per range. A group's part in a range is held until the group ends.

Cases: null html is empty, empty pages have empty text. Pages without a host are not paired. Repeated rows are
copies of each other and returned once each. Unclosed and stray tags are read as browsers read them;
comments, scripts and styles that never end run to the end. A page is parsed in time linear in its length. Two very long pages are aligned in linear memory. An
empty table gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.llm.common import lean
from quirelake.llm.urls import host, path

#: Bits of alignment that may be held at once; beyond, the longer page is halved first.
ALIGNED_BITS = 1 << 26
#: Share of the longer page's characters in shared lines from which pages in a row are copies.
COPY = 0.9
_SKETCH = pa.struct([("hashes", pa.list_(pa.int64())), ("chars", pa.list_(pa.int32()))])

_SKIPPED = (
    r"<!--(?:.*?-->|.*)"
    r"|<(?P<raw>script|style|title|textarea|noscript|template|iframe|svg)\b[^>]*+>(?:.*?</(?P=raw)\s*+>|.*)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>%s)>"
    r"|<[!?][^>]*+>|</(?![a-z])[^>]*+>|(?P<text>[^<]++)|(?P<open><)"
)
#: Tokens while quotes in tags are paired, and from the first tag on whose quotes never close.
_QUOTED = re.compile(_SKIPPED % r"""(?>[^>"']|"[^"]*+"|'[^']*+')*+""", re.DOTALL | re.IGNORECASE)
_PLAIN = re.compile(_SKIPPED % "[^>]*+", re.DOTALL | re.IGNORECASE)
_ATTR = re.compile(r"""\b(class|id|role|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|(?<![\w-])(hidden)(?![\w-])""", re.IGNORECASE)

_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2"
    " h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td"
    " tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_IN_HEAD = frozenset("base link meta".split())
_DROPPED = frozenset("nav footer aside form head header menu dialog button select search".split())
_MAIN = frozenset(("article", "main"))
# Names say nothing about headings, parts of tables, quotations and what stands inside a line of text.
_NAMED = _BLOCKS - frozenset(
    "h1 h2 h3 h4 h5 h6 hgroup html body main blockquote pre figure figcaption dt dd table tbody td tfoot th thead tr".split()
)
_NAMES = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies"
    " disqus footer header masthead menu modal nav navbar navigation newsletter notice notices notification popup promo"
    " promoted related share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets".split()
)
# Inside the article these may name its own parts; the first set never counts there, the second only as a whole name.
_OWN = frozenset("header masthead banner".split())
_DOUBTFUL = frozenset("menu notice notices notification related social widget widgets footer toolbar promo".split())
_MODIFIERS = frozenset("with has no without".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def _names_furniture(name: str, in_main: bool) -> bool:
    """Whether a class or id is a furniture word or ends in one, other than to say whether there is such a thing."""
    parts = re.split(r"[_-]+", name)
    last = parts[-1]
    if last not in _NAMES or in_main and (last in _OWN or last in _DOUBTFUL and len(parts) > 1):
        return False
    return _MODIFIERS.isdisjoint(parts)


def _furniture(tag: str, attrs: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element is dropped, and whether it holds the main text."""
    main = tag in _MAIN
    dropped = tag in _DROPPED and not (tag == "header" and in_main)
    if attrs and tag not in ("html", "body"):
        for m in _ATTR.finditer(attrs):
            if m[5]:
                dropped = True
                continue
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "role":
                dropped |= value in _ROLES
                main |= value in ("main", "article")
            elif name == "style":
                dropped |= _HIDDEN.search(value) is not None
            elif tag in _NAMED:
                dropped |= any(_names_furniture(v, in_main) for v in value.split())
    return dropped, main and not dropped


def _tokens(page: str) -> Iterator[tuple[str | None, bool, str]]:
    """(tag, whether it ends, attributes) of tags and (None, False, text) of texts, in time linear in the page.

    Nothing is looked for twice: past the last ``>`` there are no tags, and once a tag's quotes run to the end of the
    page, quotes are no longer paired.
    """
    closed, at, pattern = page.rfind(">") + 1, 0, _QUOTED
    while at < closed:
        m = pattern.match(page, at)
        if m["open"] and pattern is _QUOTED and page[at + 1 : at + 3].lstrip("/")[:1].isalpha():
            pattern = _PLAIN
            continue
        at = m.end()
        if m["tag"] is not None:
            yield m["tag"].lower(), bool(m["end"]), m["attrs"]
        elif m["text"] or m["open"]:
            yield None, False, m["text"] or "&lt;"
    rest = page[at:].partition("<!--")[0]
    if rest:
        yield None, False, rest.replace("<", "&lt;")


def lines_of(page: str | None) -> list[tuple[str, bool]]:
    """(text, whether it is inside the marked article) of every block that is not furniture."""
    out: list[tuple[str, bool]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, dropped, main: of the element and all around it
    is_open: Counter[str] = Counter()
    now = ("", False, False)

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((text, now[2]))

    def pop() -> str:
        tag = stack.pop()[0]
        is_open[tag] -= 1
        return tag

    for tag, ends, told in _tokens(page or ""):
        if tag is None:
            if not now[1]:
                held.append(told)
            continue
        block = tag in _BLOCKS
        if block:
            flush()
        elif tag == "br":
            held.append(" ")
        if ends:
            if is_open[tag]:
                while pop() != tag:
                    pass
            now = stack[-1] if stack else ("", False, False)
            continue
        if stack and stack[-1][0] == "head" and tag not in _IN_HEAD:
            pop()
        if block and stack and stack[-1][0] == "p":
            pop()
        if tag in ("li", "option", "dd", "dt", "tr", "td", "th") and stack and stack[-1][0] == tag:
            pop()
        now = stack[-1] if stack else ("", False, False)
        if tag in _VOID:
            continue
        dropped, main = _furniture(tag, told, now[2])
        if block or dropped:
            if dropped and not block:
                flush()
            now = (tag, now[1] or dropped, now[2] or main)
            stack.append(now)
            is_open[tag] += 1
    flush()
    return out


# --- alignment --------------------------------------------------------------------------------


def _rows(a: list[int], b: list[int], keep: bool) -> list[int]:
    """Bit rows of the alignment of ``b`` with ``a``: zero bits mark where the common subsequence grows."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, rows = full, []
    for x in b:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
        if keep:
            rows.append(v)
    return rows if keep else [v]


def _lengths(row: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(i, i) for i in range(head)]
    sa, sb = set(a[head : len(a) - tail]), set(b[head : len(b) - tail])
    ia = [i for i in range(head, len(a) - tail) if a[i] in sb]
    ib = [i for i in range(head, len(b) - tail) if b[i] in sa]
    out += [(ia[i], ib[j]) for i, j in _align([a[i] for i in ia], [b[j] for j in ib])]
    return out + [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]


def _align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) * len(b) > ALIGNED_BITS and len(b) > 1:
        mid = len(b) // 2
        first = _lengths(_rows(a, b[:mid], False)[0], len(a))
        last = _lengths(_rows(a[::-1], b[mid:][::-1], False)[0], len(a))[::-1]
        cut = int((first + last).argmax())
        rest = _align(a[cut:], b[mid:])
        return _align(a[:cut], b[:mid]) + [(i + cut, j + mid) for i, j in rest]
    rows = _rows(a, b, True)
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
            if not j or rows[j - 1] >> (i - 1) & 1:
                i -= 1
                out.append((i, j))
    return out[::-1]


# --- pages ------------------------------------------------------------------------------------


def main_text(lines: list[tuple[str, bool]], shared: set[int]) -> str:
    """Lines of the marked article; without one, the lines that no neighbour shares."""
    if any(inside for _, inside in lines):
        return "\n".join(text for text, inside in lines if inside)
    return "\n".join(text for i, (text, _) in enumerate(lines) if i not in shared)


def _hashes(lines: list[tuple[str, bool]]) -> list[int]:
    """A number per line, the same in every process."""
    return [int.from_bytes(blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) for t, _ in lines]


def is_copy(a: list[int], b: list[int], a_chars: list[int], b_chars: list[int], pairs: list[tuple[int, int]] | None = None) -> bool:
    """Whether all but a small share of the longer page's characters are in lines that both pages share."""
    if a == b:
        return True
    longer = max(sum(a_chars), sum(b_chars))
    if min(sum(a_chars), sum(b_chars)) < COPY * longer:
        return False
    return sum(a_chars[i] for i, _ in (common(a, b) if pairs is None else pairs)) >= COPY * longer


def _differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, host, path, id); neighbours of a range that are only context are not returned.

    Copies in a row are one group. All its pages are held against the last page of the group before and the first of
    the group after; context is never of a group with the range's own rows.
    """
    before: list[int] | None = None  # last page of the group before
    group: list[tuple] = []  # (page_id, url, lines, hashes)
    at, last_chars = None, []  # range, host and own of the group; sizes of its last page's lines
    known: dict[str, str] = {}  # lines of the group, so that copies hold them once

    def done(after: list[int] | None) -> list[tuple]:
        out, seen = [], (None, "", 0)
        for page_id, url, lines, hashes in group if at[2] else ():
            if lines != seen[0]:
                shared: set[int] = set()
                if before is not None:
                    shared.update(j for _, j in common(before, hashes))
                if after is not None:
                    shared.update(i for i, _ in common(hashes, after))
                seen = (lines, main_text(lines, shared), len(shared))
            out.append((page_id, url, *seen[1:]))
        return out

    for batch in batches:
        out: list[tuple] = []
        cols = [batch.column(c).to_pylist() for c in ("part", "host", "page_id", "url", "html", "own")]
        for part, name, page_id, url, page, own in zip(*cols, strict=True):
            lines = lines_of(page)
            hashes, chars = _hashes(lines), [len(t) for t, _ in lines]
            now = (part, name, own)
            if not (group and name and now == at and is_copy(group[-1][3], hashes, last_chars, chars)):
                near = bool(group and name and now[:2] == at[:2])
                if group:
                    out += done(hashes if near else None)
                before = group[-1][3] if near else None
                group, at = [], now
                known.clear()
            if group and group[-1][3] == hashes:
                lines, hashes = (group[-1][2] if group[-1][2] == lines else lines), group[-1][3]
            else:
                lines = [(known.setdefault(t, t), inside) for t, inside in lines]
            group.append((page_id, url, lines, hashes))
            last_chars = chars
        yield _batch(out, batch.schema)
    if group:
        yield _batch(done(None), batch.schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    types = [schema.field("page_id").type, pa.string(), pa.string(), pa.int64()]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "url", "text", "n_shared"]
    )


#: What is told of a range: its first and last row, the first row of its second group, the last row before its last group.
FIRST, LAST, SECOND, LAST_BUT = range(4)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a sorted range that stand for its groups of copies, marked with ``end``."""
    number = TaskContext.get().partitionId()  # of a range: they are in order
    first = second = last_but = last = None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("host", "hashes", "chars")]
        for i, row in enumerate(zip(*cols, strict=True)):
            here = batch.slice(i, 1)
            if first is None:
                first = here
            elif not _same_group(last[1], row):
                second, last_but = second or here, last[0]
            last = (here, row)
    for end, row in ((FIRST, first), (LAST, last and last[0]), (SECOND, second), (LAST_BUT, last_but)):
        if row is not None:
            yield row.append_column("range", pa.array([number], pa.int32())).append_column("end", pa.array([end], pa.int32()))


def _same_group(a: tuple, b: tuple) -> bool:
    return bool(a[0]) and a[0] == b[0] and is_copy(a[1], b[1], a[2], b[2])


def _contexts(ends: list[dict]) -> dict[tuple, list[int]]:
    """By key, the ranges that need the row as context: the last of the group before and the first of the group after."""
    n = len(ends)
    key = lambda r, end: ends[r][end][0] if end in ends[r] else None
    joined = [bool(r) and _same_group(ends[r - 1][LAST][1], ends[r][FIRST][1]) for r in range(n)]
    out: dict[tuple, list[int]] = {}
    before = None
    for r in range(n):
        if r and not joined[r]:
            before = key(r - 1, LAST)
        elif r:
            before = key(r - 1, LAST_BUT) or before
        if before:
            out.setdefault(before, []).append(r)
    after = None
    for r in range(n - 2, -1, -1):
        after = key(r + 1, FIRST) if not joined[r + 1] else key(r + 1, SECOND) or after
        if after:
            out.setdefault(after, []).append(r)
    return out


def _sortable(row) -> tuple:
    h, p, i, tie = row
    return h, p, i is not None, 0 if i is None else i, tie


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars and n_shared (lines its neighbours share) of every page."""
    spark = pages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    link = F.col(url)
    rows = lean(pages).select(
        F.col(page_id).alias("page_id"), link.alias("url"), F.col(html).alias("html"), host(link).alias("host"), path(link).alias("path")
    )
    rows = rows.withColumn("tie", F.xxhash64("html"))
    order = ["host", "path", "page_id", "tie"]

    def sketches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            lines = [lines_of(page) for page in pages.to_pylist()]
            yield pa.array([{"hashes": _hashes(x), "chars": [len(t) for t, _ in x]} for x in lines], _SKETCH)

    sketch = F.arrow_udf(sketches, "struct<hashes:array<bigint>,chars:array<int>>")("html")
    keys = rows.withColumn("sketch", sketch).select(*order, "sketch.hashes", "sketch.chars")
    ends = keys.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
        _ends, T.StructType([*keys.schema.fields, T.StructField("range", T.IntegerType()), T.StructField("end", T.IntegerType())])
    )
    found: dict[int, dict] = {}
    for r in ends.collect():
        found.setdefault(r["range"], {})[r["end"]] = (_sortable(r[:4]), (r["host"], r["hashes"], r["chars"]))
    ranges = [found[k] for k in sorted(found)]
    firsts, context = [r[FIRST][0] for r in ranges], _contexts(ranges)

    def parts(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for cols in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in cols), strict=True):
                k = _sortable(row)
                own = max(0, bisect_right(firsts, k) - 1)
                out.append([own, *(r for r in context.get(k, ()) if r != own)])
            yield pa.array(out, pa.list_(pa.int32()))

    dealt = (
        rows.withColumn("parts", F.arrow_udf(parts, "array<int>")(*order))
        .select("*", F.posexplode("parts").alias("copy", "part"))
        .select("part", (F.col("copy") == 0).alias("own"), *order, "url", "html")
        .repartitionById(max(1, n), F.pmod("part", F.lit(n)).cast("int"))
        .sortWithinPartitions("part", *order)
    )
    kind = rows.schema["page_id"].dataType.simpleString()
    text = dealt.mapInArrow(_differenced, f"page_id {kind}, url string, text string, n_shared long")
    return text.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_shared")
