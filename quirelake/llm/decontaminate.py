"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of an item (10 consecutive words, or the whole item if it has fewer) is a pattern. A text is
searched with the symbols of Wu-Manber being words: a shift table over blocks of two words says how far the
window may jump, blocks with shift 0 lead to a bucket of patterns with that suffix, whose first word is
compared before the whole. Patterns of one length share a table, so short items do not shorten the jumps of
long ones.

The test set is read in blocks of bounded size, each of which makes one pass over the documents, so neither
the driver nor a task ever holds more than one block; with one block (the usual case) there is no shuffle and
nothing is written.

Cases: null or word-less texts have no words and no hits. Null or word-less items have no windows. Items with a
null id mark words but are not counted; rows that repeat an id are one item. Repeated documents are reported
once each. Overlapping windows count a word once. Extra columns are kept or, in the query, dropped.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import lean
from quirelake.plans.lineage import cut_lineage

WINDOW = 10
#: Bytes of test-set text that one pass searches for.
BLOCK_BYTES = 1 << 20

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_TYPE = "struct<n_words:bigint,spans:array<bigint>,items:array<string>>"
_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

Item = tuple[str | None, str]


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.translate(_LOWER)) if text else []


def patterns(items: Iterable[Item], window: int = WINDOW) -> dict[tuple[str, ...], set[str]]:
    """Windows of all items, each with the ids of the items that hold it."""
    found: dict[tuple[str, ...], set[str]] = {}
    for item_id, text in items:
        w = words(text)
        for at in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[at : at + window]), set()).update(() if item_id is None else (item_id,))
    return found


class WuManber:
    """Patterns of one length ``m``, searched with blocks of ``min(2, m)`` words."""

    def __init__(self, m: int, pats: Iterable[tuple[str, ...]]):
        self.m, self.b = m, min(2, m)
        self.most = m - self.b + 1
        self.shift: dict[tuple[str, ...], int] = {}
        self.bucket: dict[tuple[str, ...], dict[str, list[tuple[str, ...]]]] = defaultdict(dict)
        for p in pats:
            for end in range(self.b, m + 1):
                block = p[end - self.b : end]
                self.shift[block] = min(self.shift.get(block, self.most), m - end)
            self.bucket[p[m - self.b :]].setdefault(p[0], []).append(p)

    def search(self, text: list[str]) -> Iterator[tuple[int, tuple[str, ...]]]:
        """(start, pattern) of every occurrence, by start."""
        m, b, most, shift, bucket = self.m, self.b, self.most, self.shift, self.bucket
        end, n = m, len(text)
        while end <= n:
            block = tuple(text[end - b : end])
            jump = shift.get(block, most)
            if jump:
                end += jump
                continue
            start = end - m
            for p in bucket[block].get(text[start], ()):
                if tuple(text[start:end]) == p:
                    yield start, p
            end += 1


def searchers(pats: Iterable[tuple[str, ...]]) -> list[WuManber]:
    by_length: dict[int, list[tuple[str, ...]]] = defaultdict(list)
    for p in pats:
        by_length[len(p)].append(p)
    return [WuManber(m, ps) for m, ps in sorted(by_length.items())]


def merged(spans: Iterable[tuple[int, int]]) -> list[int]:
    """Union of half-open spans as a flat list of starts and ends."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += (start, end)
    return out


def _marker(block: list[Item], window: int):
    def mark(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        pats = patterns(block, window)
        tables = searchers(pats)
        for texts, spans, items in batches:
            out = []
            for text, old, ids in zip(texts.to_pylist(), spans.to_pylist(), items.to_pylist(), strict=True):
                w = words(text)
                hits = [(s, s + t.m, p) for t in tables for s, p in t.search(w)]
                if hits:
                    old = merged([*zip(old[::2], old[1::2], strict=True), *((s, e) for s, e, _ in hits)])
                    ids = sorted({*ids, *(i for *_, p in hits for i in pats[p])})
                out.append((len(w), old, ids))
            yield pa.array([dict(zip(("n_words", "spans", "items"), o, strict=True)) for o in out], _ARROW)

    return F.arrow_udf(mark, _TYPE)


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[Item]]:
    block: list[Item] = []
    size = 0
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item_id).cast("string"), F.col(text))
    for key, body in rows.toLocalIterator():
        if block and size + len(body) > block_bytes:
            yield block
            block, size = [], 0
        block.append((key, body))
        size += len(body)
    yield block


def mark_windows(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES, out: str = "__leaks",
) -> DataFrame:
    """``docs`` plus struct ``out``: number of words, merged spans of hit words (flat), ids of items found."""
    marked = lean(docs).withColumn(out, F.lit(None).cast(_TYPE))
    first = True
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        if not first:
            marked = cut_lineage(marked)  # the passes run one after another, each with its own block
        empty = F.array()
        marked = marked.withColumn(
            out,
            _marker(block, window)(
                F.col(text).cast("string"),
                F.coalesce(F.col(f"{out}.spans"), empty.cast("array<bigint>")),
                F.coalesce(F.col(f"{out}.items"), empty.cast("array<string>")),
            ),
        )
        first = False
    return marked


def hit_words(spans: Column) -> Column:
    """Number of words in a flat list of spans."""
    return F.aggregate(
        F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("bigint"), lambda a, x: a + x
    )


def contaminated(leaks: str = "__leaks") -> Column:
    return F.size(F.col(f"{leaks}.spans")) > 0


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The digest per document of ``mark_windows``."""
    marked = mark_windows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark)
    leaks = F.col("__leaks")
    return marked.select(
        "doc_id",
        leaks.n_words.alias("n_words"),
        hit_words(leaks.spans).alias("n_hit"),
        F.size(leaks["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(leaks["items"], ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a window of the test set."""
    return mark_windows(docs, benchmark, text).where(~contaminated()).drop("__leaks")


SQL = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
pat AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS p
  FROM item, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS u(i) WHERE len(w) > 0),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
win AS (
  SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS p
  FROM doc, (SELECT DISTINCT m FROM pat), unnest(range(1, len(w) - m + 2)) AS u(i)),
hit AS (SELECT r, i, win.m, item_id FROM win JOIN pat ON win.p = pat.p AND win.m = pat.m),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM hit, unnest(range(i, i + m)) AS u(j) GROUP BY r),
found AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""
