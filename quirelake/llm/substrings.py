"""Substring dedup by repeated-phrase automata: words in passages of 35 or more words that occur twice are removed.

Candidates. A window of ``WINDOW`` words is represented by its anchor: of its ``GRAM``-word phrases, the one with the least hash
(the first of equals). Equal windows have equal anchors, so only anchors that occur twice in the corpus can lie in a
recurring passage. Neighbouring windows mostly share an anchor; such a run is one row, and its stretch of words at most
2 * WINDOW - GRAM long. Anchors are counted for all documents; hashes only choose candidates and never decide.

Confirmation and automata. The stretches around recurring anchors are gathered once per different text, and dealt to shards
by anchor. In a shard, the windows of each anchor are compared word by word; neighbouring windows that occur
twice form a passage. An Aho-Corasick automaton over the passages of a shard (as sequences of word numbers) then reads every
stretch and locates every occurrence. A shard holds ``SHARD_WORDS`` words or one anchor, of at most ``HOT`` stretches: of an
anchor with more occurrences every window goes its own way, dealt by itself, equal ones added up beforehand.

Locations come back by joins on hashes of 128 bits (anchor and stretch; a text's own), which Spark can split where skewed.
Copies of a text are one text with a number of copies throughout. Texts travel compressed.

Cases: null, empty and blank texts have no words; texts of fewer than ``WINDOW`` words lose none. A text that occurs in two
rows, even with one id, repeats itself. Overlapping windows remove a word once. Texts of any length are worked on
whole, their anchors in slices. An empty table gives no rows. Extra columns are kept by the filter and dropped by the query.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import lean
from quirelake.plans.lineage import cut_lineage, new_path

WINDOW, GRAM = 35, 8
#: Occurrences of an anchor up to which one shard takes them all; words in the stretches of a shard; words or bytes looked at together.
HOT, SHARD_WORDS, SLICE = 4096, 400_000, 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(35).integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


# --- anchors ------------------------------------------------------------------------------------


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of every word, without a Python object per word."""
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + SLICE)
        while end < len(raw) and not _BLANK[raw[end]]:  # to the end of a word
            end += 1
        byte = np.frombuffer(raw, np.uint8, end - at, at)
        blank = _BLANK[byte]
        first = ~blank
        first[1:] &= blank[:-1]
        starts = np.flatnonzero(first)
        if len(starts):
            byte, blank, starts = byte[starts[0] :], blank[starts[0] :], starts - starts[0]
            place = np.arange(len(byte)) - np.repeat(starts, np.diff(np.append(starts, len(byte))))
            value = _RANDOM[0][byte] * _RANDOM[1][place & 255]
            value[blank] = 0
            out.append(np.add.reduceat(value, starts))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def anchors(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: hash of the anchor (signed), first window, number of windows."""
    last = len(words) - window + 1
    if last <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    phrase = words[: len(words) - gram + 1].copy()
    for k in range(1, gram):
        phrase *= _STEP
        phrase += words[k : len(words) - gram + 1 + k]
    phrase ^= phrase >> np.uint64(29)
    phrase *= np.uint64(0xBF58476D1CE4E5B9)
    phrase ^= phrase >> np.uint64(32)
    seen = sliding_window_view(phrase, window - gram + 1)
    at = np.concatenate([seen[k : k + SLICE].argmin(1) + np.arange(k, min(last, k + SLICE)) for k in range(0, last, SLICE)])
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return phrase[at[starts]].view(np.int64), starts, np.diff(np.append(starts, last))


def _key(raw: bytes) -> tuple[int, int]:
    """128 bits of a text as two signed longs."""
    digest = xxhash.xxh3_128_digest(raw)
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row its text's key, number of words, digest of all words, and packed runs."""
    names = ["doc_id", "k1", "k2", "n_words", "sha", "anchors", "runs"]
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            raw = (text or "").encode()
            words = word_hashes(raw)
            h, at, n = anchors(words)
            sha = hashlib.sha256(b" ".join(raw.split())).hexdigest()
            out.append((*_key(raw), len(words), sha, h, at << 8 | n))
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        raws = [(t or "").encode() for t in batch.column("text").to_pylist()]
        keys = [_key(r) for r in raws]
        columns = [pa.array([k[c] for k in keys], pa.int64()) for c in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([press.compress(r) for r in raws], pa.binary())], ["k1", "k2", "body"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their runs (first window << 9 | windows << 1 | hot) to stretches of words."""
    unpress = zstandard.ZstdDecompressor()
    names = ["g", "k1", "k2", "copies", "at", "stretch"]
    for batch in batches:
        for k1, k2, copies, body, h, runs in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "copies", "body", "h", "runs")), strict=True):
            words = unpress.decompress(body).split()
            g, at, stretch = [], [], []
            for anchor, run in zip(h, runs, strict=True):
                first, n, hot = run >> 9, run >> 1 & 255, run & 1
                if not hot:
                    g.append(anchor)
                    at.append(first)
                    stretch.append(b" ".join(words[first : first + n + WINDOW - 1]))
                    continue
                for k in range(first, first + n):
                    stretch.append(b" ".join(words[k : k + WINDOW]))
                    g.append(xxhash.xxh64_intdigest(stretch[-1]) - (1 << 63))
                    at.append(k)
            same = [pa.array(np.full(len(g), x), pa.int64()) for x in (k1, k2, copies)]
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), *same, pa.array(at, pa.int64()), pa.array(stretch, pa.binary())], names)


# --- shards -------------------------------------------------------------------------------------


class Shard:
    """Stretches of words by anchor; confirms what recurs, compiles it and locates it in every stretch."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.groups: list[list[tuple[tuple[int, ...], int]]] = []
        self.n_words = 0

    def add(self, stretches: Iterable[tuple[bytes, int]]) -> None:
        """The different stretches of one anchor, each with the number of its occurrences."""
        number = self.numbers
        group = [(tuple([number.setdefault(w, len(number)) for w in body.split(b" ")]), times) for body, times in stretches]
        self.groups.append(group)
        self.n_words += sum(len(ids) for ids, _ in group)

    def passages(self, group: list[tuple[tuple[int, ...], int]]) -> Iterator[tuple[int, ...]]:
        """Runs of neighbouring windows that occur twice, as word numbers."""
        size = self.window
        if len(group) == 1:
            if group[0][1] > 1:
                yield group[0][0]
            return
        times: Counter[tuple[int, ...]] = Counter()
        for ids, n in group:
            for k in range(len(ids) - size + 1):
                times[ids[k : k + size]] += n
        for ids, _ in group:
            start = None
            for k in range(len(ids) - size + 2):
                twice = k <= len(ids) - size and times[ids[k : k + size]] > 1
                if twice and start is None:
                    start = k
                elif not twice and start is not None:
                    yield ids[start : k + size - 1]
                    start = None

    def located(self) -> Iterator[list[list[int]]]:
        """Per group and stretch the words in passages, as a flat list of half-open spans."""
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for group in self.groups:
            for passage in self.passages(group):
                automaton.add_word(passage, len(passage))
        some = len(automaton) > 0
        if some:
            automaton.make_automaton()
        for group in self.groups:
            out = []
            for ids, _ in group:
                spans: list[int] = []
                for end, n in automaton.iter(ids) if some else ():
                    start = end - n + 1
                    while spans and start <= spans[-2]:  # ends rise, starts need not
                        del spans[-2:]
                    if spans and start <= spans[-1]:
                        spans[-1] = max(spans[-1], end + 1)
                    else:
                        spans += (start, end + 1)
                out.append(spans)
            yield out


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted stretches (g, digest, stretch, times) to spans (g, digest, s, e) of words in passages."""
    shard, listed = Shard(), []
    group: list[tuple[int, bytes, int]] = []
    at = None

    def close() -> None:
        if len(group) > 1 or group and group[0][2] > 1:  # else nothing recurs
            shard.add([(body, times) for _, body, times in group])
            listed.append((at, [digest for digest, *_ in group]))
        group.clear()

    def out() -> pa.RecordBatch:
        rows = [
            (g, digest, *span) for (g, digests), found in zip(listed, shard.located(), strict=True)
            for digest, spans in zip(digests, found, strict=True) for span in zip(spans[::2], spans[1::2], strict=True)
        ]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["g", "digest", "s", "e"])

    for batch in batches:
        for g, digest, body, times in zip(*(batch.column(c).to_pylist() for c in ("g", "digest", "stretch", "times")), strict=True):
            if g != at:
                close()
                at = g
                if shard.n_words >= SHARD_WORDS:
                    yield out()
                    shard, listed = Shard(), []
            group.append((digest, body, times))
    close()
    if listed:
        yield out()


# --- over a corpus ------------------------------------------------------------------------------


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with spans (word numbers) to what is kept of them."""
    unpress = zstandard.ZstdDecompressor()
    for batch in batches:
        kept, gone = [], []
        for body, spans in zip(batch.column("body").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = unpress.decompress(body).split()
            mask = np.zeros(len(words) + 1, np.int64)
            for s in spans:
                mask[s[0]] += 1
                mask[s[1]] -= 1
            stays = np.cumsum(mask[:-1]) == 0
            kept.append(b" ".join([words[k] for k in np.flatnonzero(stays)]).decode())
            gone.append(int(len(words) - stays.sum()))
        columns = [batch.column("k1"), batch.column("k2"), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "n_removed", "kept"])


def _written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return lean(spark.read.parquet(path))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, ``kept`` (the words left, one space between; null if none is removed) and
    ``sha`` (digest of all words)."""
    rows = lean(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scan = _written(
        rows.mapInArrow(_scan, f"doc_id {kind}, k1 long, k2 long, n_words long, sha string, anchors array<long>, runs array<long>"),
        "substrings-scan",
    )
    # Runs whose anchor occurs twice, by text.
    # Counts are written first: a join straight on an aggregate cannot be split where an anchor is frequent.
    counts = cut_lineage(scan.select(F.explode("anchors").alias("h")).groupBy("h").count().where("count > 1"))
    runs = scan.select("k1", "k2", F.explode(F.arrays_zip("anchors", "runs")).alias("r")).select("k1", "k2", F.col("r.anchors").alias("h"), "r.runs")
    marked = F.shiftleft("runs", 1).bitwiseOR((F.col("count") > HOT).cast("long"))
    recurring = (
        runs.join(counts, "h").groupBy("k1", "k2").agg(F.collect_set(F.struct("h", marked.alias("run"))).alias("r"))
        .select("k1", "k2", F.col("r.h").alias("h"), F.col("r.run").alias("runs"))
    )
    texts = rows.mapInArrow(_texts, "k1 long, k2 long, body binary").groupBy("k1", "k2").agg(F.first("body").alias("body"), F.count("*").alias("copies"))
    held = _written(texts.join(recurring, ["k1", "k2"]), "substrings-texts")
    stretches = _written(
        held.mapInArrow(_stretches, "g long, k1 long, k2 long, copies long, at long, stretch binary")
        .withColumn("digest", F.xxhash64("stretch")),
        "substrings-stretches",
    )
    different = stretches.groupBy("g", "digest", "stretch").agg(F.sum("copies").alias("times"))
    located = different.repartition("g").sortWithinPartitions("g").mapInArrow(_locate, "g long, digest long, s long, e long")
    spans = (
        stretches.select("g", "digest", "k1", "k2", "at").join(located, ["g", "digest"])
        .groupBy("k1", "k2").agg(F.collect_list(F.array(F.col("s") + F.col("at"), F.col("e") + F.col("at"))).alias("spans"))
    )
    removed = held.select("k1", "k2", "body").join(spans, ["k1", "k2"]).mapInArrow(_removed, "k1 long, k2 long, n_removed long, kept string")
    return scan.select("doc_id", "k1", "k2", "n_words", "sha").join(removed, ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), "kept", "sha"
    )


def report(docs: DataFrame) -> DataFrame:
    """The digest per document of ``deduplicated``."""
    kept = F.coalesce(F.sha2("kept", 256), F.col("sha"))
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT r, i, array_to_string(w[i:i + 34], ' ') AS p FROM doc, unnest(range(1, len(w) - 33)) AS u(i)),
twice AS (SELECT p FROM win GROUP BY p HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, j FROM win JOIN twice USING (p), unnest(range(i, i + 35)) AS u(j)),
word AS (SELECT r, j, w[j] AS x FROM doc, unnest(range(1, len(w) + 1)) AS u(j)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY j) AS t FROM word ANTI JOIN gone USING (r, j) GROUP BY r),
n AS (SELECT r, count(*) AS n_removed FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""
