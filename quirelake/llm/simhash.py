"""Near-duplicates by SimHash, compared bit-sliced.

Fingerprints: a text's 4-word shingles are hashed (XXH64, seed 42); a bit of the fingerprint is 1 if it is set in
over half of the hashes. Two fingerprints are linked if at most ``RADIUS`` bits differ.

Candidates: copies share a fingerprint and are one node. The 64 bits are cut into ``PARTS`` parts; two linked
fingerprints agree in at least PARTS - RADIUS of them, so they meet under one of the keys made of that many
parts (15 keys of two parts each). Nothing is capped and no link is lost.

Comparison, within a run of fingerprints under one key: bits are stored as vertical planes, a word of a plane
holding one bit of 64 fingerprints. The planes of differences are added into carry-save counters (ones, twos,
fours and a sticky overflow), so one pass counts 64 distances at a time, and blocks in which every lane has
exceeded the radius are abandoned. A run hands on the edges of a spanning forest, never its pairs; in long runs a
fingerprint is compared only while some later one is not known to be connected to it. Runs longer than
``RUN`` are handed back and dealt out again as pairs of parts of bounded size.

Components: large-star / small-star rounds over the forest edges, each checkpointed, until nothing changes. No
link, fingerprint or component is collected to the driver.

Cases: null, empty and blank texts have fingerprint zero, linked like any other. Texts of fewer than four words
are one shingle. Rows that repeat an id are all returned. A null id keeps its row and is never the smallest.
An empty table gives no rows. Extra columns are kept by the filter and dropped by the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import lean
from quirelake.plans.lineage import cut_lineage

SHINGLE, SEED, BITS, RADIUS, PARTS = 4, 42, 64, 4, 6
#: Runs up to SHORT are compared pair by offset; runs over RUN are dealt out again in parts.
SHORT, RUN = 24, 8192
#: Fingerprints in a block that is abandoned as a whole, and planes between two looks at it.
LANES, LOOK = 512, 8

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


# --- fingerprints -----------------------------------------------------------------------------


def fingerprint(text: bytes | None) -> int:
    """Unsigned fingerprint of a UTF-8 text."""
    words = text.lower().split() if text else []  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - SHINGLE + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], ">u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array(np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64))


def fingerprinted(text: Column) -> Column:
    """Fingerprint as a signed long."""
    return F.arrow_udf(_fingerprints, "long")(text.cast("string").cast("binary"))


# --- bit-sliced comparison ----------------------------------------------------------------------


def planes(x: np.ndarray) -> np.ndarray:
    """(64, words) planes of up to ``64 * words`` fingerprints; spare lanes are zero."""
    spare = -len(x) % 64
    if spare:
        x = np.concatenate((x, np.zeros(spare, np.uint64)))
    bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little")[:n].astype(bool)


class Counters:
    """Carry-save counters of set bits per lane: counts to 7, sticky beyond, compared with a radius below 8."""

    def __init__(self, words: int, radius: int):
        self.bits = np.zeros((3, words), np.uint64)
        self.over = np.zeros(words, np.uint64)
        self.radius = radius

    def add(self, plane: np.ndarray) -> None:
        carry = plane
        for row in self.bits:
            row ^= carry
            carry = carry & ~row
        self.over |= carry

    def exceeded(self) -> np.ndarray:
        """Lanes whose count is over the radius: a bitwise comparison with the constant."""
        more, same = self.over.copy(), ~self.over
        for k in (2, 1, 0):
            if self.radius >> k & 1:
                same &= self.bits[k]
            else:
                more |= same & self.bits[k]
                same &= ~self.bits[k]
        return more


def near(store: np.ndarray, n: int, query: int = 0, radius: int = RADIUS) -> np.ndarray:
    """Which of the ``n`` stored fingerprints differ from ``query`` in at most ``radius`` bits."""
    words = store.shape[1]
    per = LANES // 64
    live = np.arange(words)
    count = Counters(words, radius)
    for p in range(0, BITS, LOOK):
        for k in range(p, p + LOOK):
            plane = store[k] if len(live) == words else store[k, live]
            count.add(~plane if query >> k & 1 else plane)
        gone = count.exceeded()
        if p + LOOK < BITS and words > per:
            # Whole blocks only, so that what stays is still dense.
            block = live // per
            left = np.unique(block[gone != _FULL])
            keep = np.isin(block, left)
            if not keep.all():
                live = live[keep]
                count.bits, count.over = count.bits[:, keep], count.over[keep]
                if not len(live):
                    break
    out = np.zeros(words, np.uint64)
    if len(live):
        out[live] = ~count.exceeded()
    return _lanes(out, n)


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges (position, position of its component's first) that connect all links among ``fps``."""
    n = len(fps)
    comp = np.arange(n)
    for at in range(0, n, RUN):
        store = planes(fps[at : at + RUN])
        size = min(RUN, n - at)
        for i in range(min(n, at + size - 1)):
            later = max(at, i + 1)
            if (comp[later : at + size] == comp[i]).all():
                continue
            found = np.flatnonzero(near(store, size, int(fps[i]), radius)) + at
            joined = np.unique(np.append(comp[found], comp[i]))
            if len(joined) > 1:
                comp[np.isin(comp, joined)] = joined[0]
    return [(i, int(c)) for i, c in enumerate(comp) if c != i]


def _short_forest(run: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """The same for many short runs at once, offset by offset; ``run`` numbers the run of each fingerprint."""
    us, vs = [], []
    for d in range(1, SHORT):
        at = np.flatnonzero(run[d:] == run[:-d])
        if not len(at):
            break
        x = fps[at] ^ fps[at + d]
        at = at[near(planes(x), len(x), 0, radius)]
        us.append(at)
        vs.append(at + d)
    u, v = (np.concatenate(x) if x else np.zeros(0, int) for x in (us, vs))
    comp = np.arange(len(fps))
    while len(u):
        low = np.minimum(comp[u], comp[v])
        new = comp.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == comp).all():
            break
        comp = new
    return [(i, int(comp[i])) for i in np.flatnonzero(comp != np.arange(len(comp)))]


_LINKS = "u long, v long, k int, key long"


def _linked(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Edges of sorted (k, key, fp) rows; rows of runs over ``RUN`` come back as (fp, null, k, key)."""

    def edges(fps: np.ndarray, found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        if found:
            i, j = np.array(found).T
            none = pa.nulls(len(i), pa.int32()), pa.nulls(len(i), pa.int64())
            yield pa.RecordBatch.from_arrays([_signed(fps[i]), _signed(fps[j]), *none], ["u", "v", "k", "key"])

    def back(k: int, key: int, fps: np.ndarray) -> pa.RecordBatch:
        same = pa.array(np.full(len(fps), k, np.int32)), pa.array(np.full(len(fps), key, np.int64))
        none = pa.nulls(len(fps), pa.int64())
        return pa.RecordBatch.from_arrays([_signed(fps), none, *same], ["u", "v", "k", "key"])

    def whole(k: np.ndarray, key: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Edges of complete runs."""
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (key[1:] != key[:-1])))
        run = np.cumsum(new) - 1
        size = np.bincount(run)
        short = (size[run] > 1) & (size[run] <= SHORT)
        if short.any():
            yield from edges(fps[short], _short_forest(run[short], fps[short], radius))
        starts = np.flatnonzero(new)
        for r in np.flatnonzero(size > SHORT):
            at = starts[r]
            part = fps[at : at + size[r]]
            if size[r] > RUN:
                yield back(k[at], key[at], part)
            else:
                yield from edges(part, forest(part, radius))

    held: list[np.ndarray] = []  # the run that the last rows belong to
    long = None  # its key once it is too long to hold
    for k, key, fps in _gathered(batches):
        if long and len(k):
            same = (k == long[0]) & (key == long[1])
            n = len(k) if same.all() else int(np.argmin(same))
            if n:
                yield back(*long, fps[:n])
            k, key, fps = k[n:], key[n:], fps[n:]
            long = long if not len(k) else None
        if not len(k):
            continue
        if held:
            k, key, fps = (np.concatenate(x) for x in zip(held, (k, key, fps), strict=True))
        other = np.flatnonzero((k != k[-1]) | (key != key[-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield from whole(k[:cut], key[:cut], fps[:cut])
        held = [k[cut:], key[cut:], fps[cut:]]
        if len(held[0]) > RUN:
            long = int(held[0][0]), int(held[1][0])
            yield back(*long, held[2])
            held = []
    if held:
        yield from whole(*held)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of consecutive batches, put together to about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield _columns(held)
            held = []
    if held:
        yield _columns(held)


def _columns(held: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    k, key, fps = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in range(3))
    return k, key, fps.view(np.uint64)


def _signed(fps: np.ndarray) -> pa.Array:
    return pa.array(fps.view(np.int64))


def _keys(fp: Column, radius: int) -> Column:
    """Every choice of parts that a linked pair may agree in, as (number of the choice, bits of the parts)."""
    edges = [round(i * BITS / PARTS) for i in range(PARTS + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    chosen = [signed(sum(c)) for c in combinations(masks, PARTS - radius)]
    return F.array(*[F.struct(F.lit(k).alias("k"), fp.bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(chosen)])


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) of fingerprints that connect whatever links connect; ``nodes`` holds distinct ``fp``."""
    if radius >= PARTS:
        raise ValueError(f"a radius of at most {PARTS - 1}")
    keyed = nodes.select("fp", F.explode(_keys(F.col("fp"), radius)).alias("c")).select("c.k", "c.key", "fp")
    runs = keyed.repartition("k", "key").sortWithinPartitions("k", "key", "fp")
    found = cut_lineage(runs.mapInArrow(lambda b: _linked(b, radius), _LINKS))
    long = found.where(F.col("v").isNull()).select("k", "key", F.col("u").alias("fp"))
    return found.where(F.col("v").isNotNull()).select("u", "v").unionByName(_long_runs(long, radius))


def _long_runs(rows: DataFrame, radius: int) -> DataFrame:
    """Links of runs too long for one task: every pair of parts of a run meets in a group of its own."""
    half = RUN // 2
    parts = rows.groupBy("k", "key").agg(F.ceil(F.count("*") / half).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    dealt = (
        rows.join(parts, ["k", "key"])
        .withColumn("p", own)
        .select("k", "key", "fp", "p", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("q"))
        .select("k", "key", "fp", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    )

    def compare(group: pa.Table) -> pa.Table:
        fps = np.unique(group.column("fp").to_numpy()).view(np.uint64)
        i, j = np.array(forest(fps, radius), int).reshape(-1, 2).T
        return pa.Table.from_arrays([_signed(fps[i]), _signed(fps[j])], ["u", "v"])

    return dealt.groupBy("k", "key", "a", "b").applyInArrow(compare, "u long, v long")


# --- components --------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges``, the root being the smallest node of its component."""
    e = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        )).alias("e")).select("e.*").where("u != v").distinct()
        e = cut_lineage(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def _rooted(prints: DataFrame, radius: int) -> DataFrame:
    """fp, first (smallest id that has it) and root of every distinct fingerprint."""
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes, radius))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )


def grouped(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (smallest id of the component) of ``docs(doc_id, text)``."""
    prints = cut_lineage(lean(docs).select("doc_id", fingerprinted(F.col("text")).alias("fp")))
    rooted = _rooted(prints, radius)
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(rooted.join(firsts, "root").select("fp", "component_id"), "fp")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    return grouped(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of every component: the one with its smallest id; of rows alike in id and text, one.

    What stays is decided on ids and fingerprints; texts meet that decision in one join on both, so that no
    group of copies meets in one task. A component without any id keeps one row.
    """
    prints = cut_lineage(lean(docs).select("doc_id", fingerprinted(F.col("text")).alias("fp")))
    pick = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "fp")).alias("p")
    kept = _rooted(prints, radius).groupBy("root").agg(pick).select(
        F.col("p.fp").alias("__fp"), F.col("p.first").alias("__first")
    )
    marked = docs.withColumn("__fp", fingerprinted(F.col("text")))
    on = (marked["__fp"] == kept["__fp"]) & marked["doc_id"].eqNullSafe(kept["__first"])
    return marked.join(kept, on, "left_semi").dropDuplicates(["doc_id", "__fp"]).drop("__fp")
