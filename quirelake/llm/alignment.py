"""Alignment of two tokenisations of the same texts by whitespace-token anchors.

Each text is tokenised whole by both vocabularies. Where a token of either ends at the same byte and the next
token of either begins with a space, the text is cut: such an anchor is verified by byte offsets, not by the
marks alone. Between anchors lies a window, mostly a word; its groups (cut wherever tokens of both end together) and linked
id pairs follow from its ids alone, so the windows of a stretch, which ends at an anchor, are worked on side by side in arrays.

Pair statistics: a task adds up the documents per id pair before anything is shuffled, and a count per pair is left
for the whole corpus. That table is bounded by the vocabularies, not by the corpus. Up to ``HELD`` pairs it is
broadcast, beyond that the links of the documents join it; both give the same. Tokens are made once: what the
second look needs of a document (its distinct pairs) is written to the shared folder, compressed.

Cases: null and empty texts, and texts that either vocabulary does not give back byte by byte, have no tokens:
zeros and an empty ``groups_sha256``. Strings of special tokens are plain text. Very long texts are worked on whole, stretch
by stretch; in a group of more than ``LISTED`` links equal pairs are counted, not listed, and small such groups are remembered.
Ties for the highest count all count as best. Repeated rows and rows of equal or null id are documents of their own.
An empty table gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence
from itertools import islice
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quirelake.llm.common import lean
from quirelake.plans.lineage import cut_lineage, new_path

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Texts tokenised at once, tokens of a stretch, links of a group that are listed; groups beyond that which are remembered, and their tokens.
BATCH, STRETCH, LISTED, MEMO, MEMO_TOKENS = 64, 1 << 16, 256, 10_000, 64
#: Pairs a task adds up before it hands them on, and pairs of the whole corpus that may be broadcast.
GATHERED, HELD = 1 << 20, 4_000_000

_SPACE = "▁"
# Fixed by the vocabulary file: how it splits text.
_SPLIT = public_tokenizers.PATTERN


def byte_of_char() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


# Characters whose classes all versions of Unicode agree on, so that both libraries split them alike.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff\u2010-\u2027\u2030-\u203a]*")


class Vocabulary:
    """Token bytes, their lengths and whether they begin with a space, by id."""

    def __init__(self, of_id: list[bytes]):
        self.bytes = of_id
        self.length = np.array([len(t) for t in of_id], np.int64)
        self.spaced = np.array([t[:1] == b" " for t in of_id])

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.length[ids])


def byte_level(path: str) -> tuple[Tokenizer, Vocabulary]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    of = byte_of_char()
    entries = [tokenizer.id_to_token(k) or "" for k in range(tokenizer.get_vocab_size())]
    return tokenizer, Vocabulary([bytes(of[c] for c in e) for e in entries])


def ranked(path: str, vocabulary: Vocabulary) -> tiktoken.Encoding | None:
    """The same vocabulary for the library that merges by rank; None where its merges are not in the order of ids."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    ids = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if ids != sorted(ids) or len(ids) + 256 > len(model["vocab"]) or ids and min(ids) < 256:
        return None
    made = {*ids, *(k for k, t in enumerate(vocabulary.bytes) if len(t) == 1)}
    return tiktoken.Encoding("ranked", pat_str=_SPLIT, mergeable_ranks={vocabulary.bytes[k]: k for k in made}, special_tokens={})


def pieces(path: str) -> tuple[sentencepiece.SentencePieceProcessor, Vocabulary]:
    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def entry(k: int) -> bytes:
        piece = model.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace(_SPACE, " ").encode()

    return model, Vocabulary([entry(k) for k in range(model.get_piece_size())])


def written(ids: int, marks: str) -> np.ndarray:
    """Decimal ids below ``ids``, each followed by a mark, as eight bytes filled up with zeros; one run of ids per mark."""
    return np.array([f"{k}{mark}" for mark in marks for k in range(ids)], "S8").view(np.uint64)


class Aligned:
    """What alignment says of one text; ``pairs`` are sorted and distinct, ``times`` their links."""

    __slots__ = ("n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times")

    def __init__(
        self, n_a: int = 0, n_b: int = 0, n_groups: int = 0, groups: str = "", pairs: Sequence[np.ndarray] = (),
        counted: Sequence[tuple[np.ndarray, np.ndarray]] = (),
    ):
        self.n_a, self.n_b, self.n_groups, self.groups = n_a, n_b, n_groups, groups
        self.pairs, self.times = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]), return_counts=True)
        if counted:
            keys, times = (np.concatenate(x) for x in zip((self.pairs, self.times), *counted, strict=True))
            self.pairs, at = np.unique(keys, return_inverse=True)
            self.times = np.zeros(len(self.pairs), np.int64)
            np.add.at(self.times, at, times)
        self.n_links = int(self.times.sum())


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.of_a = byte_level(a_path)
        self.b, self.of_b = pieces(b_path)
        self.quick = ranked(a_path, self.of_a)
        self.memo: dict[tuple[bytes, bytes], tuple[np.ndarray, np.ndarray]] = {}  # pairs of groups with many links
        n_a, n_b = len(self.of_a.bytes), len(self.of_b.bytes)
        self.written = np.concatenate([written(n_a, ",|"), written(n_b, ",;")])
        self.last_a, self.first_b, self.last_b = n_a, 2 * n_a, n_b  # how far apart its runs of ids lie

    def __call__(self, texts: list[str | None]) -> list[Aligned]:
        out = [Aligned()] * len(texts)
        some = [k for k, t in enumerate(texts) if t]
        for at in range(0, len(some), BATCH):
            part = some[at : at + BATCH]
            left = self.left([" " + texts[k] for k in part])
            right = self.b.encode([texts[k] for k in part], num_threads=1)
            for k, a, b in zip(part, left, right, strict=True):
                out[k] = self._text(f" {texts[k]}".encode(), a, b)
        return out

    def left(self, texts: list[str]) -> list[list[int]]:
        """Ids of A. Texts of plain characters go through the faster library, which merges by rank."""
        out = [self.quick.encode_ordinary(t) if self.quick and _PLAIN.fullmatch(t) else None for t in texts]
        slow = [k for k, ids in enumerate(out) if ids is None]
        for k, e in zip(slow, self.a.encode_batch_fast([texts[k] for k in slow], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def _text(self, raw: bytes, a: list[int], b: list[int]) -> Aligned:
        if b"".join(map(self.of_a.bytes.__getitem__, a)) != raw or b"".join(map(self.of_b.bytes.__getitem__, b)) != raw:
            return Aligned()
        a_ids, b_ids = np.array(a), np.array(b)
        a_ends, b_ends = self.of_a.ends(a_ids), self.of_b.ends(b_ids)
        # By byte: 1 where a token of B ends, 2 where also the next one begins with a space.
        mark = np.zeros(len(raw) + 1, np.uint8)
        mark[b_ends] = 1
        mark[b_ends[:-1][self.of_b.spaced[b_ids[1:]]]] = 2
        shared = mark[a_ends]
        anchor = shared == 2
        anchor[:-1] &= self.of_a.spaced[a_ids[1:]]
        anchor[-1] = True
        a_cuts = np.flatnonzero(anchor) + 1
        b_cuts = np.searchsorted(b_ends, a_ends[a_cuts - 1]) + 1
        # The last anchor of each stretch: windows are whole, so one of many tokens makes a longer stretch.
        stops = np.flatnonzero(np.diff(a_cuts // STRETCH, append=-1))
        groups, pairs, counted, i, j = [], [], [], 0, 0
        for m, n in zip(a_cuts[stops].tolist(), b_cuts[stops].tolist(), strict=True):
            groups.append(self._windows(a_ids[i:m], b_ids[j:n], a_ends[i:m], b_ends[j:n], shared[i:m], pairs, counted))
            i, j = m, n
        return Aligned(len(a), len(b), int(np.count_nonzero(shared)), b"".join(groups)[:-1].decode(), pairs, counted)

    def _windows(self, a, b, a_ends, b_ends, shared, pairs: list, counted: list) -> bytes:
        """Groups of a stretch as text, each with a mark behind it; its linked pairs (A id in the upper half) are added to
        ``pairs``, one per link, or where a group has many links to ``counted``."""
        a_stop = np.flatnonzero(shared) + 1
        b_stop = np.searchsorted(b_ends, a_ends[a_stop - 1]) + 1
        n_a, n_b = np.diff(a_stop, prepend=0), np.diff(b_stop, prepend=0)
        b_start = np.repeat(b_stop - n_b, n_a)  # of the group of each token of A

        entry = np.empty(len(a) + len(b), np.int64)
        x, y = a.copy(), b + self.first_b
        x[a_stop - 1] += self.last_a
        y[b_stop - 1] += self.last_b
        entry[np.arange(len(a)) + b_start] = x
        entry[np.arange(len(b)) + np.repeat(a_stop, n_b)] = y
        text = self.written[entry].tobytes().translate(None, b"\0")

        listed = n_a * n_b <= LISTED
        links = np.repeat(np.where(listed, n_b, 0), n_a)  # of each token of A
        at = np.arange(int(links.sum())) + np.repeat(b_start - (np.cumsum(links) - links), links)
        pairs.append(np.repeat(a << 32, links) | b[at])
        for g in np.flatnonzero(~listed).tolist():
            counted.append(self._counted(a[a_stop[g] - n_a[g] : a_stop[g]], b[b_stop[g] - n_b[g] : b_stop[g]]))
        return text

    def _counted(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of a group and their links."""
        key = a.tobytes(), b.tobytes()
        found = self.memo.get(key)
        if found is None:
            (x, s), (y, t) = (np.unique(ids, return_counts=True) for ids in (a, b))
            found = (x[:, None] << 32 | y).ravel(), (s[:, None] * t).ravel()
            if len(a) + len(b) <= MEMO_TOKENS:
                if len(self.memo) >= MEMO:
                    self.memo = dict(islice(self.memo.items(), MEMO // 2))  # the first met are the frequent ones
                self.memo[key] = found
        return found


@functools.lru_cache(maxsize=2)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


# --- pairs of a document, packed -----------------------------------------------------------------


def packed(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted pairs as differences, byte plane by byte plane, then the links of each."""
    planes = np.diff(pairs, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes() + times.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(2, 8, -1)
    steps, times = (np.ascontiguousarray(x.T).view("<i8").ravel() for x in both)
    return np.cumsum(steps), times


# --- over a corpus -------------------------------------------------------------------------------


def aligned(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None,
    keep_groups: bool = False,
) -> DataFrame:
    """Per document: numbers of tokens, groups and links, digest of its groups (with ``keep_groups`` they themselves,
    ``a1,a2|b1;...``), its packed pairs, and a number of its own."""
    paths = a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)
    rows = lean(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = _aligner(*paths)
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            found = align(batch.column("text").to_pylist())
            hexed = [hashlib.sha256(x.groups.encode()).hexdigest() if x.n_a else "" for x in found]
            numbers = [pa.array([getattr(x, c) for x in found], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
            more = [pa.array([x.groups for x in found], pa.string())] if keep_groups else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *numbers, pa.array(hexed, pa.string()), *more,
                 pa.array([packed(x.pairs, x.times) for x in found], pa.binary()), pa.array(range(at, at + len(found)), pa.int64())],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *["groups"] * keep_groups, "pairs", "row"],
            )
            at += len(found)

    kind = rows.schema["doc_id"].dataType.simpleString()
    text_column = "groups string, " if keep_groups else ""
    return rows.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, {text_column}pairs binary, row long")


def pair_counts(found: DataFrame) -> DataFrame:
    """pair (A id in the upper 32 bits), the number of documents that hold it linked, and whether its A id has none higher."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def merge() -> None:
            nonlocal keys, counts
            all_keys = np.concatenate([keys, *held])
            weight = np.ones(len(all_keys), np.int64)
            weight[: len(keys)] = counts
            keys, where = np.unique(all_keys, return_inverse=True)
            counts = np.bincount(where, weight, len(keys)).astype(np.int64)
            held.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)]), pa.array(counts[at : at + (1 << 16)])], ["pair", "n"])

        for batch in batches:
            held += [unpacked(body)[0] for body in batch.column("pairs").to_pylist()]
            if sum(map(len, held)) >= GATHERED:
                merge()
                if len(keys) >= GATHERED:
                    yield from out()
                    keys, counts = keys[:0], counts[:0]
        merge()
        yield from out()

    counts = cut_lineage(
        found.select("pairs").mapInArrow(gather, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    )
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    return counts.join(most, F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


_SUMS = "row long, n_best long, count_sum long"


def _by_broadcast(found: DataFrame, counts: DataFrame) -> DataFrame:
    table = counts.toArrow()
    order = np.argsort(table.column("pair").to_numpy())
    held = found.sparkSession.sparkContext.broadcast(
        tuple(table.column(c).to_numpy(zero_copy_only=False)[order] for c in ("pair", "n", "best"))
    )

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = held.value
        for batch in batches:
            out = []
            for body in batch.column("pairs").to_pylist():
                pairs, times = unpacked(body)
                at = np.searchsorted(keys, pairs)
                out.append((int(times[best[at]].sum()), int((times * n[at]).sum())))
            some, total = zip(*out, strict=True) if out else ((), ())
            columns = [batch.column(c) for c in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(some, pa.int64()), pa.array(total, pa.int64())], [*batch.schema.names, "n_best", "count_sum"])

    return found.mapInArrow(sums, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", n_best long, count_sum long")


def _by_join(found: DataFrame, counts: DataFrame) -> DataFrame:
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, body in zip(batch.column("row").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                pairs, times = unpacked(body)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), row)), pa.array(pairs), pa.array(times)], ["row", "pair", "times"])

    sums = (
        found.select("row", "pairs").mapInArrow(links, "row long, pair long, times long").join(counts, "pair").groupBy("row")
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return found.join(sums, "row", "left").select(*found.columns, zero("n_best"), zero("count_sum"))


def scored(found: DataFrame, held: int = HELD) -> DataFrame:
    """``found`` (as ``aligned`` gives it, and better written) plus ``n_best`` and ``count_sum`` from the whole corpus."""
    counts = cut_lineage(pair_counts(found))
    return _by_broadcast(found, counts) if counts.count() <= held else _by_join(found, counts)


def report(docs: DataFrame, **options) -> DataFrame:
    """The digest per document of ``scored``."""
    spark = docs.sparkSession
    path = new_path(spark, "alignment")
    aligned(docs, **options).write.parquet(path)
    return scored(lean(spark.read.parquet(path))).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
