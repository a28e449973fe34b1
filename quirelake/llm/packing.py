"""Vector bin packing of token sequences with the dot-product heuristic.

An example is a vector of tokens, segments (one per piece) and loss-bearing tokens. A sequence is opened with the
limits as its free capacity; as long as one fits, the waiting piece with the greatest dot product of its
vector and the free capacity (each in shares of the limits) is placed. What then is left of the token limit is
filled by cutting the waiting piece that fills most of it, the longest of equals; loss is cut off likewise. Texts longer than a sequence give whole
sequences first. What remains at the end of a partition, less than a sequence, is cut at powers of two, which
need no padding.

Each partition of the input is packed by its own task as it streams by, a window of ``WAITING`` pieces at a time:
no shuffle, no group, and a lost task repeats its own rows only. Sequence ids hold the partition in their upper
bits.

Cases: a null text is an empty one, which is the end id alone. Ties of the heuristic go to the piece that
came first. Repeated rows are packed once each. Any text length; an empty table gives no pieces. The query
drops extra columns.
"""

from __future__ import annotations

import functools
import re
import string
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from quirelake.llm.common import lean

#: Limits of a sequence: tokens, pieces, loss-bearing tokens. All tokens of a plain document bear loss.
TOKENS, SEGMENTS, LOSS = 2048, 512, 2048
#: Pieces that wait at once, and entries a token cache may hold (some 200 bytes each).
WAITING, CACHED = 1024, 800_000
END = 1
VOCABULARY = "word_bpe_49k.json"

# Characters that normal form C and per-character lower case leave to themselves; others take the slow way.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-˿‐-‧‰-›€]*")
# Fixed by the vocabulary file: how it splits text.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class TokenCache:
    """Token ids of texts as little-endian bytes, word by word.

    The vocabulary never merges across white space or across its own split, so the ids of a text are
    those of its parts, and each distinct part is tokenised once. One dictionary holds parts and what they make up
    between white space, in two generations: what is used moves to the young one; when that is full, the old one,
    unused for as long, is given up.
    """

    def __init__(self, path: str):
        self.full = Tokenizer.from_file(path)
        self.words = Tokenizer(self.full.model)
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str], cached: int = CACHED) -> list[bytes]:
        plain = [_PLAIN.fullmatch(t) is not None and "<|" not in t for t in texts]  # "<|": perhaps a special token
        chunks = [t.lower().split() if p else [] for t, p in zip(texts, plain, strict=True)]
        if len(self.young) > cached // 2:
            self.old, self.young = self.young, {}
        self._learn(set().union(*chunks))
        of = self.young
        out = [b"".join(map(of.__getitem__, cs)) for cs in chunks]
        for at in (k for k, p in enumerate(plain) if not p):
            out[at] = _le(self.full.encode(texts[at], add_special_tokens=False).ids)
        return out

    def shrink(self, keep: int) -> None:
        """Keep ``keep`` entries of the young generation, those met first."""
        self.old, self.young = {}, dict(islice(self.young.items(), keep))

    def _learn(self, chunks: set[str]) -> None:
        young, old = self.young, self.old
        new = []
        for c in chunks.difference(young):
            known = old.get(c)
            if known is None:
                new.append(c)
            else:
                young[c] = known
        parts = {c: _parts(c) for c in new}
        words = set().union(*parts.values()).difference(young)
        young.update([(w, old[w]) for w in words if w in old])
        listed = list(words.difference(old))
        for w, e in zip(listed, self.words.encode_batch_fast(listed, add_special_tokens=False), strict=True):
            young[w] = _le(e.ids)
        for c, ws in parts.items():
            if len(ws) > 1:
                young[c] = b"".join([young[w] for w in ws])


def _parts(chunk: str) -> Sequence[str]:
    """A chunk as the vocabulary splits it; letters with marks behind them, the usual case, need no expression."""
    if chunk.isalpha():
        return (chunk,)
    word = chunk.rstrip(string.punctuation)
    return (word, chunk[len(word) :]) if word.isalpha() else _SPLIT.findall(chunk)


def _le(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@functools.lru_cache(maxsize=2)
def token_cache(path: str) -> TokenCache:
    return TokenCache(path)


class Packer:
    """Packs pieces (key, start, length, loss) into sequences; ``place`` gets (sequence, offset, key, start, length)."""

    def __init__(self, place: Callable, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS):
        self.place, self.limits = place, np.array([tokens, segments, loss], float)
        self.tokens = tokens
        self.n = 0  # sequences so far
        self.waiting: list[tuple] = []

    def add(self, key, start: int, length: int, loss_from: int = 0) -> None:
        """A piece whose tokens from ``loss_from`` on (of its document) bear loss."""
        whole = min(self.tokens, int(self.limits[2]))
        while length >= whole:
            self.place(self.n, 0, key, start, whole)
            self.n, start, length = self.n + 1, start + whole, length - whole
        if length:
            self.waiting.append((key, start, length, loss_from))
        if len(self.waiting) >= WAITING:
            self._pack(WAITING // 4)

    def flush(self) -> None:
        self._pack(0)

    @staticmethod
    def _loss(start: int, length: int, loss_from: int) -> int:
        return max(0, start + length - max(start, loss_from))

    def _pack(self, keep: int) -> None:
        """Fill sequences until at most ``keep`` pieces wait; with 0, empty the last one too."""
        pieces = self.waiting
        vec = np.array([(n, 1, self._loss(s, n, f)) for _, s, n, f in pieces], float).reshape(-1, 3)
        live = np.ones(len(pieces), bool)
        left, total = int(live.sum()), float(vec[:, 0].sum())
        while left > keep and (total >= self.tokens or not keep):
            free, at = self.limits.copy(), 0
            chosen: list[tuple[int, int, int]] = []  # piece, start, length
            while free[0] > 0 and free[1] > 0:
                fits = live & (vec <= free).all(1)
                # The last segment must not leave a gap that a cut could fill. Tokens without loss come first in a piece.
                part = np.minimum(np.minimum(vec[:, 0], free[0]), vec[:, 0] - vec[:, 2] + free[2])
                cut = live & (vec[:, (0, 2)] > free[[0, 2]]).any(1) & (part > 0)
                if fits.any() and not (free[1] == 1 and cut.any()):
                    score = np.where(fits, (vec / self.limits) @ (free / self.limits), -1.0)
                    k = int(score.argmax())
                    key, start, length, loss_from = pieces[k]
                    chosen.append((k, start, length))
                    live[k] = False
                    left, total = left - 1, total - length
                    free -= vec[k]
                elif cut.any():
                    k = int(np.where(cut, part * (1 << 32) + vec[:, 0], -1.0).argmax())
                    key, start, length, loss_from = pieces[k]
                    take = int(part[k])
                    chosen.append((k, start, take))
                    pieces[k] = (key, start + take, length - take, loss_from)
                    vec[k] = (length - take, 1, self._loss(start + take, length - take, loss_from))
                    total -= take
                    free -= (take, 1, self._loss(start, take, loss_from))
                else:
                    break
            if not left and not keep:
                self._tail([(pieces[k][0], s, n) for k, s, n in chosen])
            else:
                for k, start, length in chosen:
                    self.place(self.n, at, pieces[k][0], start, length)
                    at += length
                self.n += 1
        self.waiting = [p for p, alive in zip(pieces, live, strict=True) if alive]

    def _tail(self, chosen: list[tuple]) -> None:
        """Sequences of powers of two from the pieces of a part-filled one."""
        size = sum(n for *_, n in chosen)
        room, at = 0, 0
        for key, start, length in chosen:
            while length:
                if not room:
                    room, at = 1 << (size.bit_length() - 1), 0
                n = min(room, length)
                self.place(self.n, at, key, start, n)
                room, at, size, start, length = room - n, at + n, size - n, start + n, length - n
                if not room:
                    self.n += 1


_FIELDS = [
    ("doc_id", None), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
]


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None,
    tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, loss_from: str | None = None,
    cached: int = CACHED, kept: int | None = None,
) -> DataFrame:
    """One row per piece: where it starts in its document, where it lies in its sequence, checksum of its ids.

    ``loss_from`` names a column with the number of a document's tokens (of a prompt, say) that bear no loss; null is none.
    ``cached`` bounds the token cache of a Python worker, ``kept`` what of it stays after a task (all if null).
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    rows = lean(docs).select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(loss_from).cast("long") if loss_from else F.lit(0), F.lit(0)).alias("loss_from"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        first = TaskContext.get().partitionId() << 33
        cache = token_cache(path)

        def place(n: int, at: int, key: tuple, start: int, length: int) -> None:
            doc, ids = key
            crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
            out.append((doc, start, length, crc, len(ids) // 4, first + n, at))

        packer = Packer(place, tokens, segments, loss)

        def drain() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[] for _ in _FIELDS]
            out.clear()
            arrays = [pa.array(c, t or id_type) for c, (_, t) in zip(cols, _FIELDS, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, [n for n, _ in _FIELDS])

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = cache.encode(part.column("text").to_pylist(), cached)
                for doc, body, free in zip(part.column("doc_id").to_pylist(), ids, part.column("loss_from").to_pylist(), strict=True):
                    body += _le([END])
                    packer.add((doc, body), 0, len(body) // 4, free)
            if out:
                yield drain()
        packer.flush()
        if kept is not None:
            cache.shrink(kept)
        if out:
            yield drain()

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(packed, schema)
