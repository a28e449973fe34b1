"""Language identification by compression.

For every language a raw-content dictionary of zstandard is filled with text of that language. A text is
reduced to lower-case words, cut into blocks and compressed against each dictionary; the language whose
dictionary leaves the fewest bytes wins. Equal sizes (texts too short for a dictionary to matter) go to the
language with more training documents, then to the smaller name. The score falls from 1 with the margin
between the best and the second size; texts with a narrow margin are rejected, as are texts without a letter.
Of a few words alone all dictionaries may leave the same, so texts under ``JUDGED_BYTES`` are not judged.

Training reads a bounded sample: per language the ``SAMPLE`` documents with the smallest hash of their id,
``SAMPLE_CHARS`` characters of each, ``DICT_BYTES`` bytes in all. Every text is classified whole.

Cases: null, empty and letter-less texts are ``und`` with score 0 and rejected. Rows without lang or text, and
rows of the held-out fold, teach nothing. With nothing to learn from, every text is ``und`` and rejected. One
language alone wins every text with letters. Repeated rows get the same answer; extra columns are kept.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.common import held_out, lean

#: Bound of what is learned from: documents per language, characters of each, bytes of a dictionary.
SAMPLE, SAMPLE_CHARS, DICT_BYTES = 400, 3000, 256 << 10
BLOCK, LEVEL = 2048, 5
#: Texts of at least so many bytes of words are rejected if the best size is not this share below the second.
#: Chosen on learning-fold rows and languages left out: of texts cut to 40 bytes and more, 3 % part the two kinds.
JUDGED_BYTES, MARGIN = 32, 0.03
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
_TYPE = "struct<lang_pred:string,score:double,rejected:boolean>"
_ARROW = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

#: Languages in the order in which ties are settled, each with its dictionary.
Model = list[tuple[str, bytes]]


def letters(text: str | None) -> bytes:
    """The words of a text, lower-cased and separated by spaces. Fractions, superscripts and circled numbers are no letters."""
    words = _WORD.findall(text.lower()) if text else []
    if not all(map(str.isalpha, words)):
        words = [w for w in ("".join(filter(str.isalpha, w)) for w in words) if w]
    return "".join([f"{w} " for w in words]).encode()


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Dictionaries from the labelled rows of ``docs``; at most ``SAMPLE`` texts per language reach the driver."""
    rows = docs.select(F.col(doc_id).alias("i"), F.col(lang).alias("l"), F.col(text).alias("t")).where(
        F.col("l").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("i"))
    )
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    ranked = sorted(counts, key=lambda name: (-counts[name], name))
    if not ranked:
        return []
    # Only hashes small enough to be among the first SAMPLE of their language, with room to spare, are ranked: what is
    # dealt out by language stays the same size however large and many the inputs' parts are.
    spare = F.create_map(*[F.lit(x) for name in ranked for x in (name, min(1.0, 4 * SAMPLE / counts[name]))])
    place = F.pmod(F.xxhash64("i"), F.lit(1 << 30))
    order = Window.partitionBy("l").orderBy(place, F.col("i"), F.col("t"))
    sample = (
        rows.where(place < spare[F.col("l")] * (1 << 30))
        .select("l", "i", F.substring("t", 1, SAMPLE_CHARS).alias("t"))
        .withColumn("r", F.row_number().over(order))
        .where(F.col("r") <= SAMPLE)
        .orderBy("l", "r")
    )
    parts: dict[str, list[bytes]] = {name: [] for name in ranked}
    for r in sample.collect():
        parts[r["l"]].append(letters(r["t"]))
    return [(name, b"".join(parts[name])[:DICT_BYTES]) for name in ranked]


class Classifier:
    def __init__(self, model: Model):
        self.names = [name for name, _ in model]
        self.compressors = [_compressor(content) for _, content in model]

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        body = letters(text)
        if not body or not self.names:
            return UNKNOWN, 0.0, True
        blocks = [body[at : at + BLOCK] for at in range(0, len(body), BLOCK)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for k, s in enumerate(sizes) if k != best), default=2 * sizes[best])
        margin = 1 - sizes[best] / max(1, second)
        return self.names[best], min(1.0, 0.5 + margin), len(body) >= JUDGED_BYTES and margin < MARGIN


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=BLOCK, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0
    )
    if len(content) < 8:  # too short to be a dictionary
        return zstandard.ZstdCompressor(compression_params=params)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params)


@functools.lru_cache(maxsize=2)
def _classifier(model: tuple[tuple[str, bytes], ...]) -> Classifier:
    return Classifier(list(model))


def classified(model: Model, text: Column) -> Column:
    """Struct of language, score and whether the text is rejected."""
    held = tuple(model)

    def classify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = _classifier(held)
        for texts in batches:
            rows = [of(t) for t in texts.to_pylist()]
            yield pa.array([dict(zip(("lang_pred", "score", "rejected"), r, strict=True)) for r in rows], _ARROW)

    return F.arrow_udf(classify, _TYPE)(text.cast("string"))


def report(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document."""
    guess = classified(learn(docs) if model is None else model, F.col("text"))
    return lean(docs).select("doc_id", guess.alias("g")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "g.lang_pred", "g.score", "g.rejected"
    )


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` without the rows whose language is rejected."""
    guess = classified(learn(docs) if model is None else model, F.col("text"))
    return lean(docs).withColumn("__language", guess).where(~F.col("__language.rejected")).drop("__language")
