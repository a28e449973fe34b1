"""Phrase search with match boxes, over all pages of a corpus.

For every start word, a hit is the shortest run of words from there that contains the query,
case aside, words being joined by one space. A run of one word always counts; a longer one may
grow only while the text so far is shorter than the query plus ``LOOK_AHEAD`` characters. Each
predecessor within reach of a match therefore counts as well.

A match of a query with ``k`` spaces always spans ``k + 1`` words, so whether one *begins* at a
word is a test on that word and its ``k`` successors (ends with, equals, starts with), and the
shortest run from a start word ends with the next match that begins at or after it. That takes
no text windows and no comparison of all runs with all queries.

Queries come in one of two forms, with the same hits. A Python list is a handful that somebody typed: its
queries become literals, and words are shuffled and sorted once (64 terms carry 64 columns, so keep lists
short). A table ``queries(query_id, q)`` of any size is matched by equi-joins, or like a list when it turns out to hold
``FEW`` rows at most (its first rows are fetched to see that). In both, null and blank queries are
dropped, every other row is searched on its own, and rows that share a ``query_id`` each report their hits
under it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.geometry import highlight_box, page_to_canvas
from quirelake.functions.text import hit_status, is_blank, utf16_length
from quirelake.operators.spatial import page_scales
from quirelake.plans.blocks import dense_position
from quirelake.plans.lineage import new_path
from quirelake.schemas import K

#: How far, in characters beyond the length of the query, a run may grow.
LOOK_AHEAD = 20
#: Pages are searched in chunks of 2 ** CHUNK_BITS words.
CHUNK_BITS = 12
#: A table of no more queries is searched like a list.
FEW = 64
#: Sorts behind all words of a chunk.
_END = 2**62
_BOX = ("left_pt", "bottom_pt", "right_pt", "top_pt")


@dataclass(frozen=True)
class Term:
    query_id: int
    q: str  # lower case
    n: int  # length in UTF-16 units

    @property
    def tokens(self) -> list[str]:
        return self.q.split(" ")

    @property
    def reach(self) -> int:
        """No run is longer than this many words beyond its first, empty words included."""
        return self.n + LOOK_AHEAD + 1


#: A short list of (query_id, q), or a table of them.
Queries = list[tuple[int, str | None]] | DataFrame


def _terms(queries: list[tuple[int, str | None]]) -> list[Term]:
    """The queries of a list; blank ones are dropped."""
    return [Term(i, q.lower(), len(q.encode("utf-16-le")) // 2) for i, q in queries if q and q.strip()]


def _term_rows(queries: DataFrame) -> DataFrame:
    """query_id, q in lower case and length ``n`` of a table of queries; null and blank ones are dropped."""
    kept = queries.where(~is_blank(F.col("q")))
    return kept.select("query_id", F.lower("q").alias("q"), utf16_length(F.col("q")).alias("n"))


def _few_terms(rows: DataFrame) -> list[Term] | None:
    """The rows of a short table of terms; None for a longer one."""
    found = rows.limit(FEW + 1).collect()
    return None if len(found) > FEW else [Term(r.query_id, r.q, r.n) for r in found]


def _chunk_bits(reach: int) -> int:
    return max(CHUNK_BITS, (reach + 1).bit_length())


def _chunked(words: DataFrame, reach: int) -> DataFrame:
    """Name ``word_idx`` ``at`` and add ``chunk`` and ``own``; each chunk also gets the first ``reach`` words of the next one.

    That look-ahead is all a chunk needs of its neighbours, so a page of any size is searched by
    as many tasks as it has chunks.
    """
    bits = _chunk_bits(reach)
    words = words.withColumnRenamed("word_idx", "at")
    home = F.shiftright("at", bits)
    shared = (F.col("at") - F.shiftleft(home, bits) < reach) & (home > 0)
    copies = F.when(shared, F.array(home, home - 1)).otherwise(F.array(home))
    return words.withColumn("chunk", F.explode(copies)).withColumn("own", F.col("chunk") == home)


def _chunked_with_gaps(words: DataFrame, reach: int) -> DataFrame:
    """The same where ``word_idx`` has gaps, in one shuffle of words: they are not numbered first.

    Chunks are cut by ``word_idx``, and only their numbers of words are summed over a page. ``mark`` is null for a
    chunk's own words, the position of a word that it looks ahead to, and in one more row at its end (``order`` is
    ``_END``) the position behind its last word, from which its own are numbered backwards.
    """
    bits = _chunk_bits(reach)
    home = F.shiftright("word_idx", bits).alias("chunk")
    page = Window.partitionBy(*K).orderBy("chunk")
    counts = words.groupBy(*K, home).agg(F.count("*").alias("n"))
    ends = counts.withColumn("end", F.sum("n").over(page.rowsBetween(Window.unboundedPreceding, 0)))
    marks = ends.select(*K, "chunk", F.lit(_END).alias("order"), F.col("end").alias("mark"))

    # Chunks that look ahead to this one: those behind which fewer than ``reach`` words come before it.
    earlier = F.collect_list(F.struct("chunk", "end")).over(page.rowsBetween(-reach, -1))
    begin = F.col("end") - F.col("n")
    asking = ends.withColumn("earlier", earlier).select(
        *[F.col(k).alias(f"__{k}") for k in K], F.col("chunk").alias("__home"), begin.alias("begin"),
        F.explode(F.filter("earlier", lambda c: begin - c["end"] < reach)).alias("c"),
    )
    rank = F.row_number().over(Window.partitionBy(*K, "home").orderBy("word_idx"))
    heads = (
        words.where(F.col("word_idx") >= 2**bits).withColumn("home", F.shiftright("word_idx", bits))
        .withColumn("rank", rank).where(F.col("rank") <= reach)
    )
    same = F.col("home") == F.col("__home")
    for k in K:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    place = F.col("begin") + F.col("rank") - 1
    ahead = heads.join(asking, same).where(place - F.col("c.end") < reach)
    rest = [c for c in words.columns if c not in (*K, "word_idx")]
    own = words.select(*K, home, F.col("word_idx").cast("long").alias("order"), F.lit(None).cast("long").alias("mark"), *rest)
    ahead = ahead.select(*K, "c.chunk", F.col("word_idx").cast("long").alias("order"), place.alias("mark"), *rest)
    return own.unionByName(ahead).unionByName(marks, allowMissingColumns=True)


def _dense(words: DataFrame, dense: bool) -> DataFrame:
    """Words with consecutive ``pos`` per page; a corpus as read has them already."""
    if dense:
        return words.withColumn("pos", F.col("word_idx"))
    return dense_position(words, K, "word_idx", "pos").withColumn("pos", F.col("pos").cast("int"))


def _numbered(words: DataFrame) -> DataFrame:
    """Words with consecutive ``word_idx``, by one window over a page."""
    ranked = dense_position(words, K, "word_idx", "__pos", bits=None)
    return ranked.withColumn("word_idx", F.col("__pos").cast("int")).drop("__pos")


def _begins(tokens: list[str], word: Column, after) -> Column:
    """Whether a match of the tokens begins at ``word``; ``after(m)`` is the m-th word behind it."""
    if len(tokens) == 1:
        return F.contains(word, F.lit(tokens[0]))
    first, *inner, last = tokens
    cond = F.endswith(word, F.lit(first))
    for m, token in enumerate(inner, 1):
        cond = cond & (after(m) == token)
    return cond & F.startswith(after(len(tokens) - 1), F.lit(last))


def _hit_columns(words: DataFrame, terms: list[Term], dense: bool, bounds: bool) -> DataFrame:
    """Words of all chunks with, per term, ``hit_n``: the end of its run, or null.

    ``hit_n`` holds the last word ``j`` and, if asked for, the bounds of the words of the match
    behind its first, null when there are none. One shuffle and one sort: all windows share their
    partitioning and order.
    """
    reach = max(t.reach for t in terms)
    depth = max(len(t.tokens) for t in terms) - 1
    box = _BOX if bounds else ()
    cut = _chunked if dense else _chunked_with_gaps
    texts = words.select(*K, "word_idx", F.lower("text").alias("low"), (utf16_length(F.col("text")) + 1).alias("len"), *box)
    base = cut(texts, reach).select(*K, "chunk", *(("own", "at") if dense else ("order", "mark")), "low", "len", *box)
    # Descending, so that what lies ahead on the page lies behind in the frame, and frames only grow.
    order = Window.partitionBy(*K, "chunk").orderBy(F.desc("at" if dense else "order"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    if not dense:
        own = F.col("mark").isNull()
        at = F.coalesce("mark", F.max(F.when(F.col("order") == _END, F.col("mark"))).over(so_far) - F.sum(own.cast("int")).over(so_far))
        base = base.withColumn("at", at.cast("int")).withColumn("own", own).drop("mark")
    ahead = {
        f"{c}_{m}": F.lag(c, m).over(order) for m in range(1, depth + 1) for c in ("low", "len", *box)
    }
    # Characters from each word to the end of the chunk.
    rows = base.withColumns({"rest": F.sum("len").over(so_far), **ahead})

    def behind(c: str, k: int) -> list[Column]:
        return [F.col(f"{c}_{m}") for m in range(1, k + 1)]

    nexts = {}
    for n, t in enumerate(terms):
        k = len(t.tokens) - 1
        begins = _begins(t.tokens, F.col("low"), lambda m: F.col(f"low_{m}"))
        # What is left at the last word of the match.
        rest = F.col("rest") - sum([F.col("len"), *behind("len", k - 1)], F.lit(0)) if k else F.col("rest")
        tail = [_edge(c, behind(c, k)).alias(c) for c in box]
        match = F.struct((F.col("at") + k).alias("j"), rest.alias("rest"), *tail)
        nexts[f"next_{n}"] = F.last(F.when(begins, match), ignorenulls=True).over(so_far)
    rows = rows.withColumns(nexts)
    hits = []
    for n, t in enumerate(terms):
        end = F.col(f"next_{n}")
        # Length of the run without its last word; the run may grow while that is short enough.
        within = (end["j"] == F.col("at")) | (F.col("rest") - end["rest"] - 1 < t.n + LOOK_AHEAD)
        hits.append(F.when(within, end).alias(f"hit_{n}"))
    return rows.select(*K, "chunk", "own", "at", *box, *hits)


def _edge(side: str, values: list[Column]) -> Column:
    """Outermost of some values of one side of a box; nulls do not count."""
    if not values:
        return F.lit(None).cast("double")
    if len(values) == 1:
        return values[0]
    return F.least(*values) if side in ("left_pt", "bottom_pt") else F.greatest(*values)


def phrase_search(words: DataFrame, queries: Queries, dense: bool = False, placed: bool = False) -> DataFrame:
    """Hits ``query_id, doc_id, page_idx, i, j`` with the bounds of words ``i`` to ``j``.

    Queries are taken as they come; gate them with ``search_gate`` first. ``dense=True`` says that ``word_idx`` has
    no gaps; otherwise words are numbered anew, and ``i`` and ``j`` are those numbers. ``placed=True`` says that the words
    of a page lie in one task, which numbers them by one sort; elsewhere they are shuffled by chunks of a page.
    """
    if placed and not dense:
        words, dense = _numbered(words), True
    if isinstance(queries, DataFrame):
        rows = _term_rows(queries)
        terms = _few_terms(rows)
        if terms is None:
            hits = _search_by_join(words, rows.select("q", "n").distinct(), dense)
            return rows.join(hits, ["q", "n"]).select("query_id", *K, "i", "j", *_BOX)
        kind = queries.schema["query_id"].dataType
        return _search_by_literals(words, terms, dense).withColumn("query_id", F.col("query_id").cast(kind))
    return _search_by_literals(words, _terms(queries), dense)


def _search_by_literals(words: DataFrame, terms: list[Term], dense: bool) -> DataFrame:
    if not terms:
        return _no_hits(words)
    wide = _hit_columns(words, terms, dense, bounds=True)
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"hit_{n}").isNotNull(),
                    F.struct(F.lit(t.query_id).alias("query_id"), F.col(f"hit_{n}").alias("end")),
                )
                for n, t in enumerate(terms)
            ]
        )
    )
    any_hit = F.coalesce(*[F.col(f"hit_{n}.j") for n in range(len(terms))]).isNotNull()
    hits = wide.where(any_hit).select(*K, "chunk", "own", "at", *_BOX, F.explode(found).alias("h"))
    # All words from a start word to the match are start words of the same match, so bounds grow
    # from start to start; those of the look-ahead lend their bounds and are dropped after.
    # Chunks keep together what one shuffle has brought together.
    grown = (
        Window.partitionBy(*K, "chunk", "query_id", "j")
        .orderBy(F.desc("i"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    flat = hits.select(
        "h.query_id", *K, "chunk", "own", F.col("at").alias("i"), "h.end.j",
        *[_edge(c, [F.col(c), F.col(f"h.end.{c}")]).alias(c) for c in _BOX],
    )
    bounds = {c: (F.min if c in ("left_pt", "bottom_pt") else F.max)(c).over(grown) for c in _BOX}
    return flat.withColumns(bounds).where("own").select("query_id", *K, "i", "j", *_BOX)


def _no_hits(words: DataFrame) -> DataFrame:
    return words.where(F.lit(False)).select(
        F.lit(0).alias("query_id"), *K, F.col("word_idx").alias("i"), F.col("word_idx").alias("j"), *_BOX
    )


def search_counts(
    words: DataFrame, queries: Queries, requests: DataFrame | None = None, dense: bool = False
) -> DataFrame:
    """Hits per ``query_id`` and page, with the status text.

    Pages without hits are left out, unless ``requests(query_id, doc_id, page_idx)`` says what to report: then
    exactly those rows come back, with zeros. From a list of queries a page's counts are one pre-aggregated row;
    hits are never shuffled.
    """
    if isinstance(queries, DataFrame):
        rows = _term_rows(queries)
        terms = _few_terms(rows)
        if terms is None:
            per_term = _search_by_join(words, rows.select("q", "n").distinct(), dense, bounds=False)
            per_term = per_term.groupBy("q", "n", *K).agg(F.count("*").alias("hits"))
            counts = rows.join(per_term, ["q", "n"]).groupBy("query_id", *K).agg(F.sum("hits").alias("n_hits"))
        else:
            counts = _count_by_literals(words, terms, dense)
        counts = counts.withColumn("query_id", F.col("query_id").cast(queries.schema["query_id"].dataType))
    else:
        counts = _count_by_literals(words, _terms(queries), dense)
    if requests is not None:
        asked = requests.select("query_id", *K).join(counts, ["query_id", *K], "left")
        counts = asked.withColumn("n_hits", F.coalesce("n_hits", F.lit(0).cast("long")))
    return counts.select("query_id", *K, "n_hits", hit_status(F.col("n_hits")).alias("status"))


def _count_by_literals(words: DataFrame, terms: list[Term], dense: bool) -> DataFrame:
    if not terms:
        return _no_hits(words).select("query_id", *K, F.lit(0).cast("long").alias("n_hits"))
    wide = _hit_columns(words, terms, dense, bounds=False)
    per_page = wide.where("own").groupBy(*K).agg(*[F.count(f"hit_{n}.j").alias(f"n_{n}") for n in range(len(terms))])
    of: dict[int, list[str]] = {}
    for n, t in enumerate(terms):
        of.setdefault(t.query_id, []).append(f"n_{n}")
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("query_id"), sum([F.col(c) for c in cs], F.lit(0).cast("long")).alias("n_hits"))
            for i, cs in of.items()
        ]
    )
    return per_page.select(*K, F.inline(rows)).where("n_hits > 0")


def search_boxes(hits: DataFrame, pages: DataFrame, dims: DataFrame) -> DataFrame:
    """Highlight rect of each hit on the canvas, each side at least 4 pixels."""
    placed = hits.join(page_scales(pages, dims), K)
    box = highlight_box(
        page_to_canvas(
            *[F.col(c) for c in _BOX],
            F.col("width_pt"), F.col("height_pt"), F.col("render_w"), F.col("render_h"),
        )
    )
    out = placed.withColumn("box", box)
    return out.select("query_id", *K, "i", "j", *[F.col(f"box.{c}").alias(c) for c in "xywh"])


# --- many queries ----------------------------------------------------------------------------


def _token_match(token: Column, m: Column, k: Column, word: Column) -> Column:
    """Whether a word fits token ``m`` of a query with tokens 0 to ``k``."""
    return (
        F.when(k == 0, F.contains(word, token))
        .when(m == 0, F.endswith(word, token))
        .when(m == k, F.startswith(word, token))
        .otherwise(word == token)
    )


def _known_words(vocabulary: DataFrame, terms: DataFrame) -> DataFrame:
    """``low, q, n, k, m``: for each of ``terms(q, n)`` the words of a ``vocabulary(low, freq)`` that fit its rarest token ``m``.

    A token is looked up by its first characters, with the exact test behind them. A term with a token that no word
    fits has no match and drops out; empty tokens fit by their neighbours alone and are never picked.
    """
    tokens = terms.select("q", "n", F.posexplode(F.split("q", " ")).alias("m", "token"), (F.size(F.split("q", " ")) - 1).alias("k"))
    m, k = F.col("m"), F.col("k")
    how = F.when(k == 0, "in").when(m == 0, "end").when(m == k, "start").otherwise("all")
    tokens = tokens.where(F.col("token") != "").withColumn("how", how)
    gram = 3
    parts = tokens.select("token", "how").distinct().withColumn("gram", F.substring("token", 1, gram))
    places = F.sequence(F.lit(1), F.greatest(F.length("low"), F.lit(1)))
    grams = F.array_distinct(
        F.flatten(F.transform(places, lambda p: F.array(*[F.substring(F.col("low"), p, F.lit(n)) for n in range(1, gram + 1)])))
    )
    token, low = F.col("token"), F.col("low")
    fit = (
        F.when(F.col("how") == "in", F.contains(low, token)).when(F.col("how") == "end", F.endswith(low, token))
        .when(F.col("how") == "start", F.startswith(low, token)).otherwise(low == token)
    )
    fits = vocabulary.select("low", "freq", F.explode(grams).alias("gram")).join(parts, "gram").where(fit)
    fits = fits.select("token", "how", "low", "freq")
    weights = fits.groupBy("token", "how").agg(F.sum("freq").alias("weight"))
    pick = F.struct(F.coalesce("weight", F.lit(0)).alias("weight"), "m", "token", "how")
    picked = (
        tokens.join(weights, ["token", "how"], "left")
        .groupBy("q", "n", "k").agg(F.min(pick).alias("p")).where("p.weight > 0")
        .select("q", "n", "k", "p.m", "p.token", "p.how")
    )
    return picked.join(fits, ["token", "how"]).select("low", "q", "n", "k", "m")


def _search_by_join(words: DataFrame, terms: DataFrame, dense: bool, bounds: bool = True) -> DataFrame:
    """Hits ``q, n, doc_id, page_idx, i, j`` of any number of distinct ``terms(q, n)``; with ``bounds``, boxes too.

    Equi-joins only, none on the page alone. The rarest token of a term is looked up in the vocabulary, the words it
    fits in the words (they are stored first, so that Spark knows how few they are), the other tokens at their places.
    Only the words from the first start word of a match to its end are looked at again, for lengths and boxes.
    """
    box = _BOX if bounds else ()
    base = _dense(words, dense).select(
        *K, "pos", F.lower("text").alias("low"), (utf16_length(F.col("text")) + 1).alias("len"), *box
    )
    vocabulary = base.groupBy("low").agg(F.count("*").alias("freq"))
    path = new_path(words.sparkSession, "known-words")
    _known_words(vocabulary, terms).write.parquet(path)
    known = words.sparkSession.read.parquet(path)

    spots = base.select(*K, "pos", "low").join(known, "low").withColumn("a", F.col("pos") - F.col("m"))
    spots = spots.where("a >= 0").select("q", "n", *K, "a", "k", "m")
    match = ["q", "n", *K, "a", "k"]
    others = F.filter(F.sequence(F.lit(0), F.col("k")), lambda t: t != F.col("m"))
    checked = (
        spots.where("k > 0").select(*match, F.explode(others).alias("t"))
        .withColumn("pos", F.col("a") + F.col("t"))
        .join(base.select(*K, "pos", "low"), [*K, "pos"])
        .where(_token_match(F.get(F.split("q", " "), F.col("t")), F.col("t"), F.col("k"), F.col("low")))
        .groupBy(*match).agg(F.count("*").alias("fit"))
        .where("fit = k").drop("fit")
    )
    matches = spots.where("k = 0").select(*match).unionByName(checked).withColumn("j", F.col("a") + F.col("k"))

    # Start words after the previous match; across blocks the minimum below removes repeats.
    block = Window.partitionBy("q", "n", *K, F.shiftright("a", CHUNK_BITS)).orderBy("a")
    first = F.greatest(
        F.coalesce(F.lag("a").over(block) + 1, F.lit(0)), F.col("a") - F.col("n") - LOOK_AHEAD - 1
    )
    run = ["q", "n", *K, "j"]
    passed = (
        matches.withColumn("first", first).select(*run, "a", F.explode(F.sequence("first", "j")).alias("pos"))
        .join(base.select(*K, "pos", "len", *box), [*K, "pos"])
    )
    # Backwards from the end of a match, so that frames only grow: no more words than a run may have.
    back = Window.partitionBy(*run).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    bounds_of = {c: (F.min if c in ("left_pt", "bottom_pt") else F.max)(c).over(back) for c in box}
    grown = F.sum("len").over(back) - F.first("len").over(back) - 1
    starts = passed.withColumns({"grown": grown, **bounds_of}).where(F.col("pos") <= F.col("a")).where(
        (F.col("pos") == F.col("j")) | (F.col("grown") < F.col("n") + LOOK_AHEAD)
    )
    nearest = starts.groupBy("q", "n", *K, F.col("pos").alias("i")).agg(F.min(F.struct("j", *box)).alias("h"))
    return nearest.select("q", "n", *K, "i", "h.j", *[F.col(f"h.{c}").alias(c) for c in box])
