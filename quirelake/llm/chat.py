"""Chat formatting in budgeted windows, with DataFrame functions alone.

A conversation becomes windows of whole turns. Prefix sums of the turns' tokens choose the spans: a window takes new
turns while their sum stays within what the budget leaves beside the system turn and the history allowance (a
turn that is larger alone is a window of its own). Every window repeats the system turn and up to ``HISTORY``
turns before its first one, within ``HISTORY_TOKENS``. Loss falls on assistant turns that are new in a window, so
each is a target exactly once.

Template: ``<s>`` opens a window; a turn is ``[role]text</s>``. Inside roles and texts ``&``, ``<``, ``[`` and ``]`` become
``&amp;``, ``&lt;``, ``&#91;`` and ``&#93;``, so control strings of any kind cannot be forged and reading back is exact.

Turns get positions without gaps first, whatever their numbers: keys without texts are sorted into ranges and counted
through. A conversation of any length is then worked on in blocks of ``BLOCK`` positions. A block gets the history
before it and the system turn as extra rows; its first turn starts a window. Only the digest of a whole
conversation, which the contract defines over one string, brings a conversation together.

Cases: null texts and roles are empty, a null conversation id is a conversation of its own, null turns come
first. Turns with equal numbers, of any amount, are ordered by role and XXH64 of the text; repeated rows are turns of
their own. A very long text is a window of its own. An empty table gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.plans.blocks import running_sum
from quirelake.plans.lineage import cut_lineage

#: Tokens of a window; of these, tokens and turns that history may take.
BUDGET, HISTORY_TOKENS, HISTORY = 1024, 192, 2
#: Positions in a block: a power of two.
BLOCK = 256
#: Bits of ``monotonically_increasing_id`` that count rows; the ones above number the partition.
_ROW_BITS = 33

SYSTEM, TARGET = "system", "assistant"
# Fixed order: "&" first when escaping, last when reading back.
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;"))
OPEN, CLOSE = "<s>", "</s>"


def escape(text: Column) -> Column:
    for plain, coded in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(_ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def tokens(text: Column) -> Column:
    """Tokens of a turn: words and single marks, and two for the template."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) + 2


_KEY = ("conv_id", "turn", "role", "hash")


def _turns(conversations: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), F.xxhash64(text).alias("hash")
    )


def _positions(turns: DataFrame) -> DataFrame:
    """``start`` and ``end`` (exclusive) of the positions of each key, counted through without gaps per conversation.

    Rows in sorted ranges carry ascending numbers, with the range in their upper bits, so sums are chained over
    ranges and no conversation is sorted whole in one task.
    """
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = turns.groupBy(*_KEY).agg(F.count("*").alias("times")).withColumn("known", F.col("turn").isNotNull())
    order = ["conv_id", "known", "turn", "role", "hash"]
    sorted_keys = keys.repartitionByRange(n, *order).sortWithinPartitions(*order)
    numbered = cut_lineage(sorted_keys.withColumn("at", F.monotonically_increasing_id()))
    ends = running_sum(numbered, ["conv_id"], "at", F.col("times"), "end", bits=_ROW_BITS)
    return ends.select(*_KEY, (F.col("end") - F.col("times")).alias("start"), "end")


def _placed(turns: DataFrame, positions: DataFrame) -> DataFrame:
    """conv_id, pos, role, text, n (tokens) of every turn; rows that repeat one another are counted, then dealt out again."""
    of = positions.select(*[F.col(c).alias(f"__{c}") for c in _KEY], "start", "end")
    same = [F.col(c) == F.col(f"__{c}") if c in ("role", "hash") else F.col(c).eqNullSafe(F.col(f"__{c}")) for c in _KEY]
    placed = turns.join(of, same).select("conv_id", "start", "end", "role", "text")
    alone = F.col("end") - F.col("start") == 1
    repeated = placed.where(~alone).groupBy("conv_id", "start", "role", "text").agg(F.count("*").alias("times"))
    copies = F.explode(F.sequence("start", F.col("start") + F.col("times") - 1))
    rows = placed.where(alone).select("conv_id", F.col("start").alias("pos"), "role", "text")
    rows = rows.unionByName(repeated.select("conv_id", copies.alias("pos"), "role", "text"))
    return rows.withColumn("n", tokens(F.col("text")).cast("long"))


def _blocks(conversations: DataFrame) -> DataFrame:
    """One row per block: its turns in order, the turns just before it, the system turn."""
    turns = _turns(conversations)
    positions = _positions(turns)
    block = lambda pos: F.floor(pos / BLOCK)
    # The last turns of a block go along with the next one, and the first system turn with all later ones.
    here = F.struct(block(F.col("pos")).alias("block"), F.lit(1).alias("part"))
    ahead = F.struct((block(F.col("pos")) + 1).alias("block"), F.lit(0).alias("part"))
    dealt = F.when(F.col("pos") % BLOCK >= BLOCK - HISTORY, F.array(here, ahead)).otherwise(F.array(here))
    own = _placed(turns, positions).select("conv_id", "pos", "role", "text", "n", F.explode(dealt).alias("to")).select("*", "to.block", "to.part").drop("to")
    first = (
        _placed(turns.where(F.col("role") == SYSTEM), positions.where(F.col("role") == SYSTEM))
        .groupBy("conv_id").agg(F.min(F.struct("pos", "text", "n")).alias("s"))
        .withColumnRenamed("conv_id", "of")
    )
    held = positions.select("conv_id", F.explode(F.sequence(block(F.col("start")), block(F.col("end") - 1))).alias("block")).distinct()
    carried = (
        held.join(first, F.col("conv_id").eqNullSafe(F.col("of")))
        .where(F.col("block") > block(F.col("s.pos")))
        .select("conv_id", F.col("s.pos").alias("pos"), F.lit(SYSTEM).alias("role"), F.col("s.text").alias("text"),
                F.col("s.n").alias("n"), "block", F.lit(-1).alias("part"))
    )
    return (
        own.unionByName(carried)
        .groupBy("conv_id", "block")
        .agg(F.array_sort(F.collect_list(F.struct("part", "pos", "role", "text", "n"))).alias("all"))
        .withColumn("turns", F.filter("all", lambda t: t.part == 1))
        .where(F.size("turns") > 0)
        .withColumn("past", F.filter("all", lambda t: (t.part == 0) & (t.role != SYSTEM)))
        .withColumn("carried", F.filter("all", lambda t: t.part == -1))
        .withColumn("at", F.array_position(F.transform("turns", lambda t: t.role), SYSTEM).cast("int"))
    )


def _starts(budget: int) -> Column:
    """0-based positions of the turns that start a window, from prefix sums of tokens."""
    system = F.coalesce(F.try_element_at("carried", F.lit(1))["n"], F.get("turns", F.col("at") - 1)["n"], F.lit(0).cast("long"))
    room = F.greatest(F.lit(1).cast("long"), F.lit(budget - HISTORY_TOKENS).cast("long") - system)
    begin = F.struct(
        F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("base"), F.lit(0).alias("i"),
        F.array().cast("array<int>").alias("starts"),
    )

    def step(a: Column, t: Column) -> Column:
        opens = (a.i == 0) | (a.sum + t.n - a.base > room)
        return F.struct(
            (a["sum"] + t.n).alias("sum"), F.when(opens, a["sum"]).otherwise(a.base).alias("base"),
            (a.i + 1).alias("i"), F.when(opens, F.concat(a.starts, F.array(a.i))).otherwise(a.starts).alias("starts"),
        )

    return F.aggregate("turns", begin, step, lambda a: a.starts)


def _recent(taken: Column) -> Column:
    """The last turns of ``taken`` that fit the history allowance, in order."""
    last = F.slice(taken, F.greatest(F.lit(1), F.size(taken) - HISTORY + 1), HISTORY)
    later = lambda i: F.aggregate(F.slice(last, i + 1, HISTORY), F.lit(0).cast("long"), lambda s, t: s + t.n)
    return F.filter(last, lambda t, i: later(i) <= HISTORY_TOKENS)


def windows(conversations: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row per window of ``conversations(conv_id, turn, role, text)``.

    conv_id, block, window (0-based in the block), n_repeated (leading turns that only give context), n_tokens,
    formatted, and loss: spans (1-based start, length) of the targets in ``formatted``.
    """
    empty = F.slice("turns", 1, 0)
    one = (
        _blocks(conversations)
        .withColumn("starts", _starts(budget))
        .select("*", F.posexplode("starts").alias("window", "start"))
        .withColumn("end", F.coalesce(F.get("starts", F.col("window") + 1), F.size("turns")))
        .withColumn("new", F.slice("turns", F.col("start") + 1, F.col("end") - F.col("start")))
        .withColumn(
            "system",
            F.when(F.size("carried") > 0, F.slice("carried", 1, 1))
            .when((F.col("at") > 0) & (F.col("at") <= F.col("start")), F.slice("turns", F.greatest("at", F.lit(1)), 1))
            .otherwise(empty),
        )
        .withColumn("taken", F.concat("past", F.filter(F.slice("turns", 1, F.col("start")), lambda t: t.role != SYSTEM)))
        .withColumn("context", F.concat("system", _recent(F.col("taken"))))
    )
    rendered = lambda t: F.concat(F.lit("["), escape(t.role), F.lit("]"), escape(t.text), F.lit(CLOSE))
    formatted = one.withColumn("parts", F.transform(F.concat("context", "new"), rendered)).withColumn(
        "lengths", F.transform("parts", lambda p: F.length(p))
    )
    spans = F.transform(
        "new",
        lambda t, i: F.struct(
            # A text ends where its close mark starts; it starts after its role.
            (F.aggregate(F.slice("lengths", 1, F.size("context") + i), F.lit(len(OPEN) + 1), lambda s, n: s + n)
             + F.length(escape(t.role)) + 2).alias("start"),
            F.length(escape(t.text)).alias("length"), (t.role == TARGET).alias("target"),
        ),
    )
    return formatted.select(
        "conv_id", "block", "window", F.size("context").alias("n_repeated"),
        F.aggregate(F.concat("context", "new"), F.lit(0).cast("long"), lambda s, t: s + t.n).alias("n_tokens"),
        F.concat(F.lit(OPEN), F.array_join("parts", "")).alias("formatted"),
        F.transform(F.filter(spans, lambda s: s.target), lambda s: F.struct(s.start, s.length)).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``windows`` plus turns (role, text) that are new in each, and targets: texts under the mask, unescaped."""
    body = F.substring("formatted", F.lit(len(OPEN) + 1), F.length("formatted"))
    parts = F.split(body, CLOSE)  # the last one is empty
    new = F.slice(parts, F.col("n_repeated") + 1, F.size(parts) - 1 - F.col("n_repeated"))
    turn = lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, F.lit(2), F.length(p)), "]", 1)).alias("role"),
        unescape(F.substring(p, F.instr(p, F.lit("]")) + 1, F.length(p))).alias("text"),
    )
    return formatted.withColumn("turns", F.transform(new, turn)).withColumn(
        "targets", F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s.start, s.length)))
    )


def report(conversations: DataFrame) -> DataFrame:
    """The digest per conversation of what ``read_back`` finds."""
    read = read_back(windows(conversations)).select(
        "conv_id", "block", "window", F.size("turns").cast("bigint").alias("n"), F.length("formatted").cast("bigint").alias("chars"),
        F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "").alias("said"),
        F.array_join("targets", "").alias("loss"),
    )
    whole = lambda c: F.array_join(F.transform("w", lambda w: w[c]), "")
    return (
        read.groupBy("conv_id")
        .agg(
            F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
            F.array_sort(F.collect_list(F.struct("block", "window", "said", "loss"))).alias("w"),
        )
        .select(
            "conv_id", "n_turns", F.sha2(whole("said"), 256).alias("turns_sha256"),
            F.length(whole("loss")).cast("bigint").alias("loss_chars"), F.sha2(whole("loss"), 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )


def with_forgery(conversations: DataFrame) -> DataFrame:
    """``conversations`` plus conversation -7, whose texts are control strings of a common template."""
    said = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    extra = conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
