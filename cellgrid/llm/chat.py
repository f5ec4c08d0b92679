"""Multi-party chat formatting by perspective rotation.

For every participant of a conversation the whole dialogue is rendered with that speaker as the assistant
and all others as named users, and the spans on which a model of that speaker is trained are given as a mask.

With ``pieces=False`` every conversation, of any size, is one row a participant: the query's form, and that of its SQL. The output is what
that takes, turns times participants. One with much to render (more than ``RENDER_BYTES``) is rendered block by block of its turns, in many tasks, and
the blocks of each participant are put together, which changes no row. A row is still held whole by a task, some times over, and a text
beyond 2 GB, more than a string of Spark can be, ends the run with an error.

With ``pieces=True``, for training windows of bounded length, a conversation of up to ``WHOLE_TURNS`` turns and ``WHOLE_BYTES`` bytes is one
row a participant, whatever its turn numbers, and a larger one is cut by position into pieces of ``PIECE`` turns, each after the ``CONTEXT``
turns before it, which stand in the text but in no mask; a piece is rendered for the participants who speak in it, since for others it has
nothing to train on. So every turn with a speaker is trained on exactly once, after what was said before, and the output grows with the input.
Positions are counted without bringing a conversation together: its turns are sorted over all partitions by one range shuffle and numbered
by where their partition begins.

Defined results: turns stand in order of turn (null first), role, text; null text is empty text; a null or empty
role speaks as the user ``unknown`` and has no perspective of its own; null conversation ids are one conversation;
repeated rows are repeated turns; the marker ``<|`` inside texts and names is written ``<\\|``, so that texts
can't forge turns; a turn of any length is kept whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import looked_up, materialise

WHOLE_TURNS, WHOLE_BYTES = 256, 1 << 20
PIECE, CONTEXT = 64, 16
#: Bytes that a task renders at once of one conversation, for all its participants; tasks that blocks are dealt over at most.
RENDER_BYTES, TASKS = 16 << 20, 4096
ME, END = "<|assistant|>\n", "<|end|>\n"
ORDER = ["turn", "name", "body"]


def perspectives(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", pieces: bool = True) -> DataFrame:
    """(conv_id, speaker, piece, n_turns, n_context, text, mask): mask is ``start:end`` of each trained span, comma-joined, in code points of
    the text; n_turns counts the turns of the text, of which the first n_context are context only. Without ``pieces`` every dialogue is whole."""
    safe = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("<\\|"))
    turns = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), safe(F.col(role_col)).alias("name"), safe(F.col(text_col)).alias("body"))
    one_group_at_a_time(turns.sparkSession)
    n, size = F.count(F.lit(1)), F.sum(F.octet_length("name") + F.octet_length("body"))
    if pieces:
        sizes = turns.groupBy("conv_id").agg(n.alias("n"), size.alias("bytes")).where((F.col("n") > WHOLE_TURNS) | (F.col("bytes") > WHOLE_BYTES)).select(F.col("conv_id").alias("big"))
    else:
        names = turns.groupBy("conv_id", "name").agg(n.alias("n"), size.alias("bytes")).groupBy("conv_id")
        sizes = names.agg(F.count(F.expr("nullif(name, '')")).alias("speakers"), (F.sum("bytes") + F.sum("n") * len(_user("") + "unknown" + END)).alias("most"))
        sizes = sizes.where(F.col("speakers") * F.col("most").cast("double") > RENDER_BYTES).withColumn("size", F.greatest(F.lit(1), F.expr(f"{RENDER_BYTES} div speakers")))
        sizes = sizes.select(F.col("conv_id").alias("big"), F.monotonically_increasing_id().alias("id"), "size", F.expr("most div size + 1").alias("blocks"))
    big = materialise(sizes, "big")
    if big.isEmpty():
        return _rendered(turns, ["conv_id"], ORDER)
    named = looked_up(big)
    same = F.col("conv_id").eqNullSafe(F.col("big"))
    small = _rendered(turns.join(named, same, "left_anti"), ["conv_id"], ORDER)
    if pieces:
        return small.unionByName(_rendered(_pieces(turns.join(named, same, "left_semi")), ["conv_id", "piece"], ["nth"]))
    return small.unionByName(_by_blocks(turns.join(named, same), min(big.agg(F.sum("blocks")).first()[0], TASKS)))


def one_group_at_a_time(spark: SparkSession) -> None:
    """Turns come sorted to where they are collected: a task then holds one group, not all those of a hash table."""
    spark.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")


def _by_blocks(turns: DataFrame, tasks: int) -> DataFrame:
    """Whole conversations with much to render. A block has the turns that begin in ``size`` characters, and meets all participants of its conversation."""
    placed = _placed(turns, ["id"], ORDER).withColumn("mine", F.row_number().over(Window.partitionBy("id", "name").orderBy("at")) - 1)
    placed = placed.select("id", "conv_id", F.expr("at div size").alias("block"), "at", "own", "name", "body", "mine")
    names = turns.where("name <> ''").select("id", "conv_id", "blocks", "name").distinct().withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    names = names.select("id", "conv_id", "block", F.lit(None).cast("long").alias("at"), F.lit(False).alias("own"), "name", F.lit("").alias("body"), F.lit(0).alias("mine"))
    keys = ["id", "conv_id", "block"]
    met = _collected(placed.unionByName(names).repartition(tasks, *keys).sortWithinPartitions(*keys), keys, "mine")
    met = met.withColumn("speaker", F.explode(F.expr("transform(filter(turns, t -> t.at IS NULL), t -> t.name)"))).withColumn("turns", F.expr("filter(turns, t -> t.at IS NOT NULL)"))
    parts = _seen(met.where("size(turns) > 0"), "t.mine", *keys)
    keys = ["id", "conv_id", "speaker"]
    parts = parts.repartition(tasks, *keys).sortWithinPartitions(*keys)
    whole = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block", "text", "mask"))).alias("parts"), F.sum("n_turns").alias("n_turns"))
    return whole.select(
        "conv_id", "speaker", F.lit(0).cast("long").alias("piece"), "n_turns", F.lit(0).cast("long").alias("n_context"),
        F.expr("concat_ws('', parts.text)").alias("text"), F.expr("concat_ws(',', filter(parts.mask, m -> m <> ''))").alias("mask"),
    )


def _pieces(turns: DataFrame) -> DataFrame:
    """(conv_id, piece, nth, own, name, body): the turns of large conversations, those of context again in the next piece."""
    order = ["conv_id", *ORDER]
    placed = materialise(turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "turns")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    starts = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))  # as many as conversations and partitions
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = looked_up(materialise(starts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), (before - F.col("first")).alias("shift")), "starts"))
    at = placed.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).withColumn("nth", F.col("at") + F.col("shift"))
    home = F.floor(F.col("nth") / PIECE).cast("long")
    ahead = F.when(F.col("nth") % PIECE >= PIECE - CONTEXT, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    dealt = at.select("conv_id", "nth", "name", "body", home.alias("home"), F.explode(ahead).alias("next"))
    dealt = dealt.withColumn("piece", F.col("home") + F.col("next").cast("long"))
    return dealt.select("conv_id", "piece", "nth", (~F.col("next")).alias("own"), "name", "body")


def _user(name: str) -> str:
    return f"<|user name={name}|>\n"


def _head(name: str) -> str:
    """SQL of the line before a user's turn."""
    before, after = _user("\0").replace("\n", "\\n").split("\0")
    return f"concat('{before}', if({name} = '', 'unknown', {name}), '{after}')"


def _placed(turns: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """With ``at``, where in its group's text each turn begins if all are users."""
    length = F.expr(f"length({_head('name')}) + length(body) + {len(END)}").cast("long")
    so_far = F.sum(length).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    turns = turns if "own" in turns.columns else turns.withColumn("own", F.lit(True))
    return turns.withColumn("at", so_far - length)


def _collected(placed: DataFrame, keys: list[str], *more: str) -> DataFrame:
    return placed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "own", "name", "body", *more))).alias("turns"))


def _rendered(turns: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each group of turns by ``keys``, in ``order``, as seen by each participant who speaks in it."""
    found = _collected(_placed(turns, keys, order), keys)
    found = found.withColumn("speaker", F.explode(F.expr("array_remove(array_distinct(transform(filter(turns, t -> t.own), t -> t.name)), '')")))
    found = _seen(found, "i", *keys)
    return found.select("conv_id", "speaker", F.col("piece") if "piece" in keys else F.lit(0).cast("long").alias("piece"), "n_turns", "n_context", "text", "mask")


def _seen(found: DataFrame, nth: str, *keys: str) -> DataFrame:
    """The turns of each row as its speaker sees them. Each of the speaker's ``nth`` turns before one moves it from ``at`` by the same number."""
    me, end = (x.replace("\n", "\\n") for x in (ME, END))
    text = f"concat_ws('', transform(turns, t -> concat(if(t.name = speaker, '{me}', {_head('t.name')}), t.body, '{end}')))"
    start = f"t.at + {nth} * ({len(ME)}L - length({_head('speaker')})) + {len(ME)}L"
    mask = f"concat_ws(',', transform(filter(turns, t -> t.name = speaker), (t, i) -> if(t.own, concat({start}, ':', {start} + length(t.body) + {len(END) - 1}L), null)))"
    n_context = F.size(F.filter("turns", lambda t: ~t["own"])).cast("long")
    return found.select(*keys, "speaker", F.size("turns").cast("long").alias("n_turns"), n_context.alias("n_context"), F.expr(text).alias("text"), F.expr(mask).alias("mask"))
