"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation once after each turn. A rolling hash of the turns so far identifies every prefix;
a conversation whose whole hash is a proper prefix's hash of another one is dropped by an anti-join, of equal
conversations the smallest id stays, and what is left is rendered.

A conversation can be of any length: its turns are numbered, hashed and rendered in blocks, and only the blocks'
counts and sums are brought together for a conversation. Up to rendering, digests stand for the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize, small
from .scans import scan

#: Turn numbers that are handled together; bytes of text that are rendered together.
BLOCK, ROOM = 1024, 1 << 28
#: A turn as rendered: fixed values.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rendered(role: Column, text: Column) -> Column:
    """One turn. Markers inside a text are broken up, so that a text cannot open or close turns."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(OPEN), safe(role), F.lit("\n"), safe(text), F.lit(CLOSE + "\n"))


def usable_turns(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, block, turn, role, text and said, the digest of role and text.

    Null turns come first, null roles count as `user`, null texts as empty; rows without a conv_id are left out.
    """
    filled = [F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")]
    # The role's length keeps role and text apart.
    said = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return conversations.select("conv_id", *filled).filter("conv_id is not null").withColumn("block", F.expr(f"turn div {block}")).withColumn("said", said)


def crowded_blocks(turns: DataFrame, most: int, room: int = ROOM) -> DataFrame | None:
    """conv_id, block, sub, turn, role, said, text of blocks with more than `most` turns, which ties alone can fill, or `room` bytes of text; None without one.

    Their rows are dealt in the turns' order by running sums of rows and bytes, so no part (sub) has more than
    `most` turns, or more than `room` bytes beside its first turn.
    """
    size = F.octet_length("text").cast("long")
    sums = turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    over = materialize(sums.filter((F.col("n") > most) | (F.col("bytes") > room)).select("conv_id", "block"), "chat-crowded")
    if over.isEmpty():
        return None
    rows = turns.join(small(over), ["conv_id", "block"], "left_semi").distinct().withColumn("one", F.lit(1).cast("long")).withColumn("bytes", size)
    told = scan(rows, ["conv_id", "block"], ["turn", "role", "text"], ["one", "bytes"], label="chat-parts")
    sub = F.expr(f"(sum_one - 1) div {most} + (sum_bytes - bytes) div {room}")
    return told.withColumn("sub", sub.cast("long")).drop("one", "bytes", "sum_one", "sum_bytes")


def numbered_turns(turns: DataFrame, crowded: DataFrame | None = None) -> DataFrame:
    """conv_id, block, sub, pos, n_turns, said, before and prefix: the turns in order, with the rolling hash before and after each.

    Turns are ordered by turn, then role, then text; rows equal in all four columns count once.
    said is the digest of role and text, which stands for them, so texts are not carried along; only rows tied in
    turn and role are looked up again to be ordered by text. The hash of a prefix is the sum of its turns' hashes,
    each taken together with its position.
    """
    once = materialize(turns.groupBy("conv_id", "block", "turn", "role", "said").agg(F.lit(1).alias("one")).drop("one"), "chat-turns")
    place = ["conv_id", "block", "turn", "role"]
    once = once.withColumn("sub", F.lit(0).cast("long")) if crowded is None else once.join(crowded.select(*place, "said", "sub"), [*place, "said"], "left").withColumn("sub", F.coalesce("sub", F.lit(0).cast("long")))
    tied = once.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    ranked = once.withColumn("rank", F.lit(0))
    if not tied.isEmpty():
        texts = turns.join(tied, place, "left_semi").select(*place, "said", "text").distinct()
        if crowded is not None:
            texts = texts.join(crowded.select(*place, "said", "sub"), [*place, "said"], "left")
        part = F.coalesce("sub", F.lit(0)) if crowded is not None else F.lit(0)
        ranks = texts.withColumn("rank", F.row_number().over(Window.partitionBy(*place, part).orderBy("text"))).select(*place, "said", "rank")
        ranked = once.join(ranks, [*place, "said"], "left").withColumn("rank", F.coalesce("rank", F.lit(0)))
    cell = ["conv_id", "block", "sub"]
    whole, before = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("block", "sub").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*cell).orderBy("turn", "role", "rank")

    counts = once.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select(*cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"), F.sum("n").over(whole).alias("n_turns"))
    placed = ranked.join(offsets, cell).withColumn("pos", F.col("skip") + F.row_number().over(inside))
    # Four sums of 32-bit numbers: they cannot overflow, and together they are a hash of 128 bits.
    for k, (seed, right) in enumerate([(1, 0), (1, 32), (2, 0), (2, 32)]):
        h = F.xxhash64(F.lit(seed), "pos", "said")
        placed = placed.withColumn(f"h{k}", F.shiftrightunsigned(F.shiftleft(h, 32) if right == 0 else h, 32))
    hashes = [f"h{k}" for k in range(4)]
    placed = materialize(placed.select(*cell, "pos", "n_turns", "said", *hashes), "chat-places")
    sums = placed.groupBy(*cell).agg(*[F.sum(h).alias(h) for h in hashes])
    carried = sums.select(*cell, *[F.coalesce(F.sum(h).over(before), F.lit(0)).alias(f"c{h}") for h in hashes])
    running = Window.partitionBy(*cell).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    after = [F.col(f"c{h}") + F.sum(h).over(running) for h in hashes]
    digest = lambda sums: F.unhex(F.substring(F.sha2(F.concat_ws(":", *[s.cast("string") for s in sums]), 256), 1, 32))
    ended = placed.join(carried, cell).select(*cell, "pos", "n_turns", "said", *hashes, *[a.alias(f"a{h}") for a, h in zip(after, hashes)])
    return ended.select(*cell, "pos", "n_turns", "said", digest([F.col(f"a{h}") - F.col(h) for h in hashes]).alias("before"), digest([F.col(f"a{h}") for h in hashes]).alias("prefix"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are no proper prefix of another, and first of their equals.

    Where prefixes of one length have the same hash, they must also have the same hash before and the same last
    turn; then, from turn to turn, they are the same in content. A clash of hashes stops the job with an error.
    """
    complete = F.col("pos") == F.col("n_turns")
    heads = turns.groupBy("pos", "prefix").agg(
        F.min(F.when(complete, F.col("conv_id"))).alias("first"), F.max(~complete).alias("goes_on"),
        F.min("said").alias("said"), F.max("said").alias("said_too"), F.min("before").alias("before"), F.max("before").alias("before_too"),
    )
    same = (F.col("said") == F.col("said_too")) & (F.col("before") == F.col("before_too"))
    checked = heads.withColumn("first", F.when(same, F.col("first")).otherwise(F.raise_error("two different conversations have the same prefix hash").cast(turns.schema["conv_id"].dataType)))
    whole = checked.filter("first is not null").select(F.col("first").alias("conv_id"), F.col("pos").alias("n_turns"), "prefix")
    inner = heads.filter("goes_on").select(F.col("pos").alias("n_turns"), "prefix")
    return whole.join(inner, ["n_turns", "prefix"], "left_anti").select("conv_id", "n_turns")


def format_chats(conversations: DataFrame, block: int = BLOCK, most: int = 16 * BLOCK, room: int = ROOM) -> DataFrame:
    """Rendered maximal conversations: conv_id, part, n_turns, text.

    A conversation is one row of part 0, or several to be joined by part where it spans several blocks of turn
    numbers, or has more than `most` turns or `room` bytes of text in one block. See usable_turns and numbered_turns for nulls, ties and
    repeated rows; a text of any length is rendered whole, an empty table gives an empty result, and other columns are
    ignored. Texts are read once for this, by conversation and block.
    """
    turns = usable_turns(conversations, block)
    crowded = crowded_blocks(turns, most, room)
    numbered = materialize(numbered_turns(turns, crowded), "chat-prefixes")
    kept = maximal_conversations(numbered).select("conv_id")
    # The blocks of what stays; texts go to them at once, and no conversation lies in one task as a whole.
    cell = ["conv_id", "block", "sub"]
    blocks = numbered.select(*cell, "n_turns").distinct().join(kept, "conv_id", "left_semi")
    blocks = blocks.withColumn("part", F.row_number().over(Window.partitionBy("conv_id").orderBy("block", "sub")) - 1)
    texts = turns.select("conv_id", "block", F.lit(0).cast("long").alias("sub"), "turn", "role", "text")
    if crowded is not None:
        texts = texts.join(crowded.select("conv_id", "block").distinct(), ["conv_id", "block"], "left_anti").select(texts.columns).unionByName(crowded.select(texts.columns))
    line = F.struct("turn", "role", "text")
    parts = texts.join(blocks, cell).groupBy(*cell, "n_turns", "part").agg(F.array_sort(F.collect_set(line)).alias("lines"))
    said = F.transform("lines", lambda x: rendered(x["role"], x["text"]))
    return parts.select("conv_id", "part", F.col("n_turns").cast("long").alias("n_turns"), F.array_join(said, "").alias("text"))
