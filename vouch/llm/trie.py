"""Prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of turns that conversations begin with. Its smallest member and its depth identify
it, for nodes of one depth have no member in common. Every node has an arc that enters and an arc that leaves it;
the arcs in the order of a walk around the trie are a linked list, which is ranked in parts: where an arc's
follower lies in the same range of arcs, the range is walked in memory, and only arcs that other ranges lead to
remain for the next round. What remains is thinned by rulers where ranges do not help. The arcs are then sorted
by position, and sums over a subtree are the difference of two running sums, at its leaving and at its entering arc.

Digests stand for turns after the first reading, and no conversation, node or parent is ever one task's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize, small
from .scans import scan

#: Arcs that one task ranks in memory.
ARCS = 1 << 17
#: One in so many arcs is a ruler where the list is thinned.
RULERS = 16
#: Conversation ids of a leaf that are joined to one text at a time.
CHUNK = 4096


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), said (digest of role and text) and size (code points of the text) of every turn.

    Turns are ordered by turn, nulls first, then role, then text; null roles and texts count as empty; rows that
    repeat are turns of their own; rows without a conv_id are left out. Only texts of turns tied in role too are sorted.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).filter("conv_id is not null")
    # The role's length keeps role and text apart.
    said = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    place = ["conv_id", "turn", "role"]
    rows = rows.select(*place, said.alias("said"), F.char_length("text").cast("long").alias("size"), "text")
    tied = materialize(rows.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "trie-ties")
    plain = [*place, "said", "size"]
    one = F.lit(1).cast("long").alias("one")
    if tied.isEmpty():
        every = rows.select(*plain, F.lit(0).cast("long").alias("rank"))
    else:
        known = small(tied.select("conv_id", F.col("turn").alias("t"), F.col("role").alias("r")))
        same = (F.col("a.conv_id") == F.col("b.conv_id")) & F.col("a.turn").eqNullSafe(F.col("b.t")) & (F.col("a.role") == F.col("b.r"))
        close = rows.alias("a").join(known.alias("b"), same, "left_semi").select(*plain, "text", F.coalesce("turn", F.lit(-1)).alias("t"), F.col("turn").isNotNull().alias("given"), one)
        ranked = scan(close, ["conv_id", "given", "t", "role"], ["text"], ["one"], label="trie-ranks").select(*plain, F.col("sum_one").alias("rank"))
        every = rows.alias("a").join(known.alias("b"), same, "left_anti").select(*plain, F.lit(0).cast("long").alias("rank")).unionByName(ranked)
    return scan(every.select("*", one), ["conv_id"], ["turn", "role", "rank"], ["one"], label="trie-turns").select("conv_id", F.col("sum_one").alias("pos"), "said", "size")


def _digest(sums: list[Column]) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat_ws(":", *[s.cast("string") for s in sums]), 256), 1, 32))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, said, size, before, prefix: turns (conv_id, depth from 1, said, size) with the rolling hash before and after each.

    The hash of a prefix is the sum of its turns' hashes, each taken together with its depth: four sums of 32 bits
    each, which cannot overflow.
    """
    placed, sums = turns, [f"h{k}" for k in range(4)]
    for k, (seed, right) in enumerate([(11, 0), (11, 32), (12, 0), (12, 32)]):
        h = F.xxhash64(F.lit(seed), "depth", "said")
        placed = placed.withColumn(f"h{k}", F.shiftrightunsigned(F.shiftleft(h, 32) if right == 0 else h, 32))
    after = scan(placed, ["conv_id"], ["depth"], sums, label="trie-hashes")
    return after.select("conv_id", "depth", "said", "size", _digest([F.col(f"sum_{h}") - F.col(h) for h in sums]).alias("before"), _digest([F.col(f"sum_{h}") for h in sums]).alias("prefix"))


def trie_nodes(steps: DataFrame, members: DataFrame) -> DataFrame:
    """conv_id, depth, prefix, before, n_convs, size of every node; the root stands for all members (conv_id, each once).

    Where sequences of one depth have the same hash, they must also have the same hash before and the same last
    turn; then, from turn to turn, they are the same. A clash stops the job with an error.
    """
    found = steps.groupBy("depth", "prefix").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("size").alias("size"),
        F.min("before").alias("before"), F.max("before").alias("before_too"), F.min("said").alias("said"), F.max("said").alias("said_too"),
    )
    same = (F.col("said") == F.col("said_too")) & (F.col("before") == F.col("before_too"))
    checked = found.withColumn("n_convs", F.when(same, F.col("n_convs")).otherwise(F.raise_error("two different conversations have the same prefix hash").cast("long")))
    start = _digest([F.lit(0)] * 4)
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select("conv_id", F.lit(0).cast("long").alias("depth"), start.alias("prefix"), F.lit(b"").alias("before"), "n_convs", F.lit(0).cast("long").alias("size"))
    return checked.select(root.columns).unionByName(root)


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arcs (id, next, dist) of a range, each with the first follower outside it and the distance up to there."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    ids, dist = (table.column(c).to_numpy() for c in ("id", "dist"))
    ahead = table.column("next").fill_null(-1).to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, ahead, dist = ids[order], ahead[order], dist[order]
    at = np.minimum(np.searchsorted(ids, ahead), len(ids) - 1)
    inside = ids[at] == ahead
    jump, way = np.where(inside, at, np.arange(len(ids))), np.where(inside, dist, 0)
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        way, jump = way + way[jump], further
    out, way = ahead[jump], way + dist[jump]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(out, mask=out < 0), pa.array(way)], ["id", "next", "dist"])


ARC = "id long, next long, dist long"


def _ruler(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(RULERS)) == 0


def _thinned(list_: DataFrame) -> DataFrame:
    """Each arc with the first ruler that follows it, by doubling what it looks over until all have met one."""
    closed, left = [], list_
    step = list_.select(F.col("id").alias("next"), F.col("next").alias("next_too"), F.col("dist").alias("dist_too"))
    while True:
        done = F.col("next").isNull() | _ruler("next")
        closed.append(left.filter(done))
        left = left.filter(~done)
        if left.isEmpty():
            break
        left = materialize(left.join(step, "next").select("id", F.col("next_too").alias("next"), (F.col("dist") + F.col("dist_too")).alias("dist")), "trie-thinned")
        ended = closed[0]
        for more in closed[1:]:
            ended = ended.unionByName(more)
        step = left.unionByName(ended).select(F.col("id").alias("next"), F.col("next").alias("next_too"), F.col("dist").alias("dist_too"))
    every = closed[0]
    for more in closed[1:]:
        every = every.unionByName(more)
    return materialize(every, "trie-thinned")


def list_ranks(arcs: DataFrame, most: int = ARCS) -> DataFrame:
    """id and rest of each arc of a list (id, next; null at its end): the arcs from it to the end, itself included.

    A range holds about `most` arcs. Rounds go on until what other ranges lead to fits one of them; a round that
    leaves over half of the arcs is followed by one that leaves about one in RULERS, whatever the order of the ids.
    """
    levels, left = [], materialize(arcs.select("id", "next", F.lit(1).cast("long").alias("dist")), "trie-list")
    n = left.count()
    while True:
        parts = -(-n // most)
        dealt = left.repartition(1) if parts <= 1 else left.repartitionByRange(parts, "id")
        level = materialize(dealt.mapInArrow(_contracted, ARC), "trie-level")
        levels.append(level)
        # Where one task had all arcs, none leads out of it.
        if parts <= 1:
            break
        targets = level.filter("next is not null").select(F.col("next").alias("id")).distinct()
        left = materialize(level.join(targets, "id", "left_semi"), "trie-list")
        remain = left.count()
        if 2 * remain > n:
            level = _thinned(left)
            levels.append(level)
            left = materialize(level.filter(_ruler("id")), "trie-list")
            remain = left.count()
        n = remain
    rest = levels[-1].select("id", F.col("dist").alias("rest"))
    for level in reversed(levels[:-1]):
        rest = level.join(rest.select(F.col("id").alias("next"), F.col("rest").alias("more")), "next", "left").select("id", (F.col("dist") + F.coalesce("more", F.lit(0))).alias("rest"))
    return rest


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (depth, prefix, conv_id) to (depth, prefix, first, ids), CHUNK ids at most in one text."""
    for batch in batches:
        depth, prefix, ids = (c.to_pylist() for c in batch.columns)
        rows, a = [], 0
        while a < len(ids):
            b = a + 1
            while b < len(ids) and b - a < CHUNK and depth[b] == depth[a] and prefix[b] == prefix[a]:
                b += 1
            rows.append((depth[a], prefix[a], ids[a], ",".join(map(str, ids[a:b]))))
            a = b
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.string()))], ["depth", "prefix", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks of ids to one digest a node; a digest takes up one chunk after another, so none holds all."""
    node, digest = None, None

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.string()))], ["depth", "prefix", "ends_sha256"])

    for batch in batches:
        rows = []
        depth, prefix, _, ids = (c.to_pylist() for c in batch.columns)
        for d, p, text in zip(depth, prefix, ids):
            if (d, p) == node:
                digest.update(b"," + text.encode())
                continue
            if node is not None:
                rows.append((*node, digest.hexdigest()))
            node, digest = (d, p), hashlib.sha256(text.encode())
        yield told(rows)
    if node is not None:
        yield told([(*node, digest.hexdigest())])


def end_digests(steps: DataFrame, members: DataFrame) -> DataFrame:
    """depth, prefix and ends_sha256 of nodes where conversations end: SHA-256 of their ids, ascending, joined by commas."""
    last = steps.groupBy("conv_id").agg(F.max(F.struct("depth", "prefix")).alias("last")).select("conv_id", "last.depth", "last.prefix")
    empty = members.join(last, "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("depth"), _digest([F.lit(0)] * 4).alias("prefix"))
    place = ["depth", "prefix", "conv_id"]
    ends = last.unionByName(empty).select(*place)
    chunks = ends.repartitionByRange(*place).sortWithinPartitions(*place).mapInArrow(_chunked, "depth long, prefix binary, first long, ids string")
    return chunks.repartition("depth", "prefix").sortWithinPartitions("depth", "prefix", "first").mapInArrow(_hashed, "depth long, prefix binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame, most: int = ARCS) -> DataFrame:
    """The trie of conversations, a row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, enter_at, leave_at.

    turns has conv_id, depth (1, 2, ... in each conversation), said (a digest of the turn) and size (its code
    points); members has each conv_id once, turnless ones too. conv_id is the node's smallest member, which with
    depth names the node; n_convs counts its members. n_leaves and saved_tokens sum up the subtree with its top:
    childless nodes, and for each node the size of its last turn times its members but one. ends_sha256 is of the
    members that end there. enter_at and leave_at are the places of its arcs in the tour, so a subtree is the
    nodes that enter between them. Without members the result is empty, else there is at least the root.
    """
    steps = materialize(prefixes(turns), "trie-steps")
    members = materialize(members, "trie-members")
    one = F.lit(1).cast("long").alias("one")
    # Numbers in the order of (conv_id, depth): the tour mostly goes from a number to the next.
    nodes = scan(trie_nodes(steps, members).select("*", one), [], ["conv_id", "depth"], ["one"], label="trie-nodes").drop("one").withColumnRenamed("sum_one", "nr")
    # A parent stands before its children in one sorted table, so its number comes to them without a join, be they ever so many.
    above = nodes.select("depth", "prefix", F.lit(0).cast("long").alias("child"), "conv_id", "nr")
    below = nodes.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("before").alias("prefix"), F.lit(1).cast("long").alias("child"), "conv_id", "nr")
    family = scan(above.unionByName(below), ["depth", "prefix"], ["child", "conv_id"], ["child"], ["conv_id", "nr"], label="trie-family").filter("child = 1")
    kids = family.select("nr", F.col("head_nr").alias("parent"), F.col("head_conv_id").alias("parent_conv_id"), F.col("sum_child").alias("nth"))
    kids = materialize(kids, "trie-kids")
    following = kids.select("parent", (F.col("nth") - 1).alias("nth"), F.col("nr").alias("sibling"))
    beside = kids.join(following, ["parent", "nth"], "left").select("nr", "parent", "parent_conv_id", "sibling")
    first = kids.filter("nth = 1").select(F.col("parent").alias("nr"), F.col("nr").alias("eldest"))
    counts = kids.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "nr")
    facts = nodes.join(beside, "nr", "left").join(first, "nr", "left").join(counts, "nr", "left")
    facts = materialize(facts.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).withColumn("saved", (F.col("n_convs") - 1) * F.col("size")), "trie-facts")

    enters, leaves = 2 * F.col("nr"), 2 * F.col("nr") + 1
    arc = lambda id_, next_: F.struct(id_.alias("id"), next_.alias("next"))
    both = F.array(arc(enters, F.coalesce(2 * F.col("eldest"), leaves)), arc(leaves, F.coalesce(2 * F.col("sibling"), 2 * F.col("parent") + 1)))
    ranks = list_ranks(facts.select(F.explode(both).alias("arc")).select("arc.*"), most)
    total = 2 * facts.count()
    place = lambda side: F.max(F.when(F.col("id") % 2 == side, total - F.col("rest")))
    places = ranks.groupBy(F.expr("id div 2").alias("nr")).agg(place(0).alias("enter_at"), place(1).alias("leave_at"))
    placed = materialize(facts.join(places, "nr"), "trie-places")

    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    zero = F.lit(0).cast("long")
    stop = lambda at, leaf, saved, left: F.struct(F.col(at).alias("at"), leaf.alias("leaf"), saved.alias("saved"), F.lit(left).alias("left"))
    stops = placed.select("nr", F.explode(F.array(stop("enter_at", leaf, F.col("saved"), False), stop("leave_at", zero, zero, True))).alias("stop")).select("nr", "stop.*")
    sums = scan(stops, [], ["at"], ["leaf", "saved"], label="trie-tour")
    # Within a subtree: what has been summed up when it is left, less what had been before it was entered.
    side = lambda v, left: F.max(F.when(F.col("left") == left, F.col(f"sum_{v}") - F.when(F.col("left"), zero).otherwise(F.col(v))))
    within = sums.groupBy("nr").agg(*[(side(v, True) - side(v, False)).alias(name) for v, name in (("leaf", "n_leaves"), ("saved", "saved_tokens"))])
    nothing = hashlib.sha256(b"").hexdigest()
    told = placed.join(within, "nr").join(end_digests(steps, members), ["depth", "prefix"], "left")
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"), "enter_at", "leave_at")


def rebuilt(turns: DataFrame, block: int = 100, shares: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations with a beginning in common, from numbered turns (conv_id, pos, said, size): their turns and their ids.

    Conversation c takes the first h turns of c - c % block, all that there are if fewer, and its own turns after
    its first h; h is the unsigned crc32 of the decimal c modulo `shares`.
    """
    members = turns.select("conv_id").distinct()
    h = F.crc32(F.col("conv_id").cast("string")) % shares
    heads = turns.filter((F.col("conv_id") % block == 0) & (F.col("pos") < shares)).withColumnRenamed("conv_id", "head")
    asked = members.select("conv_id", (F.col("conv_id") - F.col("conv_id") % block).alias("head"), h.alias("h")).filter("h > 0")
    taken = asked.join(heads, "head").filter("pos <= h").select("conv_id", F.lit(0).alias("side"), "pos", "said", "size")
    own = turns.filter(F.col("pos") > h).select("conv_id", F.lit(1).alias("side"), "pos", "said", "size")
    every = taken.unionByName(own).select("*", F.lit(1).cast("long").alias("one"))
    return scan(every, ["conv_id"], ["side", "pos"], ["one"], label="trie-rebuilt").select("conv_id", F.col("sum_one").alias("depth"), "said", "size"), members
