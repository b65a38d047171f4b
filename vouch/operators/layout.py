"""Spatial operators over text blocks: one row for each block with doc_id, block_id, text and its box x1, y1, x2, y2 within 0 to 1.

Joins are within a document; a page has few blocks, and documents are dealt over the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _centre(side: str) -> tuple[Column, Column]:
    return (F.col(f"{side}x1") + F.col(f"{side}x2")) / 2, (F.col(f"{side}y1") + F.col(f"{side}y2")) / 2


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Blocks of both sides that share a document, columns named k_ and v_."""
    columns = ["block_id", "text", "x1", "y1", "x2", "y2"]
    a = left.select("doc_id", *[F.col(c).alias(f"k_{c}") for c in columns])
    b = right.select("doc_id", *[F.col(c).alias(f"v_{c}") for c in columns])
    return a.join(b, "doc_id").filter("k_block_id <> v_block_id")


def distance_confidence(distance: Column, most: float = 0.3) -> Column:
    """From 1 at no distance down to 0 at `most`, 0.1 beyond."""
    return F.when(distance > most, 0.1).otherwise(1.0 - distance / most)


def spatial_pairs(keys: DataFrame, blocks: DataFrame, least: float = 0.3) -> DataFrame:
    """The value block of each key block: doc_id, key_block, value_block, relation, confidence, the best one by confidence, then block.

    Fixed values: on a line right of the key counts in full, left 0.8, below 0.95, above 0.7, and askew 0.5.
    """
    (kx, ky), (vx, vy) = _centre("k_"), _centre("v_")
    dx, dy = vx - kx, vy - ky
    near = distance_confidence(F.sqrt(dx * dx + dy * dy))
    line, column = F.abs(dy) < 0.05, F.abs(dx) < 0.1
    relation = F.when(line & (dx > 0), "right").when(line, "left").when(column & (dy > 0), "below").when(column, "above").otherwise("diagonal")
    share = F.when(line & (dx > 0), 1.0).when(line, 0.8).when(column & (dy > 0), 0.95).when(column, 0.7).otherwise(0.5)
    scored = _pairs(keys, blocks).withColumn("relation", relation).withColumn("confidence", F.round(near * share, 6)).filter(F.col("confidence") > least)
    order = Window.partitionBy("doc_id", "k_block_id").orderBy(F.desc("confidence"), "v_block_id")
    return scored.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("doc_id", F.col("k_block_id").alias("key_block"), F.col("v_block_id").alias("value_block"), "relation", "confidence")


def nearby_value(keys: DataFrame, blocks: DataFrame, reach: float = 0.2, content: Column | None = None) -> DataFrame:
    """The block within reach of each key that is best by 0.7 of its content's score and 0.3 of its nearness."""
    (kx, ky), (vx, vy) = _centre("k_"), _centre("v_")
    distance = F.sqrt((vx - kx) * (vx - kx) + (vy - ky) * (vy - ky))
    fits = content if content is not None else F.when(F.col("v_text").rlike(r"\d"), 1.0).otherwise(0.5)
    scored = _pairs(keys, blocks).withColumn("distance", distance).filter(F.col("distance") <= reach).withColumn("score", F.round(fits * 0.7 + (1 - F.col("distance") / reach) * 0.3, 6))
    order = Window.partitionBy("doc_id", "k_block_id").orderBy(F.desc("score"), "v_block_id")
    return scored.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("doc_id", F.col("k_block_id").alias("key_block"), F.col("v_block_id").alias("value_block"), "score")


def block_below(keys: DataFrame, blocks: DataFrame) -> DataFrame:
    """The nearest block below each key whose span overlaps the key's."""
    below = _pairs(keys, blocks).filter("v_y1 >= k_y2 and v_x1 < k_x2 and v_x2 > k_x1")
    return below.groupBy("doc_id", "k_block_id").agg(F.min(F.struct("v_y1", "v_x1", "v_block_id"))["v_block_id"].alias("value_block")).withColumnRenamed("k_block_id", "key_block")


def block_right(keys: DataFrame, blocks: DataFrame) -> DataFrame:
    """The block right of each key of least horizontal gap and twice the vertical one."""
    score = F.round(F.col("v_x1") - F.col("k_x2") + 2 * F.abs(F.col("v_y1") - F.col("k_y1")), 6)
    right = _pairs(keys, blocks).filter("v_x1 >= k_x2").withColumn("score", score)
    return right.groupBy("doc_id", "k_block_id").agg(F.min(F.struct("score", "v_block_id"))["v_block_id"].alias("value_block")).withColumnRenamed("k_block_id", "key_block")


def label_value(labels: DataFrame, blocks: DataFrame, pattern: str, spacing: float = 0.03) -> DataFrame:
    """The value of each label: of the blocks that fit the pattern the first to its right on the line, else the first within two lines below."""
    fit = _pairs(labels, blocks).filter(F.col("v_text").rlike(pattern))
    line = (F.col("v_y1") < F.col("k_y2")) & (F.col("v_y2") > F.col("k_y1")) & (F.col("v_x1") >= F.col("k_x2"))
    below = (F.col("v_y1") >= F.col("k_y2")) & (F.col("v_y1") - F.col("k_y2") <= 2 * spacing)
    tier = F.when(line, 0).when(below, 1)
    found = fit.withColumn("tier", tier).filter("tier is not null")
    return found.groupBy("doc_id", "k_block_id").agg(F.min(F.struct("tier", F.when(F.col("tier") == 0, F.col("v_x1")).otherwise(F.col("v_y1")).alias("gap"), "v_x1", "v_block_id"))["v_block_id"].alias("value_block")).withColumnRenamed("k_block_id", "key_block")


def nearest_in_height(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """The block of least vertical distance to each anchor, such as the country next to an address."""
    gap = F.round(F.abs(F.col("v_y1") - F.col("k_y1")), 6)
    return _pairs(anchors, blocks).groupBy("doc_id", "k_block_id").agg(F.min(F.struct(gap.alias("gap"), "v_block_id"))["v_block_id"].alias("value_block")).withColumnRenamed("k_block_id", "key_block")


def classify_addresses(addresses: DataFrame, holders: DataFrame, banks: DataFrame) -> DataFrame:
    """Whether each address block is the holder's or the bank's, by the nearest anchor; ties and pages without anchors are the holder's."""
    (kx, ky), (vx, vy) = _centre("k_"), _centre("v_")
    nearest = lambda anchors, name: _pairs(addresses, anchors).groupBy("doc_id", "k_block_id").agg(F.round(F.min(F.sqrt((vx - kx) * (vx - kx) + (vy - ky) * (vy - ky))), 6).alias(name))
    both = addresses.select("doc_id", F.col("block_id").alias("k_block_id")).join(nearest(holders, "h"), ["doc_id", "k_block_id"], "left").join(nearest(banks, "b"), ["doc_id", "k_block_id"], "left")
    bank = F.coalesce(F.col("b") < F.col("h"), F.col("b").isNotNull() & F.col("h").isNull())
    return both.select("doc_id", F.col("k_block_id").alias("block_id"), F.when(bank, "bank").otherwise("holder").alias("owner"))


def topmost_country(blocks: DataFrame, countries: dict[str, list[str]], most: int = 3) -> DataFrame:
    """doc_id and country of the uppermost of the first `most` blocks that names one; in a block the first of countries.

    countries maps a code to its name, which may stand inside a block, and to other names, which must be all of it.
    """
    text, out = F.upper(F.trim(F.coalesce("text", F.lit("")))), F.lit(None).cast("string")
    for code, (name, *others) in reversed(countries.items()):
        out = F.when(text.contains(name.upper()) | text.isin([o.upper() for o in others]) if others else text.contains(name.upper()), F.lit(code)).otherwise(out)
    order = Window.partitionBy("doc_id").orderBy("y1", "x1", "block_id")
    told = blocks.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).withColumn("country", out).filter("country is not null")
    return told.groupBy("doc_id").agg(F.min_by("country", "nth").alias("country"))


#: Countries where an address that is not in Latin letters is the holder's rather than the bank's: fixed values.
OWN_SCRIPT = ["TH", "MY", "VN", "ID", "MM", "KH", "LA"]


def address_owners(addresses: DataFrame, holders: DataFrame, banks: DataFrame, country: Column | None = None) -> DataFrame:
    """Whether each address block is the holder's or the bank's, by what it says and then by the nearest anchor: doc_id, block_id, owner.

    One that reads like a bank's is the bank's. A document's only address is the holder's otherwise. Of several, in
    countries of another script and where both kinds occur, those not in Latin letters or garbled are the holder's;
    the rest go to the holder where that anchor is nearer, else to the bank. country is of the addresses' rows.
    """
    from vouch.functions.text import is_bank_address, is_non_latin, is_unreadable

    (kx, ky), (vx, vy) = _centre("k_"), _centre("v_")
    nearest = lambda anchors, name: _pairs(addresses, anchors).groupBy("doc_id", "k_block_id").agg(F.round(F.min(F.sqrt((vx - kx) * (vx - kx) + (vy - ky) * (vy - ky))), 6).alias(name))
    page = Window.partitionBy("doc_id")
    foreign = is_non_latin(F.col("text")) | is_unreadable(F.col("text"))
    rows = addresses.select("doc_id", F.col("block_id").alias("k_block_id"), is_bank_address(F.col("text")).alias("reads"), foreign.alias("foreign"), (country if country is not None else F.lit(None).cast("string")).alias("land"))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(page)).withColumn("mixed", F.bool_or("foreign").over(page) & F.bool_or(~F.col("foreign")).over(page))
    both = rows.join(nearest(holders, "h"), ["doc_id", "k_block_id"], "left").join(nearest(banks, "b"), ["doc_id", "k_block_id"], "left")
    nearer = F.col("h").isNotNull() & (F.col("b").isNull() | (F.col("h") < F.col("b")))
    owner = F.when(F.col("reads"), "bank").when(F.col("n") == 1, "holder").when(F.col("mixed") & F.col("foreign") & F.coalesce(F.col("land").isin(OWN_SCRIPT), F.lit(False)), "holder").when(nearer, "holder").otherwise("bank")
    return both.select("doc_id", F.col("k_block_id").alias("block_id"), owner.alias("owner"))


def assemble_lines(words: DataFrame) -> DataFrame:
    """Lines out of words: those of one rounded height, by position: doc_id, y, line."""
    grouped = words.groupBy("doc_id", F.round("y1", 1).alias("y")).agg(F.array_sort(F.collect_list(F.struct("x1", "block_id", "text"))).alias("w"))
    return grouped.select("doc_id", "y", F.array_join(F.transform("w", lambda w: w["text"]), " ").alias("line"))


def layout_blocks(blocks: DataFrame, dy: float = 0.04, dx: float = 0.3) -> DataFrame:
    """Blocks joined to larger ones while the next in reading order is near: doc_id, group, boxes, and the box around them."""
    order = Window.partitionBy("doc_id").orderBy("y1", "x1", "block_id")
    far = (F.col("y1") - F.lag("y1").over(order) > dy) | (F.abs(F.col("x1") - F.lag("x1").over(order)) > dx)
    grouped = blocks.withColumn("_far", F.coalesce(far, F.lit(False)).cast("int")).withColumn("group", F.sum("_far").over(order))
    return grouped.groupBy("doc_id", "group").agg(F.count(F.lit(1)).alias("boxes"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


#: Beginnings of a line that goes on with an address, and words of the lines before: fixed values.
ADDRESS_LINE = r"(?i)^(?:BLK\s*\d+|#\d+-\d+|\d+\s+[A-Z]+|SINGAPORE\s+\d{6}|[A-Z]+\s+CRESCENT|AVENUE|ROAD|STREET|DRIVE)"
UNIT_LINE, POSTAL_LINE = r"^#\d+-\d+", r"^SINGAPORE\s+\d{6}"
LAST_WORDS, UNIT_WORDS, POSTAL_WORDS = "BLK|STREET|AVENUE|ROAD", "BLK|CRESCENT|AVENUE|STREET", "BLK|CRESCENT|AVENUE|STREET|#"


def content_blocks(blocks: DataFrame, dy: float = 0.05, dx: float = 0.15, near: tuple[float, float] = (0.08, 0.05)) -> DataFrame:
    """Blocks joined to larger ones in reading order: doc_id, group, boxes, the box around them, and text.

    The next block joins the group if it is near the last one; if it reads like a line of an address and is about
    below it; or if it is a unit or postal line and the group reads like an address before. Whether the group does
    depends on where it began, so a page's blocks, which are few, are folded in order as one array.
    """
    box = ["y1", "x1", "block_id", "x2", "y2", "text"]
    pages = blocks.select("doc_id", F.struct(*box[:5], F.coalesce("text", F.lit("")).alias("text")).alias("b")).groupBy("doc_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    start = F.struct(F.lit(0).cast("long").alias("group"), F.lit("").alias("whole"), F.lit("").alias("before"), F.lit("").alias("last"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("x"), F.array().cast("array<long>").alias("groups"))

    def step(state: Column, b: Column) -> Column:
        text = F.trim(b["text"])
        gap_y, gap_x = F.abs(b["y1"] - state["y"]), F.abs(b["x1"] - state["x"])
        said, two = F.upper(state["whole"]), F.upper(F.concat_ws(" ", state["before"], state["last"]))
        unit, postal = text.rlike(UNIT_LINE), text.rlike(POSTAL_LINE)
        line = text.rlike(ADDRESS_LINE)
        joins = ((gap_y <= dy) & (gap_x <= dx)) | (line & (gap_y <= near[0]) & (gap_x <= near[1])) | (~line & (unit | postal) & two.rlike(LAST_WORDS)) | (unit & said.rlike(UNIT_WORDS)) | (postal & said.rlike(POSTAL_WORDS))
        goes_on = F.coalesce(joins, F.lit(False))
        group = state["group"] + F.when(state["y"].isNull() | goes_on, 0).otherwise(1)
        return F.struct(
            group.cast("long").alias("group"), F.when(goes_on, F.concat_ws(" ", state["whole"], b["text"])).otherwise(b["text"]).alias("whole"), F.when(goes_on, state["last"]).otherwise(F.lit("")).alias("before"), b["text"].alias("last"),
            b["y1"].cast("double").alias("y"), b["x1"].cast("double").alias("x"), F.concat(state["groups"], F.array(group.cast("long"))).alias("groups"),
        )

    numbered = pages.select("doc_id", "b", F.aggregate("b", start, step)["groups"].alias("g")).select("doc_id", F.explode(F.arrays_zip("b", "g")).alias("z"))
    grouped = numbered.groupBy("doc_id", F.col("z.g").alias("group")).agg(
        F.count(F.lit(1)).alias("boxes"), F.min("z.b.x1").alias("x1"), F.min("z.b.y1").alias("y1"), F.max("z.b.x2").alias("x2"), F.max("z.b.y2").alias("y2"), F.array_sort(F.collect_list("z.b")).alias("b")
    )
    return grouped.withColumn("text", F.array_join(F.transform("b", lambda x: x["text"]), " ")).drop("b")


def merge_lines(blocks: DataFrame, dy: float = 0.04, dx: float = 0.05) -> DataFrame:
    """Lines of an address: blocks at about one left edge, each near the one above: doc_id, group, text."""
    order = Window.partitionBy("doc_id").orderBy("y1", "x1", "block_id")
    apart = (F.col("y1") - F.lag("y1").over(order) > dy) | (F.abs(F.col("x1") - F.lag("x1").over(order)) > dx)
    grouped = blocks.withColumn("_apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("group", F.sum("_apart").over(order))
    lines = grouped.groupBy("doc_id", "group").agg(F.array_sort(F.collect_list(F.struct("y1", "x1", "block_id", "text"))).alias("l"))
    return lines.select("doc_id", "group", F.array_join(F.transform("l", lambda x: x["text"]), ", ").alias("text"))


def zone(y: Column, top: float = 0.25, bottom: float = 0.8) -> Column:
    """The part of the page that a height lies in."""
    return F.when(y < top, "header").when(y > bottom, "footer").otherwise("body")


def block_type(text: Column) -> Column:
    """What a block holds, by the first that fits: bank, account, address, name, info, date, balance, else unknown."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(low.contains("bank"), "bank").when(low.rlike(r"account|\d{8,15}"), "account").when(low.rlike(r"street|road|avenue|\b\d{5,6}\b"), "address").when(text.rlike(r"^[\p{L} .'-]+$"), "name")
        .when(low.rlike("statement|summary|consolidated|as at|period"), "info").when(low.rlike(r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}"), "date").when(low.rlike(r"balance|\d+\.\d{2}\b"), "balance").otherwise("unknown")
    )


def expand_address(blocks: DataFrame, keywords: list[str], stops: list[str]) -> DataFrame:
    """Blocks of the islands between stop rows that hold an address keyword; of repeated texts the first: doc_id, block_id, island.

    Where an island has keywords in both halves of the page, its blocks in the left half stay.
    """
    holds = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.lower("text").contains(w))
    order = Window.partitionBy("doc_id").orderBy("y1", "x1", "block_id")
    marked = blocks.withColumn("_stop", holds(stops).cast("int")).withColumn("island", F.sum("_stop").over(order)).filter("_stop = 0")
    whole, left = Window.partitionBy("doc_id", "island"), F.col("x1") < 0.5
    seeded = marked.withColumn("_l", F.bool_or(holds(keywords) & left).over(whole)).withColumn("_r", F.bool_or(holds(keywords) & ~left).over(whole)).filter((F.col("_l") | F.col("_r")) & (left | ~(F.col("_l") & F.col("_r")))).drop("_l", "_r")
    first = F.row_number().over(Window.partitionBy("doc_id", "island", "text").orderBy("y1", "x1", "block_id"))
    return seeded.withColumn("_nth", first).filter("_nth = 1").select("doc_id", "block_id", "island")


def marker_box(blocks: DataFrame, marker: str = "<<<", pad: float = 5.0) -> DataFrame:
    """The box around each document's blocks with the marker, padded and not below zero."""
    box = blocks.filter(F.col("text").contains(marker)).groupBy("doc_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    low = lambda c: F.greatest(F.col(c) - pad, F.lit(0.0)).alias(c)
    return box.select("doc_id", low("x1"), low("y1"), (F.col("x2") + pad).alias("x2"), (F.col("y2") + pad).alias("y2"))


def pair_labels(labels: DataFrame, blocks: DataFrame, reach: float = 0.15) -> DataFrame:
    """The nearest block to each label by their centres, within reach: doc_id, key_block, value_block, distance."""
    (kx, ky), (vx, vy) = _centre("k_"), _centre("v_")
    near = _pairs(labels, blocks).withColumn("distance", F.round(F.sqrt((vx - kx) * (vx - kx) + (vy - ky) * (vy - ky)), 6)).filter(F.col("distance") < reach)
    order = Window.partitionBy("doc_id", "k_block_id").orderBy("distance", "v_block_id")
    return near.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("doc_id", F.col("k_block_id").alias("key_block"), F.col("v_block_id").alias("value_block"), "distance")


def line_spacing(blocks: DataFrame, default: float = 12.0) -> DataFrame:
    """Median height of each document's blocks, `default` where none has one."""
    return blocks.groupBy("doc_id").agg(F.coalesce(F.median(F.when(F.col("y2") > F.col("y1"), F.col("y2") - F.col("y1"))), F.lit(default)).alias("spacing"))


def field_confidence(fields: DataFrame, blocks: DataFrame, default: float = 85.0) -> DataFrame:
    """Confidence of each field (doc_id, field, value) from the blocks: that of an equal text, else of one that contains it, scaled by their lengths.

    A field with `date` in its name has the greatest confidence of the blocks that share a word with it.
    """
    seen = fields.join(blocks.select("doc_id", "text", F.col("confidence").alias("c")), "doc_id", "left")
    value, text = F.lower(F.trim("value")), F.lower(F.trim("text"))
    share = F.length(value) / F.length(text)
    words = F.filter(F.split(value, r"\s+"), lambda w: F.length(w) > 1)
    each = seen.groupBy("doc_id", "field").agg(F.max(F.when(F.exists(words, lambda w: text.contains(w)), F.col("c"))).alias("word"), F.max(F.when(value == text, F.col("c"))).alias("same"), F.max(F.when(text.contains(value) & (share > 0.7), F.col("c") * share)).alias("part"))
    return each.select("doc_id", "field", F.round(F.when(F.col("field").contains("date"), F.coalesce("word", F.lit(default))).otherwise(F.coalesce("same", "part", F.lit(default))), 4).alias("confidence"))
