"""Dictionary joins, key extraction and page text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from vouch.functions.automaton import Automaton

#: Rows of a dictionary up to which it is sent to all tasks; beyond, its join is by hash.
SMALL = 200_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df, marked for broadcast if it is counted to have few enough rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bytes of the arrays of one shard of a dictionary, and shards that one pass over the texts takes.
SHARD_ROOM, SHARDS = 1 << 26, 4
#: Bytes of text that are searched together.
STRETCH = 1 << 22


def tag_dictionary(texts: DataFrame, terms: DataFrame, longest: int = 4, mode: str = "word") -> DataFrame:
    """doc_id and term, kind of the longest dictionary term in each text; ties by term. Texts without one are left out.

    In mode `word` both sides are compared in lower-case words, terms of up to `longest` of them, in mode `substring` a
    term may stand anywhere. An automaton of the terms reads each text once, whatever their number, and no text is
    shuffled. A dictionary whose automaton would be too large is dealt into shards, SHARDS of which one pass takes.
    """
    known = terms.select(F.lower("term").alias("term"), "kind").filter("term <> ''")
    if mode == "word":
        known = known.filter(F.size(F.split("term", " ")) <= longest)
        words = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+", " "))
        line, around = F.concat(F.lit(" "), words, F.lit(" ")), " "
    elif mode == "substring":
        line, around = F.lower(F.coalesce("text", F.lit(""))), ""
    else:
        raise ValueError(f"mode is word or substring, not {mode}")
    # Of kinds of one term the last counts.
    known = known.groupBy("term").agg(F.max("kind").alias("kind"))
    rows = texts.select("doc_id", line.cast("binary").alias("line"))
    found = None
    for passed in _shards(known, around):
        tagged = _tagged(rows, passed, around)
        found = tagged if found is None else found.unionByName(tagged)
    return _longest(found) if found is not None else rows.select("doc_id", F.lit("").alias("term"), F.lit("").alias("kind")).limit(0)


def _shards(known: DataFrame, around: str) -> Iterator[list[list[tuple[str, str]]]]:
    """The terms of each pass, by shards; no more than one pass's terms are on the driver at a time.

    The number of shards follows from the terms' bytes, taken as if each byte were a state with 100 followers.
    """
    total = known.agg(F.sum(F.octet_length("term") + 2 * len(around))).first()[0]
    n = -(-(total or 0) * 400 // SHARD_ROOM)
    shard = F.pmod(F.xxhash64("term"), F.lit(max(1, n))).cast("int")
    for first in range(0, n, SHARDS):
        shards: dict[int, list[tuple[str, str]]] = {}
        for r in known.withColumn("shard", shard).filter(F.col("shard").between(first, first + SHARDS - 1)).collect():
            shards.setdefault(r.shard, []).append((r.term, r.kind))
        yield [sorted(them, key=lambda t: (len(t[0]), t[0])) for _, them in sorted(shards.items())]


def _tagged(rows: DataFrame, shards: list[list[tuple[str, str]]], around: str) -> DataFrame:
    """doc_id, term and kind of the longest term of each shard in each line."""
    shared = rows.sparkSession.sparkContext.broadcast(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = [Automaton([f"{around}{t}{around}".encode() for t, _ in them]) for them in shared.value]

        def told(ids: pa.Array, lines: list[bytes]) -> Iterator[pa.RecordBatch]:
            for machine, them in zip(machines, shared.value):
                best = machine.greatest(lines)
                hit = np.flatnonzero(best >= 0)
                found = [them[i] for i in best[hit].tolist()]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(hit)), pa.array([t for t, _ in found], pa.string()), pa.array([k for _, k in found], pa.string())], ["doc_id", "term", "kind"])

        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STRETCH, side="right")))
                part = batch.slice(at, upto - at)
                yield from told(part.column(0), part.column(1).to_pylist())
                at = upto

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, term string, kind string")


def _longest(found: DataFrame) -> DataFrame:
    best = found.groupBy("doc_id").agg(F.max_by(F.struct("term", "kind"), F.struct(F.length("term"), F.col("term"), F.col("kind"))).alias("b"))
    return best.select("doc_id", "b.term", "b.kind")


def _once(value: Column, use) -> Column:
    """use(value), for which value is worked out once, however often use takes it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _most_keywords(low: Column, keywords: dict[str, list[str]]) -> Column:
    """Struct of the name with most keywords in a text, the first of equals, and hits and size; no hits, no name."""
    hits = lambda words: F.size(F.filter(F.array(*[F.lit(w.lower()) for w in words]), lambda w: low.contains(w)))
    entries = [F.struct(hits(words).alias("hits"), F.lit(-i).alias("order"), F.lit(name).alias("name"), F.lit(len(words)).alias("size")) for i, (name, words) in enumerate(keywords.items())]
    return F.array_max(F.array(*entries))


def detect_parts(text: Column, types: dict[str, list[str]], countries: dict[str, tuple[list[str], list[str]]], entities: dict[str, list[str]]) -> Column:
    """Struct of type, country and entity that a text's keywords tell, their confidences, and the whole, by 0.4, 0.3 and 0.3.

    A type counts by the share of its keywords, a fifth more from three on; an entity by a third for each, a fifth
    more from two on; a country, the first of which a name stands as a word, by 0.7 and 0.1 for each word that speaks
    for it. countries maps a code to its names and such words.
    """
    most = lambda c: F.least(c, F.lit(1.0))

    def looked_up(low: Column) -> Column:
        country = F.lit(None).cast("struct<code:string,confidence:double>")
        for code, (names, words) in reversed(countries.items()):
            speaks = F.size(F.filter(F.array(*[F.lit(w.lower()) for w in words]), lambda w: low.contains(w))) if words else F.lit(0)
            country = F.when(low.rlike(r"\b(?:" + "|".join(n.lower() for n in names) + r")\b"), F.struct(F.lit(code).alias("code"), most(0.7 + 0.1 * speaks).alias("confidence"))).otherwise(country)
        return F.struct(_most_keywords(low, types).alias("kind"), _most_keywords(low, entities).alias("owner"), country.alias("country"))

    def told(found: Column) -> Column:
        kind, owner, country = found["kind"], found["owner"], found["country"]
        kind_share = most(kind["hits"] / kind["size"] * F.when(kind["hits"] >= 3, 1.2).otherwise(1.0))
        owner_share = most(most(owner["hits"] / 3) * F.when(owner["hits"] >= 2, 1.2).otherwise(1.0))
        sure = [F.when(kind["hits"] > 0, kind_share).otherwise(0.0), F.coalesce(country["confidence"], F.lit(0.0)), F.when(owner["hits"] > 0, owner_share).otherwise(0.0)]
        return F.struct(
            F.when(kind["hits"] > 0, kind["name"]).alias("type"), country["code"].alias("country"), F.when(owner["hits"] > 0, owner["name"]).alias("entity"),
            *[F.round(c, 6).alias(f"{n}_confidence") for n, c in zip(("type", "country", "entity"), sure)], F.round(sure[0] * 0.4 + sure[1] * 0.3 + sure[2] * 0.3, 6).alias("confidence"),
        )

    return _once(_once(F.lower(F.coalesce(text, F.lit(""))), looked_up), told)


def dictionary_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, kind and the number of its one-word terms that a text has."""
    words = texts.select("doc_id", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"))).alias("word"))
    return words.join(terms.select(F.lower("term").alias("word"), "kind").distinct(), "word").groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("hits"))


def detect_document(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, the kind most of whose terms a text has, and their share as confidence; ties by kind."""
    sizes = terms.select(F.lower("term").alias("t"), "kind").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("size"))
    scored = dictionary_counts(texts, terms).join(small(sizes), "kind").withColumn("confidence", F.round(F.col("hits") / F.col("size"), 6))
    order = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "kind")
    return scored.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("doc_id", "kind", "confidence")


def schema_score(text: Column, keywords: list[str]) -> Column:
    """Share of the keywords that a text contains, 0.5 without keywords."""
    if not keywords:
        return F.lit(0.5)
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: low.contains(k))) / len(keywords)


def rank_schemas(texts: DataFrame, schemas: dict[str, list[str]], k: int) -> DataFrame:
    """The k schemas (name to keywords) that fit each text best: doc_id, schema, score, rank; ties go to more keywords, then by name."""
    entries = F.array(*[F.struct(F.lit(n).alias("schema"), schema_score(F.col("text"), ws).alias("score"), F.lit(len(ws)).alias("size")) for n, ws in schemas.items()])
    rows = texts.select("doc_id", F.explode(entries).alias("s")).select("doc_id", "s.*")
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("size"), "schema")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("doc_id", "schema", F.round("score", 6).alias("score"), "rank")


def select_schema(detected: DataFrame, registry: DataFrame) -> DataFrame:
    """The schema for type, country and entity, else for type and country, type and entity, or the type alone: doc_id, schema, step."""
    ids = F.array(F.concat_ws(":", "type", "country", "entity"), F.concat_ws(":", "type", "country"), F.concat_ws(":", "type", "entity"), F.col("type"))
    tried = detected.select("doc_id", F.posexplode(ids).alias("step", "schema"))
    return tried.join(small(registry.select("schema").distinct()), "schema").groupBy("doc_id").agg(F.min(F.struct("step", "schema")).alias("b")).select("doc_id", "b.schema", "b.step")


def suggest_schema(detected: DataFrame, ranked: DataFrame, least: float = 0.7) -> DataFrame:
    """The detected kind where its confidence is above `least`, else the best ranked schema: doc_id, schema, origin."""
    best = ranked.filter("rank = 1").select("doc_id", F.col("schema").alias("ranked"))
    joined = best.join(detected.select("doc_id", "kind", "confidence"), "doc_id", "left")
    sure = F.coalesce(F.col("confidence") > least, F.lit(False))
    return joined.select("doc_id", F.when(sure, F.col("kind")).otherwise(F.col("ranked")).alias("schema"), F.when(sure, "detected").otherwise("text").alias("origin"))


def bank_info(rows: DataFrame, banks: DataFrame) -> DataFrame:
    """Adds the code of each row's bank: of its country, else the bank's default (country null)."""
    own = banks.filter("country is not null").select("bank", "country", F.col("code").alias("own"))
    general = banks.filter("country is null").select("bank", F.col("code").alias("general"))
    return rows.join(own, ["bank", "country"], "left").join(general, "bank", "left").withColumn("code", F.coalesce("own", "general")).drop("own", "general")


def extract_keys(lines: DataFrame, patterns: dict[str, tuple[str, float]]) -> DataFrame:
    """Keys found in lines (doc_id, line_no, line) by patterns: doc_id, line_no, key_name, value, confidence.

    A pattern is a regular expression and its weight. A match at the line's start raises the weight by a tenth,
    one with a captured value by a twentieth, up to 1; without a group the match itself is the value.
    """
    found = []
    for name, (pattern, weight) in patterns.items():
        groups = pattern.count("(") - pattern.count("(?") - pattern.count("\\(") > 0
        matched = F.col("line").rlike(pattern)
        value = F.regexp_extract("line", pattern, 1 if groups else 0)
        raised = F.lit(weight) * F.when(F.col("line").rlike("^(?:" + pattern + ")"), 1.1).otherwise(1.0) * (1.05 if groups else 1.0)
        found.append(F.when(matched, F.struct(F.lit(name).alias("key_name"), F.trim(value).alias("value"), F.round(F.least(raised, F.lit(1.0)), 6).alias("confidence"))))
    return lines.select("doc_id", "line_no", F.explode(F.array_compact(F.array(*found))).alias("k")).select("doc_id", "line_no", "k.*")


def name_line_score(line: Column, position: Column) -> Column:
    """How likely a line is a name: words of letters, few of them, capitals, early on the page; digits and colons speak against it."""
    words = F.size(F.split(F.trim(line), r"\s+"))
    return (
        F.when(line.rlike(r"^[\p{L} .,'\-/]+$"), 30).otherwise(0) + F.when(words.between(2, 5), 20).otherwise(0) + F.when(F.upper(line) == line, 10).otherwise(0)
        + F.when(position < 5, 20).when(position < 15, 10).otherwise(0) - F.when(line.rlike(r"\d"), 30).otherwise(0) - F.when(line.contains(":"), 10).otherwise(0)
    )


def pattern_report(docs: DataFrame, by_name: DataFrame, by_url: DataFrame) -> DataFrame:
    """For each entity the share of its documents hit by name terms and by url terms, and which kind to use.

    docs has doc_id and entity; the others have the doc_ids that were hit.
    """
    name, url = (d.select("doc_id").distinct().withColumn(c, F.lit(True)) for d, c in ((by_name, "n"), (by_url, "u")))
    each = docs.join(name, "doc_id", "left").join(url, "doc_id", "left").groupBy("entity").agg(F.count(F.lit(1)).alias("documents"), F.count_if("n").alias("n"), F.count_if("u").alias("u"))
    share = lambda c: F.round(F.col(c) / F.col("documents"), 6)
    better = F.when((F.col("n") == 0) & (F.col("u") == 0), "none").when(F.col("n") >= F.col("u"), "name").otherwise("url")
    return each.select("entity", "documents", share("n").alias("name_share"), share("u").alias("url_share"), better.alias("recommended"))


class _Text(HTMLParser):
    """Title and main text of a page: script, style and navigation left out."""

    SKIPPED = {"script", "style", "nav", "header", "footer", "aside", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.titled, self.title, self.parts = 0, False, "", []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIPPED
        self.titled = tag == "title"

    def handle_endtag(self, tag):
        self.skip -= tag in self.SKIPPED and self.skip > 0
        self.titled = False

    def handle_data(self, data):
        if self.titled:
            self.title += data
        elif not self.skip and data.strip():
            self.parts.append(" ".join(data.split()))


def pages_to_articles(pages: DataFrame) -> DataFrame:
    """page_id, title, text and paywall of each page; a null page gives empty texts. Paywall tells of a short text that asks to subscribe."""

    def run(frames):
        for frame in frames:
            rows = []
            for page_id, html in zip(frame["page_id"], frame["html"]):
                reader = _Text()
                reader.feed(html or "")
                reader.close()
                text = "\n".join(reader.parts)
                low = text.lower()
                wall = len(text) < 1000 and any(w in low for w in ("subscribe", "sign in to continue", "members only"))
                rows.append((page_id, reader.title.strip(), text, wall))
            yield pd.DataFrame(rows, columns=["page_id", "title", "text", "paywall"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, text string, paywall boolean")


def entities_to_record(entities: DataFrame) -> DataFrame:
    """One record for each document out of its entities (doc_id, kind, value, confidence, position): first name, best email, skills, first three places, mean confidence."""
    of = lambda kind, what: F.when(F.col("kind") == kind, what)
    places = F.array_sort(F.collect_list(of("location", F.struct("position", "value"))))
    return entities.groupBy("doc_id").agg(
        F.min(of("name", F.struct("position", "value")))["value"].alias("name"), F.max(of("email", F.struct("confidence", "value")))["value"].alias("email"), F.array_sort(F.collect_set(of("skill", F.col("value")))).alias("skills"),
        F.slice(F.transform(places, lambda p: p["value"]), 1, 3).alias("places"), F.round(F.avg("confidence"), 6).alias("confidence"),
    )
