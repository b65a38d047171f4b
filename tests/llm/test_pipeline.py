"""The pipeline against its operators one by one, and the queries' names."""

import uuid
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from vouch.llm import decontaminate, exact_dedup, quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "leaks", "tokens"]


def test_run_is_the_operators_in_turn(spark):
    """What each operator's own report says is removed is removed, and nothing else."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    left = {r.doc_id for r in quality.quality_scores(docs, labels).filter("predicted = 1").collect()}
    rows = docs.filter(docs.doc_id.isin(*left))
    left = {r.doc_id for r in exact_dedup.exact_groups(rows).filter("kept").collect()}
    rows = rows.filter(rows.doc_id.isin(*left))
    left = {r.doc_id for r in simhash.near_components(rows, 5, 5).filter("doc_id = component_id").collect()}
    rows = rows.filter(rows.doc_id.isin(*left))
    left -= {r.doc_id for r in decontaminate.find_leaks(rows, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == left and len(out) == len(left) and all(r.n_tokens > 0 for r in out)


def test_brute_force(spark):
    """The stages by plain loops: table sums, equal strings, all pairs of fingerprints, every item in every stretch, the tokenizer library."""
    import hashlib
    import re

    import numpy as np
    import public_tokenizers
    import tiktoken
    import xxhash

    from vouch.llm import bpe

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None}
    rows = {i: [float(np.float32(v)) for v in quality.features(t)] for i, t in docs.items()}
    usable = sorted(i for i in labels if i in docs and zlib.crc32(str(i).encode()) % 3 != 1)
    model = quality.fit(np.array([rows[i] for i in usable]), np.array([float(labels[i]) for i in usable]))

    def score(x):
        bins = [sum(v >= e for e in edges) for v, edges in zip(x, model.edges)]
        total = model.base + sum(t[b] for t, b in zip(model.tables, bins))
        return total + sum(t[model.coarse[a][bins[a]], model.coarse[b][bins[b]]] for (a, b), t in zip(model.pairs, model.pair_tables))

    left = {i for i in docs if score(rows[i]) >= 0}
    groups = {}
    for i in left:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", docs[i]), []).append(i)
    left = {min(g, key=lambda i: (-len(docs[i]), i)) for g in groups.values()}

    def fingerprint(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 5]).encode(), 42) for i in range(max(1, len(words) - 4))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: fingerprint(docs[i]) for i in left}
    top = {i: i for i in left}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in left:
        for j in left:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 5:
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    left = {i for i in left if root(i) == i}

    items = [t for t in (decontaminate.words_of(r.text or "") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()) if t]

    def leaks(text):
        words = decontaminate.words_of(text)
        for item in items:
            n = len(item)
            stands = any(words[k : k + 5] == item[-5:] for k in range(len(words)))
            for a in range(0, len(words), n):
                common = decontaminate.common_subsequence(item, words[a : a + 3 * n])
                if common >= 0.8 * n or (common >= 0.6 * n and stands):
                    return True
        return False

    left = {i for i in left if not leaks(docs[i])}
    tokenizer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))), special_tokens={})
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) == left
    for i, r in out.items():
        ids = tokenizer.encode_ordinary(docs[i])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_taken_up_again(spark, monkeypatch):
    """A run that broke off in a stage does not repeat those before it."""
    calls = []
    stages = [(name, lambda *a, f=f, name=name: calls.append(name) or f(*a)) for name, f in corpus_pipeline.STAGES]
    broken = [*stages[:3], ("leaks", lambda *a: 1 / 0), stages[4]]
    name = uuid.uuid4().hex
    monkeypatch.setattr(corpus_pipeline, "STAGES", broken)
    with pytest.raises(ZeroDivisionError):
        corpus_pipeline.run(spark, SF, name)
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    first = corpus_pipeline.run(spark, SF, name).count()
    assert calls == ["quality", "exact", "near", "leaks", "tokens"]
    assert corpus_pipeline.run(spark, SF, name).count() == first and len(calls) == 5


@pytest.mark.parametrize("which", ["odd", "none"])
def test_stages_on_odd_tables(spark, which, request):
    """Every stage on nulls, empty and long texts, repeats, and columns with the stages' own names."""
    docs = request.getfixturevalue(which)
    for column in ("known_id", "label", "gone_id", "component_id", "item_id", "stays", "len", "whole", "row_id", "n_tokens"):
        docs = docs.withColumn(column, F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "tokens" or out.columns == docs.columns
        assert out.count() <= docs.count() and (which == "odd") == bool(out.count())


def test_registered():
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
