"""Operators that SQL does not express, by brute force, and the documented cases of others."""

import datetime
import difflib
import itertools
import json
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vouch.functions import automaton, likeness, names, text, vectors as vf
from vouch.operators import extract, fields, metrics, risk, vectors, verify, watch
from vouch.sources import lists, stores
from vouch.streaming import feeds


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def jaro_winkler(a, b):
    """By the definition, letter by letter."""
    if a == b:
        base = 1.0
    elif not a or not b:
        return 0.0
    else:
        reach, used, pairs = max(0, max(len(a), len(b)) // 2 - 1), set(), []
        for i, x in enumerate(a):
            j = next((j for j in range(len(b)) if j not in used and abs(i - j) <= reach and b[j] == x), None)
            if j is not None:
                used.add(j)
                pairs.append(x)
        if not pairs:
            base = 0.0
        else:
            half = sum(x != b[j] for x, j in zip(pairs, sorted(used))) / 2
            base = (len(pairs) / len(a) + len(pairs) / len(b) + (len(pairs) - half) / len(pairs)) / 3
    same = len(list(itertools.takewhile(lambda p: p[0].lower() == p[1].lower(), zip(a[:4], b[:4]))))
    return min(1.0, base + same * 0.1 * (1 - base))


def test_jaro_winkler(spark):
    rng = random.Random(1)
    pairs = [("", ""), ("a", ""), ("abcx", "abzzzzzzz"), ("MARTHA", "marhta")] + [tuple("".join(rng.choice("abcd ") for _ in range(rng.randrange(12))) for _ in range(2)) for _ in range(300)]
    frame = spark.createDataFrame(pairs, "a string, b string")
    for r in frame.select("a", "b", names.jaro_winkler(F.col("a"), F.col("b")).alias("s")).collect():
        assert abs(r.s - jaro_winkler(r.a, r.b)) < 1e-9, (r.a, r.b)


def test_names(spark):
    cleaned = {"Mr. JOHN DOE": "JOHN DOE", "MANOGARAN S/O THANABALAN": "MANOGARAN THANABALAN", "RAVI D/O KRISHNA": "RAVI KRISHNA", "Sri PRIYA A/L KUMAR": "PRIYA KUMAR", "null GAURAV RUSTAGI": "GAURAV RUSTAGI", "": None, "Drake": "Drake"}
    frame = spark.createDataFrame([(k,) for k in cleaned], "a string")
    assert {r.a: r.b for r in frame.select("a", names.clean_name(F.col("a")).alias("b")).collect()} == cleaned
    tokens = [set(one(spark, names.name_tokens(F.lit(n)))) for n in ("DERIPASKA, Oleg Vladimirovich", "Dr. Nicolás  Ñandú")]
    assert tokens == [{"deripaska", "oleg", "vladimirovich"}, {"nicolas", "nandu"}]


def test_births(spark):
    cases = [("1980-05-15", "1980-05-15", True), ("1980-05-15", "1980-05", True), ("1980-05-15", "1980", True), ("1980-05-15", "1975 to 1985", True), ("1980-05-15", "1990", False), ("1980-05-15", "1980-06", False), ("1980-05-15", None, False), (None, "1980", True)]
    frame = spark.createDataFrame(cases, "a string, b string, expected boolean")
    assert all(r.m == r.expected for r in frame.withColumn("m", watch.dob_match(F.col("a"), F.col("b"))).collect())


def test_countries(spark):
    cases = [("usa", "United States;France", "exact", True), ("us", "russia", "substring", True), ("us", "russia", "exact", False), ("uk", "Great Britain", "exact", True), ("france", None, "exact", False), (None, "x", "exact", True)]
    for a, b, mode, expected in cases:
        assert one(spark, watch.country_match(F.lit(a).cast("string"), watch.split_countries(F.lit(b).cast("string")), mode)) == expected


def test_match_names_loses_nothing(spark):
    rng = random.Random(2)
    people = lambda n: [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 5))) for _ in range(n)]
    subjects, entries = people(40), people(60)
    left = spark.createDataFrame(list(enumerate(subjects)), "subject_id long, full_name string")
    right = spark.createDataFrame(list(enumerate(entries)), "entry_id long, name string")
    brute = set()
    for i, j in itertools.product(range(40), range(60)):
        a, b = set(subjects[i].split()), set(entries[j].split())
        if a and b and len(a & b) / len(a) * 0.7 + len(a & b) / len(a | b) * 0.3 >= 0.5:
            brute.add((i, j))
    assert {(r.subject_id, r.entry_id) for r in watch.match_names(left, right).collect()} == brute


def test_event_types_and_news(spark):
    kinds = {"a civil suit and he was convicted": "civil_lawsuit", "He Pleaded Guilty": "conviction", "charges dropped": "cleared", "under investigation": "investigation", "was sued": "allegation", "nothing": "unknown"}
    for said, kind in kinds.items():
        assert one(spark, risk.event_type(F.lit(said))) == kind
    found = one(spark, risk.news_analysis(F.lit("fraud and audit"), F.lit(datetime.date(2024, 5, 1)), datetime.date(2024, 6, 1)))
    assert (found.level, found.points, found.keywords) == ("critical", 100.0, ["fraud", "audit"])


def test_consistency(spark):
    rows = [("a", "Jo Lee"), ("a", "jo lee"), ("a", "Jo Leigh"), ("b", "x"), ("c", "same"), ("c", "same"), ("d", None)]
    found = {r.k: r.consistency for r in verify.consistency(spark.createDataFrame(rows, "k string, v string"), "k", "v").collect()}
    scores = [round(jaro_winkler(x.lower(), y.lower()), 4) for x, y in itertools.combinations(["Jo Lee", "jo lee", "Jo Leigh"], 2)]
    assert found == {"a": round(sum(scores) / 3 * 100, 2), "b": 100.0, "c": 100.0}


def test_vectors(spark):
    assert one(spark, vf.vec_distance(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) is None
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 16))
    store = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [0.0] * 16)], "vec_id long, embedding array<double>")
    queries = store.filter("vec_id % 50 = 0 and vec_id < 900").select(F.col("vec_id").alias("query_id"), "embedding")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for metric, d in (("cosine", 1 - unit @ unit.T), ("euclidean", np.linalg.norm(x[:, None] - x[None], axis=2)), ("angular", np.arccos(np.clip(unit @ unit.T, -1, 1)) / np.pi), ("euclidean_l2", np.linalg.norm(unit[:, None] - unit[None], axis=2))):
        found = vectors.search_exact(queries, store, metric, k=5).filter("vec_id < 900").collect()
        for q in range(0, 300, 50):
            assert {r.vec_id for r in found if r.query_id == q} >= set(np.argsort(d[q])[:4].tolist())
    assert {r.rank for r in vectors.search_exact(queries, store, threshold=0.0, k=3, similarity=True).collect()} == {1, 2, 3}
    assert all(r.vec_id != r.query_id for r in vectors.search_exact(queries, store, k=1, others=True).collect())


@pytest.mark.parametrize("block", [4096, 40])
def test_grid(spark, monkeypatch, block):
    """Counters, first matches, pairs and duplicates against plain loops, in one cell and in many."""
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    monkeypatch.setattr(vectors, "STORE_BLOCK", block)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((150, 8))
    label = rng.integers(0, 4, 150)
    store = spark.createDataFrame([(i, v.tolist(), int(n), int(i * 7 % 150)) for i, (v, n) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label int, arrival long")
    queries = store.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - unit @ unit.T, 6)
    for r in vectors.match_counters(queries, store, 0.3, 0.1).collect():
        near = 1 - d[r.query_id]
        assert (r.found, r.matched, r.low_confidence, r.not_matched) == (150, (near >= 0.3).sum(), ((near < 0.3) & (near >= 0.1)).sum(), (near < 0.1).sum())
    for r in vectors.first_match(queries.drop("label"), store.drop("label"), 0.3).collect():
        order = sorted(range(150), key=lambda i: -(i * 7 % 150))
        stop = next(k for k, i in enumerate(order) if d[r.query_id, i] <= 0.3)
        assert (r.vec_id, r.checked, r.best_similarity) == (order[stop], stop + 1, round(1 - d[r.query_id, order[: stop + 1]].min(), 4))
    counts = vectors.distance_counts(queries, store).collect()
    assert sum(r.n for r in counts) == 50 * 150 and sum(r.n for r in counts if r.same) == sum((label == label[q]).sum() for q in range(0, 150, 3))
    pairs = {(r.vec_a, r.vec_b): r.same for r in vectors.make_pairs(queries, store).collect()}
    assert pairs == {(a, b): bool(label[a] == label[b]) for a in range(0, 150, 3) for b in range(150) if a != b and (b % 3 or a < b)}
    faces = store.select("vec_id", F.col("label").alias("identity"), (F.col("vec_id") % 2).alias("model"), "embedding")
    twins = [tuple(r) for r in vectors.duplicate_identities(faces, 0.5, block).collect()]
    assert sorted(twins) == sorted((a, b, d[a, b]) for a in range(150) for b in range(a + 1, 150) if a % 2 == b % 2 and label[a] != label[b] and d[a, b] < 0.5)


def clustered(seed=6, clusters=60, each=40, size=24, spread=0.25):
    rng = np.random.default_rng(seed)
    return np.concatenate([c + spread * rng.standard_normal((each, size)) for c in rng.standard_normal((clusters, size))])


@pytest.mark.parametrize("block", [4096, 16])
def test_index_recall(spark, monkeypatch, block):
    """Clustered vectors: nine tenths of the true neighbours, whole vectors read for few; the index grows by what it lacks, and lists are dealt by size."""
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    monkeypatch.setattr(vectors, "STORE_BLOCK", block)
    x = clustered()
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [1.0]), (9002, [0.0] * 24)]
    store = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = store.filter("vec_id % 50 = 0 and vec_id < 9000").select(F.col("vec_id").alias("query_id"), "embedding")
    index = vectors.fit_index(store.filter("vec_id < 9000"))
    table = vectors.build_index(store.filter("vec_id < 2000"), index)
    table = table.unionByName(vectors.build_index(store, index, table)).cache()
    assert table.count() == len(x) == table.select("vec_id").distinct().count()
    # Two dimensions of a double each are one byte.
    assert {len(r.code) for r in table.collect()} == {12}
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4096)
    monkeypatch.setattr(vectors, "STORE_BLOCK", 4096)
    true = {(r.query_id, r.vec_id) for r in vectors.search_exact(queries, store, k=10).collect()}
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    monkeypatch.setattr(vectors, "STORE_BLOCK", block)
    found = {(r.query_id, r.vec_id) for r in vectors.search_ann(queries, store, table, index, 10, probes=4).collect()}
    assert len(true & found) >= 0.9 * len(true)
    near = vectors.search_candidates(queries, table, index, 30, probes=4)
    assert near.count() == 30 * queries.count() <= 0.1 * queries.count() * len(x)
    nothing = vectors.build_index(store.limit(0), vectors.fit_index(store.limit(0)))
    assert nothing.count() == 0 and vectors.search_ann(queries, store, nothing, vectors.fit_index(store.limit(0)), 5).count() == 0


def test_index_recall_of_the_given_vectors(spark):
    """Nine tenths, though the vectors have no structure; whole vectors are read for a tenth of the pairs at most."""
    from vouch.plans import evaluation

    sf_dir = "/root/testdata/sf0.01"
    true = {(r.query_id, r.vec_id) for r in evaluation.v4k(spark, sf_dir).collect()}
    found = {(r.query_id, r.vec_id) for r in evaluation.v7(spark, sf_dir).collect()}
    assert len(true & found) >= 0.9 * len(true)
    store, queries = evaluation._store(spark, sf_dir), evaluation._queries(spark, sf_dir)
    index = vectors.fit_index(store)
    assert vectors.search_candidates(queries, vectors.build_index(store, index), index, 30, 64).count() <= 0.1 * queries.count() * store.count()


def test_join_prunes(spark, capsys):
    """No pair is lost by the bounds, on vectors in clusters and on the given ones; the share of work that they save is printed."""
    given = np.stack([r.embedding for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()]).astype(float)
    for name, x, threshold in (("clustered", clustered(7, 20, 20, 24), 0.2), ("given", given, 0.6)):
        faces = spark.createDataFrame([(i, i % 7, i % 2, True, v.tolist()) for i, v in enumerate(x)], "vec_id long, identity long, model long, fresh boolean, embedding array<double>")
        space = vectors.fit_space(faces, 16)
        dealt = vectors.dealt_blocks(faces, space, 25).cache()
        kept = vectors.block_pairs(dealt, space, threshold).collect()
        pairs = sum(r.n_a * r.n_b for r in kept)
        whole = sum(n * (n + sum(m for k, m in enumerate(sizes) if k != i)) for sizes in ([r["count"] for r in dealt.filter(F.col("model") == m).groupBy("cell", "part").count().collect()] for m in (0, 1)) for i, n in enumerate(sizes))
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        i, j, work = vectors.near_units(unit, unit, 1 - threshold, space.directions)
        found = sorted(tuple(r)[:3] for r in vectors.similar_pairs(faces, threshold, 25, space).collect())
        d = np.round(1 - unit @ unit.T, 6)
        assert found == sorted((a, b, d[a, b]) for a in range(len(x)) for b in range(a + 1, len(x)) if a % 2 == b % 2 and a % 7 != b % 7 and d[a, b] < threshold) and found
        with capsys.disabled():
            print(f"\n{name}: {1 - 2 * pairs / (whole + sum(r['count'] ** 2 for r in dealt.groupBy('model', 'cell', 'part').count().collect())):.0%} of pairs dropped with their blocks, {1 - work / (unit.size * len(unit)):.0%} of products by the bound")
        assert work < unit.size * len(unit) and (name == "given" or pairs < 0.25 * len(x) ** 2)
    assert vectors.similar_pairs(faces.limit(0), 0.5).count() == 0


@pytest.mark.parametrize("block", [4096, 12])
def test_checked_faces(spark, block):
    """New vectors one after another, each against the store and those accepted before it."""
    rng = np.random.default_rng(8)
    x = clustered(9, 12, 12, 6, 0.4)
    rng.shuffle(x)
    face = lambda i: (i, int(rng.integers(0, 5)), int(rng.integers(0, 2)), x[i].tolist())
    store, new = [face(i) for i in range(60)], [face(i) for i in range(60, 144)]
    new += [(200, 1, 0, None), (201, 1, 0, []), (202, 1, 0, [0.0] * 20 + [1.0]), (5, 1, 0, x[5].tolist())]
    schema = "vec_id long, identity long, model long, embedding array<double>"
    held, expected = list(store), {}
    distance = lambda a, b: round(1 - np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)), 6)
    for i, who, model, v in sorted(new):
        if v is None or not any(v[:20]):
            expected[i] = ("invalid", None, None)
        elif i < 60:
            expected[i] = ("known", None, None)
        else:
            near = min(((distance(v, w), j) for j, other, m, w in held if m == model and other != who and distance(v, w) < 0.1), default=None)
            expected[i] = ("duplicate", near[1], near[0]) if near else ("accepted", None, None)
            if not near:
                held.append((i, who, model, v))
    frames = [spark.createDataFrame(r, schema) for r in (store, new)]
    told = vectors.checked_faces(*frames, 0.1, block)
    assert {r.vec_id: (r.status, r.of, r.distance) for r in told.collect()} == expected
    assert len({s for s, *_ in expected.values()}) == 4 and any(j is not None and j >= 60 for _, j, _ in expected.values())
    assert sorted(r.vec_id for r in vectors.append_faces(*frames, told).collect()) == sorted(i for i, *_ in held)


def test_nearest_face(spark):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((90, 6))
    rows = [(i, i % 4, i % 3, v.tolist()) for i, v in enumerate(x)] + [(95, 9, 0, x[3].tolist()), (96, 9, 7, x[3].tolist())]
    faces = spark.createDataFrame(rows, "vec_id long, identity long, model long, embedding array<double>")
    asked = faces.filter("vec_id % 5 = 0 or vec_id > 90").withColumnRenamed("vec_id", "query_id")
    d = lambda a, b: round(1 - np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)), 6)
    for scope, fits in (("any", lambda a, b: True), ("own", lambda a, b: a == b), ("others", lambda a, b: a != b)):
        expected = {}
        for i, who, model, v in rows:
            near = min(((d(v, w), j, other) for j, other, m, w in rows if j != i and m == model and fits(who, other)), default=None)
            if near and (i % 5 == 0 or i > 90):
                expected[i] = (near[1], near[2], near[0], near[0] < 0.3)
        assert {r.query_id: (r.vec_id, r.identity, r.distance, r.matched) for r in vectors.nearest_face(asked, faces, 0.3, scope).collect()} == expected
    with pytest.raises(ValueError):
        vectors.nearest_face(asked, faces, 0.3, "none")


def test_calibration(spark):
    rng = np.random.default_rng(4)
    pairs = spark.createDataFrame([(float(d), bool(s)) for s in (True, False) for d in rng.normal(0.4 if s else 0.8, 0.1, 300)], "distance double, same boolean")
    fitted = vectors.fit_confidence(pairs).first()
    assert fitted["w"] < 0 and fitted["max_true"] > fitted["max_false"] and fitted["min_false"] < fitted["min_true"]
    best = vectors.best_threshold(pairs).first()
    assert 0.5 < best.threshold < 0.7 and best.accuracy > 0.93
    c = lambda d, same: one(spark, vectors.confidence(F.lit(d), F.lit(same), fitted["w"], fitted["b"], 0.9, (fitted["min_true"], fitted["max_true"]), (fitted["min_false"], fitted["max_false"])))
    assert c(0.3, True) > c(0.5, True) >= 51 and c(0.9, False) <= c(0.65, False) <= 49


def test_metrics_at_the_edges(spark):
    frame = lambda rows: spark.createDataFrame(rows, "image_id string, pred double, target int")
    right, wrong, single = frame([("a", 1.0, 1), ("a", 0.0, 0)]), frame([("a", 0.0, 1), ("a", 1.0, 0)]), frame([("a", 0.3, 0), ("a", 0.9, 0)])
    assert metrics.weighted_mcc(right, "pooled").first()[0] == 1.0 and metrics.weighted_mcc(wrong, "pooled").first()[0] == -1.0
    assert metrics.auroc(single).first()[0] == 0.0 and metrics.mean_auroc(single).first()[0] == 0.0 and metrics.fpr(frame([("a", 0.3, 1)])).first()[0] == 0.0
    assert metrics.auroc(right).first()[0] == 1.0 and metrics.auroc(frame([("a", 0.5, 1), ("a", 0.5, 0)])).first()[0] == 0.5
    assert metrics.weighted_f1(frame([])).first()[0] == 0.0


def test_profile_similarity(spark):
    a = spark.createDataFrame([(float(x),) for x in range(100)], "value double")
    same = metrics.profile_similarity(a, a, 0.0, 100.0).first()
    assert tuple(same) == (1.0, 0.0, 0.0, 1.0)
    assert metrics.profile_similarity(a, a.select((F.col("value") + 200).alias("value")), 0.0, 400.0).first().overlap == 0.0


def test_dates_and_fields(spark):
    day = datetime.date
    for given, date in {"10 NOV 1992": day(1992, 11, 10), "10/11/1992": day(1992, 11, 10), "1992-11-10": day(1992, 11, 10), "11/25/1992": day(1992, 11, 25), "19921110": day(1992, 11, 10), "31/02/1992": None, "": None}.items():
        assert one(spark, text.parse_date(F.lit(given))) == date
    split = one(spark, text.split_dates(F.lit("paid 10NOV1992 to Jo on 1992-11-12")))
    assert split.dates == [day(1992, 11, 10), day(1992, 11, 12)] and split.rest == "paid to Jo on"
    for given, why in {"4111 1111 1111 1111": "credit_card", "4111-1111-1111-1112": None, "XXXX1234": "masked", "12a4": "not_digits", "123": "length", "": "empty"}.items():
        assert one(spark, text.validate_account(F.lit(given), F.lit(8), F.lit(16))) == why
    assert one(spark, text.extract_account(F.lit("card 12 account 1234-5678 90, 1234567890123456789"))) == "1234567890"
    assert one(spark, text.extract_iban(F.lit("to GB82 WEST 1234 5698 7654 32 now"))) == "GB82WEST12345698765432"
    assert [one(spark, text.parse_amount(F.lit(x))) for x in ("$1,234.50", "(12.00)", "-3", "n/a")] == [1234.5, -12.0, -3.0, None]


def test_pages(spark):
    pages = spark.createDataFrame([(1, "<html><head><title> A &amp; B</title><style>p{}</style></head><body><nav>menu</nav><p>One</p>\n<p>two <b>three</b></p><script>x</script></body>"), (2, None), (3, "<p>Please subscribe to read</p>")], "page_id long, html string")
    found = {r.page_id: (r.title, r.text, r.paywall) for r in extract.pages_to_articles(pages).collect()}
    assert found == {1: ("A & B", "One\ntwo\nthree", False), 2: ("", "", False), 3: ("", "Please subscribe to read", True)}


def test_sources(spark, tmp_path):
    (tmp_path / "truth.json").write_text(json.dumps({"a": {"forged": True}, "b": {"forged": False}}))
    assert {r.item_id for r in lists.read_ground_truth(spark, str(tmp_path / "truth.json")).collect()} == {"a", "b"}
    (tmp_path / "dict.json").write_text(json.dumps({"bank": ["One", "one"], "city": ["Two"]}))
    assert {tuple(r) for r in lists.read_dictionaries(spark, str(tmp_path / "dict.json")).collect()} == {("bank", "one"), ("city", "two")}
    (tmp_path / "pairs.csv").write_text("file_x,file_y,decision\na,b,Yes\n")
    assert tuple(lists.read_pairs(spark, str(tmp_path / "pairs.csv")).first()) == ("a", "b", "Yes")
    files = lists.file_inventory(spark, str(tmp_path)).collect()
    assert {r.extension for r in files} == {"json", "csv"} and all(len(r.hash) == 64 for r in files)
    faces = spark.createDataFrame([(1, "a", [1.0]), (2, "a", [1.0]), (3, "b", [2.0])], "vec_id long, face string, embedding array<double>")
    fresh, again = stores.register_embeddings(faces, faces.filter("vec_id = 3"))
    assert [r.vec_id for r in fresh.collect()] == [1] and sorted(r.vec_id for r in again.collect()) == [2, 3]
    configured = faces.withColumns({"model_name": F.col("face"), "detector_backend": F.lit("d"), "aligned": F.lit(True), "l2_normalized": F.lit(False)})
    stores.write_embeddings(configured, str(tmp_path / "store"))
    assert stores.read_embeddings(spark, str(tmp_path / "store"), model_name="b").count() == 1
    for bucket in (5, 6):
        stores.write_index(spark.createDataFrame([(1, bucket)], "vec_id long, bucket long"), str(tmp_path / "index"), {"model": "m"})
    stores.write_index(spark.createDataFrame([(2, 7)], "vec_id long, bucket long"), str(tmp_path / "index"), {"model": "n"})
    assert sorted(r.bucket for r in spark.read.parquet(str(tmp_path / "index")).collect()) == [6, 7]


def test_hold_trigger(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, i, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i), rng.random() < 0.7) for k in (1, 2) for i in range(200)]
    spark.createDataFrame(rows, "key long, id long, ts timestamp, hit boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, id long, ts timestamp, hit boolean").parquet(str(tmp_path / "in"))
    found = {(r.key, r.id) for r in feeds.drain(feeds.hold_trigger(stream, 3, 10), str(tmp_path / "out")).collect()}
    brute = set()
    for key in (1, 2):
        run = free = 0
        for _, i, _, hit in (r for r in rows if r[0] == key):
            if i < free:
                continue
            run = run + 1 if hit else 0
            if run == 3:
                brute.add((key, i))
                run, free = 0, i + 10
    assert found == brute


NAMED = [("John Smith", "Jon Smith"), ("O'Brien, Mary", "Mary OBrien"), ("", "x"), (None, "abc"), ("abc", None), ("Æon Ltd.", "aeon ltd"), ("same", "same"), ("crate", "trace"), ("dwayne", "duane"), ("ab", "ba")]


def test_name_similarity(spark):
    """Against the definition, on names without punctuation."""
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(NAMED)], "i int, a string, b string")
    bare = lambda x: re.sub(r"[^\w\s]|_", "", x or "").lower()
    for r in rows.select("i", names.name_similarity(F.col("a"), F.col("b")).alias("s")).collect():
        a, b = map(bare, NAMED[r.i])
        assert abs(r.s - jaro_winkler(a, b)) < 1e-9, NAMED[r.i]


def test_true_matches(spark):
    subjects = spark.createDataFrame([(1, "John Smith"), (2, "Mary Jones")], "subject_id int, full_name string")
    listed = [(1, 10, 0.9, "Jon Smith", [("dob", "MATCHED")]), (1, 11, 0.4, "John Smith", []), (1, 12, 0.9, "John Smith", [("dob", "NOT_MATCHED"), ("x", "MATCHED")]), (2, 13, 0.9, "Zed Quux", None), (2, 14, 0.5, "Mary Jonas", None), (3, 15, 1.0, "Nobody", [])]
    results = spark.createDataFrame(listed, "subject_id int, result_id int, strength double, matched_name string, secondary array<struct<field:string,status:string>>")
    found = {r.result_id: r.similarity for r in fields.true_matches(results, subjects, 0.5, 0.8).collect()}
    names_of = {1: "john smith", 2: "mary jones"}
    expected = {i: round(jaro_winkler(names_of[s], n.lower()), 4) for s, i, strength, n, sec in listed if s in names_of and strength >= 0.5 and all(x[1] != "NOT_MATCHED" for x in sec or [])}
    assert found == {i: v for i, v in expected.items() if v >= 0.8} and set(found) == {10, 14}


def test_text_and_label_match(spark):
    texts = ["the widget is red", "a wigdet here", "gadget", "", None, "xyz", "WIDGAT", "fidget gidgets"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in rows.select("i", fields.text_match(F.col("t"), F.lit("Widgat")).alias("m"), fields.label_match(F.col("t"), F.lit("gidget")).alias("l")).collect():
        low = (texts[r.i] or "").lower()
        near = difflib.get_close_matches("widgat", low.split(), 1, 0.3)
        assert abs(r.m - (100.0 if "widgat" in low else round(jaro_winkler(near[0], "widgat") * 100, 2) if near else 0.0)) < 1e-9, texts[r.i]
        short, long = sorted((low, "gidget"), key=len)
        best = max((difflib.SequenceMatcher(None, long[i : i + len(short)], short, autojunk=False).ratio() for i in range(len(long) - len(short) + 1)), default=0.0) if short else 0.0
        assert r.l == ("gidget" in low or best * 100 >= 75), texts[r.i]


@pytest.mark.parametrize("room, shards", [(1 << 26, 4), (4000, 2)])
def test_dictionaries(spark, monkeypatch, room, shards):
    """One shard or many, in one pass or several, against all terms in turn."""
    monkeypatch.setattr(extract, "SHARD_ROOM", room)
    monkeypatch.setattr(extract, "SHARDS", shards)
    rng = random.Random(7)
    plain = {i: " ".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 5))) for _ in range(8)) for i in range(60)} | {90: "", 91: "", 92: "x ab-C  a" * 50}
    texts = spark.createDataFrame([(i, t if i != 90 else None) for i, t in plain.items()], "doc_id int, text string")
    known = [("ab", "two"), ("c", "one"), ("abc a", "words"), ("bca", "three"), ("b", "one"), ("b", "letter"), ("cab b", "words"), ("é", "one"), ("ab c a", "words")]
    known += [("".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 4))), f"k{i}") for i in range(40)]
    terms = spark.createDataFrame([*known, ("", "none"), ("AB", "two")], "term string, kind string")
    got = lambda mode: sorted(map(tuple, extract.tag_dictionary(texts, terms, 2, mode).collect()))
    best = lambda hits: max(hits, key=lambda t: (len(t[0]), *t), default=None)
    assert got("substring") == sorted((d, *b) for d, t in plain.items() if (b := best([k for k in known if k[0] in t.lower()])))
    line = lambda t: " " + re.sub(r"[^\w]+", " ", t.lower()).strip() + " "
    assert got("word") == sorted((d, *b) for d, t in plain.items() if (b := best([k for k in known if f" {k[0]} " in line(t) and len(k[0].split(" ")) <= 2])))
    assert extract.tag_dictionary(texts, terms.limit(0)).count() == 0


def test_automaton():
    """Against str.find, over stretches of any number, with terms inside one another."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("aab") for _ in range(rng.randrange(1, n))).encode()
    for lanes in (1, 3, 8192):
        automaton.LANES = lanes
        for _ in range(30):
            terms, texts = sorted({word(7) for _ in range(rng.randrange(1, 9))}), [word(60) if rng.random() < 0.9 else b"" for _ in range(12)]
            found = automaton.Automaton(terms).greatest(texts)
            assert found.tolist() == [max((i for i, t in enumerate(terms) if t in text), default=-1) for text in texts]
    assert automaton.Automaton([b"a"]).greatest([]).tolist() == []


def test_many_terms_in_one_pass(spark):
    """A hundred thousand terms on documents: as by cutting each text into runs of letters of every length."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").filter("doc_id < 300")
    texts = {r.doc_id: (r.text or "").lower() for r in docs.collect()}
    rng, terms = random.Random(9), set()
    while len(terms) < 100_000:
        text = texts[rng.choice(list(texts))]
        at, n = rng.randrange(max(1, len(text))), rng.randrange(6, 14)
        terms.add(text[at : at + n] if rng.random() < 0.05 and len(text) > at + n else "".join(rng.choice("etaoinshr") for _ in range(n)))
    found = {r.doc_id: r.term for r in extract.tag_dictionary(docs, spark.createDataFrame([(t, "k") for t in sorted(terms)], "term string, kind string"), mode="substring").collect()}
    for i, text in texts.items():
        hits = {text[a : a + n] for n in range(1, 14) for a in range(len(text) - n + 1)} & terms
        assert found.get(i) == max(hits, key=lambda t: (len(t), t), default=None)


def test_likeness():
    """The closest word and the best window by difflib itself, and a text of 20,000 words in a moment."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(0, 9)))
    for _ in range(300):
        target, words = word(), [word() for _ in range(rng.randrange(12))]
        assert likeness.Words(target, words + ["zz"]).closest(words, 0.3) == next(iter(difflib.get_close_matches(target, words, 1, 0.3)), None)
        text, label = " ".join(words), word()
        short, long = sorted((text, label), key=len)
        best = max((difflib.SequenceMatcher(None, long[i : i + len(short)], short, autojunk=False).ratio() for i in range(len(long) - len(short) + 1)), default=0.0) if short else 0.0
        assert likeness.best_window(text, label) == best
    long = "".join(rng.choice("ab") for _ in range(90))
    assert likeness.Words(long, [long[:80], long[5:]]).closest([long[:80], long[5:]], 0.3) == next(iter(difflib.get_close_matches(long, [long[:80], long[5:]], 1, 0.3)))
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 12))) for _ in range(40_000)]

    def took(n):
        began = time.perf_counter()
        likeness.Words("gidgetmaker", words[:n]).closest(words[:n], 0.3)
        likeness.best_window(" ".join(words[:n]), "gidgetmaker")
        return time.perf_counter() - began

    took(2000)
    assert took(20_000) < 10 and took(40_000) < 6 * took(20_000)


def test_frequent_tokens_are_dealt(spark, monkeypatch):
    """A token that all names have does not change what is found, and no part of its grid is large."""
    monkeypatch.setattr(watch, "GRID_ROWS", 10)
    rng = random.Random(11)
    name = lambda: " ".join(["common", *(rng.choice("abcd") for _ in range(rng.randrange(0, 4)))])
    subjects, entries = [name() for _ in range(30)], [name() for _ in range(120)]
    left = spark.createDataFrame(list(enumerate(subjects)), "subject_id long, full_name string")
    right = spark.createDataFrame(list(enumerate(entries)), "entry_id long, name string")
    expected = set()
    for (i, s), (j, e) in itertools.product(enumerate(subjects), enumerate(entries)):
        a, b = set(s.split()), set(e.split())
        if len(a & b) / len(a) * 0.7 + len(a & b) / len(a | b) * 0.3 >= 0.5:
            expected.add((i, j))
    assert {(r.subject_id, r.entry_id) for r in watch.match_names(left, right).collect()} == expected


def test_batches_are_applied_once(spark, tmp_path):
    """Each batch sees what the one before left; one that is run again changes nothing."""
    target = spark.createDataFrame([(1, "old"), (2, "old")], "number long, share string")
    batch = lambda rows: spark.createDataFrame(rows, "number long, event_type string, share string, instance_id string, ts timestamp, seq long")
    now = datetime.datetime(2024, 1, 1)
    apply = feeds.keep_applied(target, f"file://{tmp_path}/v", "me")
    first, second = batch([(1, "delete", None, "o", now, 1), (3, "update", "new", "o", now, 2), (2, "update", "mine", "me", now, 3)]), batch([(2, "update", None, "o", now, 4), (1, "update", "back", "o", now, 5), (3, "update", "a", "o", now, 6), (3, "update", "b", "o", now, 7)])
    for n, rows in ((0, first), (1, second), (1, second)):
        apply(rows, n)
    kept = lambda *n: sorted(map(tuple, feeds.last_version(spark, f"file://{tmp_path}/v", target.schema, *n).collect()))
    assert kept() == kept(2) == [(1, "back"), (2, "old"), (3, "b")] and kept(1) == [(2, "old"), (3, "new")]
    with pytest.raises(RuntimeError):
        apply(second, 5)


def test_batches_write_what_they_touch(spark, tmp_path):
    """Many batches of few keys against a dict; old versions go, and parts that no event touched are not written again."""
    rng, path = random.Random(12), f"file://{tmp_path}/v"
    now = datetime.datetime(2024, 1, 1)
    expected = {k: "old" for k in range(300)}
    target = spark.createDataFrame(list(expected.items()), "number long, share string")
    apply = feeds.keep_applied(target, path, "me")
    assert sorted(map(tuple, feeds.last_version(spark, path, target.schema).collect())) == sorted(expected.items())
    for n in range(5):
        rows = [(rng.randrange(310), rng.choice(["update", "delete"]), rng.choice([f"s{n}", None]), rng.choice(["o", "me"]), now, i) for i in range(4)]
        last = {r[0]: r for r in rows if r[3] == "o"}
        for number, (_, kind, share, *_) in last.items():
            if kind == "delete":
                expected.pop(number, None)
            else:
                expected[number] = share if share is not None else expected.get(number)
        apply(spark.createDataFrame(rows, "number long, event_type string, share string, instance_id string, ts timestamp, seq long"), n)
        assert len(list((tmp_path / "v" / "data" / f"version={n}").glob("bucket=*"))) <= 4
    feeds.keep_applied(target.limit(0), path, "me")  # a later start does not begin anew
    assert dict(map(tuple, feeds.last_version(spark, path, target.schema).collect())) == expected
    assert sorted(p.name for p in (tmp_path / "v" / "manifest").iterdir()) == ["3", "4"]


def test_drain_goes_on(spark, tmp_path):
    """A second drain of one path takes the new file alone, and no row twice."""
    for n in (0, 1):
        spark.range(n * 5, n * 5 + 5).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        feed = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        out = feeds.drain(feed, f"file://{tmp_path}/out")
        assert sorted(r.id for r in out.collect()) == list(range(5 * n + 5))


@pytest.mark.parametrize("stretch", [1 << 20, 40])
def test_windows_of_many_texts(monkeypatch, stretch):
    """Like the best window of each text, whatever lies side by side with it."""
    monkeypatch.setattr(likeness, "STRETCH", stretch)
    monkeypatch.setattr(likeness, "WINDOWS", 50)
    rng = random.Random(17)
    word = lambda n: "".join(rng.choice("abcdé😀 ") for _ in range(n))
    for label in ["", "a", "gidget", "abcdé", "dab cab bad", word(30), word(70)]:
        texts = [word(rng.randrange(0, 90 if len(label) > 20 else 14)) for _ in range(80)] + ["", label, label[:-1], label[1:] + "z", f"x{label[::-1]}y", f"q{label[:-1]}zq"]
        for least in (0, 40, 75.0, 100):
            assert likeness.have_window(texts * 2, label, least) == {t: likeness.best_window(t, label) * 100 >= least for t in texts}


def test_label_match_of_many_rows(spark):
    """Rows with few texts, and rows each with a text of its own, in one partition."""
    few = F.concat(F.lit("large "), F.element_at(F.array(*map(F.lit, ["ring", "gadget", "widget", "bolt"])), (F.col("id") % 4 + 1).cast("int")))
    own = F.concat(few, F.lit(" "), F.col("id").cast("string"))
    for text, n in ((few, 100_000), (own, 60_000)):
        began = time.perf_counter()
        found = {r.k: r.n for r in spark.range(0, n, 1, 1).filter(fields.label_match(text, F.lit("gidget"))).groupBy((F.col("id") % 4).alias("k")).agg(F.count("*").alias("n")).collect()}
        assert time.perf_counter() - began < 15 and found == {1: n // 4, 2: n // 4}
