"""Queries of the vector and metric operators over the given tables, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouch.functions.vectors import l2_normalized, minmax_normalized, vec_distance
from vouch.operators import metrics, vectors
from vouch.plans.tables import table

Q, O = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql is not None:
            O[name] = sql
        return f

    return add


def _store(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _queries(spark, sf_dir):
    """Every vector whose number is divisible by 50 is a query, against all."""
    return _store(spark, sf_dir).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _neighbours(spark, sf_dir):
    store = _store(spark, sf_dir)
    after = store.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return store.select("vec_id", F.col("embedding").alias("a")).join(after, "vec_id")


NEXT = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings),
    p AS (SELECT x.vec_id, x.v AS a, y.v AS b FROM e x JOIN e y ON y.vec_id = x.vec_id + 1),
    d AS (SELECT *, 1 - list_cosine_similarity(a, b) AS cosine, list_distance(a, b) AS euclidean FROM p)"""
FOUND = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings),
    f AS (SELECT q.vec_id AS query_id, s.vec_id, s.label, q.label AS query_label, round(1 - list_cosine_similarity(q.v, s.v), 6) AS distance FROM e q CROSS JOIN e s WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM f)"""


@query("v1_distances", NEXT + """ SELECT vec_id, round(cosine, 6) AS cosine, round(acos(least(greatest(1 - cosine, -1), 1)) / pi(), 6) AS angular, round(euclidean, 6) AS euclidean,
    round(list_distance(list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))), list_transform(b, lambda x: x / sqrt(list_dot_product(b, b)))), 6) AS euclidean_l2 FROM d""")
def v1(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("vec_id", *[vec_distance(F.col("a"), F.col("b"), m).alias(m) for m in ("cosine", "angular", "euclidean", "euclidean_l2")])


@query("v2_verify_pairs", NEXT + " SELECT vec_id, round(cosine, 6) AS distance, 0.68 AS threshold, round(cosine, 6) <= 0.68 AS verified FROM d")
def v2(spark, sf_dir):
    return vectors.verify_pairs(_neighbours(spark, sf_dir), "VGG-Face").select("vec_id", "distance", "threshold", "verified")


@query("v3_confidence", NEXT + """, c AS (SELECT vec_id, round(cosine, 6) AS distance, 100 / (1 + exp(-(-6.0 * round(cosine, 6) + 3.0))) AS raw, round(cosine, 6) <= 0.95 AS verified FROM d)
    SELECT vec_id, verified, round(least(greatest(CASE WHEN verified THEN greatest((raw - 20.0) / (88.0 - 20.0) * 49.0 + 51.0, 51.0) ELSE least((raw - 3.0) / (20.0 - 3.0) * 20.0, 49.0) END, 0), 100), 2) AS confidence FROM c""")
def v3(spark, sf_dir):
    pairs = _neighbours(spark, sf_dir).withColumn("distance", vec_distance(F.col("a"), F.col("b"))).withColumn("verified", F.col("distance") <= 0.95)
    return pairs.select("vec_id", "verified", vectors.confidence(F.col("distance"), F.col("verified"), -6.0, 3.0, 0.98, (20.0, 88.0), (3.0, 20.0)).alias("confidence"))


@query("v3_plain_confidence", NEXT + " SELECT vec_id, CAST(CASE WHEN round(cosine, 6) <= 0.95 THEN 51 ELSE 49 END AS DOUBLE) AS confidence FROM d")
def v3p(spark, sf_dir):
    """For a model without coefficients."""
    verified = vec_distance(F.col("a"), F.col("b")) <= 0.95
    return _neighbours(spark, sf_dir).select("vec_id", vectors.plain_confidence(verified).alias("confidence"))


@query("v4_search_threshold", FOUND + " SELECT query_id, vec_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM f WHERE distance <= 0.75)".replace("SELECT *, row", "SELECT query_id, vec_id, distance, row"))
def v4(spark, sf_dir):
    return vectors.search_exact(_queries(spark, sf_dir), _store(spark, sf_dir), threshold=0.75)


@query("v4_search_top_k", FOUND + " SELECT query_id, vec_id, distance, rank FROM r WHERE rank <= 10")
def v4k(spark, sf_dir):
    return vectors.search_exact(_queries(spark, sf_dir), _store(spark, sf_dir), k=10)


@query("v5_nearest_other", FOUND + " SELECT query_id, arg_min(vec_id, (distance, vec_id)) AS vec_id, min(distance) AS distance FROM f WHERE vec_id <> query_id AND distance <= 0.8 GROUP BY query_id")
def v5(spark, sf_dir):
    found = vectors.search_exact(_queries(spark, sf_dir), _store(spark, sf_dir), threshold=0.8, k=1, others=True)
    return found.select("query_id", "vec_id", "distance")


_scope = lambda name, where: f"SELECT query_id, '{name}' AS scope, arg_min(vec_id, (distance, vec_id)) AS vec_id, arg_min(label, (distance, vec_id)) AS identity, min(distance) AS distance, min(distance) < 0.6 AS matched FROM f WHERE vec_id <> query_id AND vec_id % 3 = query_id % 3 AND {where} GROUP BY query_id"


@query("v5_nearest_face", FOUND + f" {_scope('any', 'true')} UNION ALL {_scope('own', 'label = query_label')} UNION ALL {_scope('others', 'label <> query_label')}")
def v5f(spark, sf_dir):
    """Three models; the nearest of any identity, of the query's own, and of the others."""
    faces = _store(spark, sf_dir).select("vec_id", F.col("label").alias("identity"), (F.col("vec_id") % 3).alias("model"), "embedding")
    asked = faces.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    parts = [vectors.nearest_face(asked, faces, 0.6, scope).select("query_id", F.lit(scope).alias("scope"), "vec_id", "identity", "distance", "matched") for scope in ("any", "own", "others")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("v6_normalize", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings)
    SELECT vec_id, list_transform(v, lambda x: round(x / CASE WHEN list_dot_product(v, v) > 0 THEN sqrt(list_dot_product(v, v)) ELSE 1 END, 6) + 0.0) AS l2, list_transform(v, lambda x: round((least(greatest(x, -0.1), 0.1) + 0.1) / 0.2, 6)) AS minmax FROM e""")
def v6(spark, sf_dir):
    rounded = lambda c: F.transform(c, lambda x: F.round(x, 6))
    v = F.col("embedding")
    return _store(spark, sf_dir).select("vec_id", rounded(l2_normalized(v)).alias("l2"), rounded(minmax_normalized(v, -0.1, 0.1)).alias("minmax"))


@query("v4_search_similar", FOUND + " SELECT query_id, vec_id, distance, rank FROM r WHERE rank <= 5")
def v4s(spark, sf_dir):
    """Look-alikes: the threshold does not count."""
    return vectors.search_exact(_queries(spark, sf_dir), _store(spark, sf_dir), threshold=0.1, k=5, similarity=True)


@query("v7_search_ann")
def v7(spark, sf_dir):
    """Checked by recall against search_exact in the tests. The vectors given have no structure, so the codes of all lists are read, and whole vectors for thirty of them."""
    store = _store(spark, sf_dir)
    index = vectors.fit_index(store)
    return vectors.search_ann(_queries(spark, sf_dir), store, vectors.build_index(store, index), index, 10, probes=64)


@query("v8_assert_dims", "SELECT len(embedding) AS dimensions, count(*) AS vectors FROM embeddings GROUP BY 1")
def v8(spark, sf_dir):
    return vectors.assert_dims(_store(spark, sf_dir))


def _distance_counts(spark, sf_dir):
    """How many searched pairs lie at each distance, by whether their labels agree."""
    store = _store(spark, sf_dir)
    return vectors.distance_counts(store.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), store)


@query("v10_best_threshold", FOUND + """, m AS (SELECT avg(distance) FILTER (label = query_label) AS lo, avg(distance) FILTER (label <> query_label) AS hi, count(*) FILTER (label <> query_label) AS neg, count(*) AS n FROM f),
    s AS (SELECT distance, count(*) FILTER (label = query_label) AS t, count(*) FILTER (label <> query_label) AS x FROM f GROUP BY distance),
    c AS (SELECT distance, sum(t) OVER (ORDER BY distance) AS ct, sum(x) OVER (ORDER BY distance) AS cx FROM s)
    SELECT round((ct + neg - cx) / n, 6) AS accuracy, distance AS threshold FROM c, m WHERE distance BETWEEN lo AND hi ORDER BY accuracy DESC, threshold LIMIT 1""")
def v10(spark, sf_dir):
    return vectors.best_threshold(_distance_counts(spark, sf_dir))


@query("w11_first_match", FOUND + """, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vec_id DESC) AS nth FROM f),
    s AS (SELECT *, min(CASE WHEN distance <= 0.75 THEN nth END) OVER (PARTITION BY query_id) AS stop FROM o)
    SELECT query_id, max(CASE WHEN nth = stop THEN vec_id END) AS vec_id, count(*) AS checked, round(1 - min(distance), 4) AS best_similarity FROM s WHERE stop IS NULL OR nth <= stop GROUP BY query_id""")
def w11(spark, sf_dir):
    return vectors.first_match(_queries(spark, sf_dir), _store(spark, sf_dir).select("vec_id", "embedding", F.col("vec_id").alias("arrival")), 0.75)


@query("o1_top_k", FOUND + " SELECT query_id, vec_id, distance, rank FROM r WHERE rank <= 3")
def o1(spark, sf_dir):
    return vectors.search_exact(_queries(spark, sf_dir), _store(spark, sf_dir), k=3)


@query("o2_newest", "SELECT identity, vec_id, nth FROM (SELECT label AS identity, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS nth FROM embeddings) WHERE nth <= 5")
def o2(spark, sf_dir):
    return vectors.newest(_store(spark, sf_dir).select(F.col("label").alias("identity"), "vec_id", F.col("vec_id").alias("arrival")), 5).select("identity", "vec_id", "nth")


@query("j8_duplicate_identities", """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings)
    SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, round(1 - list_cosine_similarity(a.v, b.v), 6) AS distance FROM e a JOIN e b ON a.vec_id < b.vec_id AND a.vec_id % 2 = b.vec_id % 2 AND a.label <> b.label
    WHERE round(1 - list_cosine_similarity(a.v, b.v), 6) < 0.6""")
def j8(spark, sf_dir):
    faces = _store(spark, sf_dir).select("vec_id", F.col("label").alias("identity"), (F.col("vec_id") % 2).alias("model"), "embedding")
    return vectors.duplicate_identities(faces, 0.6)


@query("a22_count_by", "SELECT label, count(*) AS vectors FROM embeddings GROUP BY label")
def a22(spark, sf_dir):
    return _store(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("vectors"))


@query("a25_match_counters", FOUND + " SELECT query_id, count(*) AS found, count(*) FILTER (1 - distance >= 0.3) AS matched, count(*) FILTER (1 - distance < 0.3 AND 1 - distance >= 0.2) AS low_confidence, count(*) FILTER (1 - distance < 0.2) AS not_matched FROM f GROUP BY query_id")
def a25(spark, sf_dir):
    return vectors.match_counters(_queries(spark, sf_dir), _store(spark, sf_dir), 0.3, 0.2)


@query("a24_ensemble_vote", """WITH m AS (SELECT l_orderkey AS pair_id, l_discount * 10 AS distance FROM lineitem)
    SELECT pair_id, count(*) AS models, count(*) FILTER (distance <= 0.4) >= count(*) / 2.0 AS matched, round(avg(greatest(0, 1 - distance)), 3) AS confidence,
           round(CASE WHEN count(*) FILTER (distance <= 0.4) >= count(*) / 2.0 THEN max(distance) FILTER (distance <= 0.4) ELSE avg(distance) END, 4) AS distance FROM m GROUP BY pair_id""")
def a24(spark, sf_dir):
    from vouch.operators.verify import ensemble_vote

    votes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair_id"), (F.col("l_discount").cast("double") * 10).alias("distance"))
    return ensemble_vote(votes, 0.4)


PRED = """WITH p AS (SELECT d.source AS image_id, (d.n_chars * 7919 % 1000) / 1000.0 AS pred, l.quality AS target FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""
SOFT = """, s AS (SELECT {} sum(pred * target) AS tp, sum(pred * (1 - target)) AS fp, sum((1 - pred) * (1 - target)) AS tn, sum((1 - pred) * target) AS fn FROM p {})"""
EACH, POOLED = SOFT.format("image_id,", "GROUP BY image_id"), SOFT.format("", "")


def _predictions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("image_id"), ((F.col("n_chars") * 7919 % 1000) / 1000.0).alias("pred"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("target")), "doc_id")


@query("m1_binary_metrics", PRED + """, c AS (SELECT count(*) FILTER (pred >= 0.5 AND target = 1) AS tp, count(*) FILTER (pred >= 0.5 AND target = 0) AS fp, count(*) FILTER (pred < 0.5 AND target = 0) AS tn, count(*) FILTER (pred < 0.5 AND target = 1) AS fn FROM p)
    SELECT tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, tp / (tp + fp + fn) AS iou,
           (tp * tn - fp * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc FROM c""")
def m1(spark, sf_dir):
    return metrics.binary_metrics(_predictions(spark, sf_dir))


@query("m2_fpr", PRED + " SELECT count(*) FILTER (pred >= 0.5 AND target = 0) / count(*) FILTER (target = 0) AS fpr FROM p")
def m2(spark, sf_dir):
    return metrics.fpr(_predictions(spark, sf_dir))


_AREA = "sum(t * (below + f / 2)) / (sum(t) * sum(f))"


@query("m3_auroc", PRED + f", s AS (SELECT pred, count(*) FILTER (target = 1) AS t, count(*) FILTER (target = 0) AS f FROM p GROUP BY pred), c AS (SELECT *, sum(f) OVER (ORDER BY pred) - f AS below FROM s) SELECT round({_AREA}, 6) AS auroc FROM c")
def m3(spark, sf_dir):
    return metrics.auroc(_predictions(spark, sf_dir))


@query("w12_roc", PRED + """, s AS (SELECT pred, count(*) FILTER (target = 1) AS t, count(*) FILTER (target = 0) AS f FROM p GROUP BY pred)
    SELECT pred, round(sum(t) OVER (ORDER BY pred DESC) / (SELECT sum(t) FROM s), 6) AS tpr, round(sum(f) OVER (ORDER BY pred DESC) / (SELECT sum(f) FROM s), 6) AS fpr FROM s""")
def w12(spark, sf_dir):
    return metrics.roc(_predictions(spark, sf_dir))


@query("m4_mean_auroc", PRED + f""", s AS (SELECT image_id, pred, count(*) FILTER (target = 1) AS t, count(*) FILTER (target = 0) AS f FROM p GROUP BY image_id, pred),
    c AS (SELECT *, sum(f) OVER (PARTITION BY image_id ORDER BY pred) - f AS below FROM s), i AS (SELECT image_id, CASE WHEN sum(t) * sum(f) = 0 THEN 0 ELSE {_AREA} END AS a FROM c GROUP BY image_id) SELECT round(avg(a), 6) AS mean_auroc FROM i""")
def m4(spark, sf_dir):
    return metrics.mean_auroc(_predictions(spark, sf_dir))


_F1, _IOU = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END", "CASE WHEN tp + fp + fn = 0 THEN 0 ELSE tp / (tp + fp + fn) END"
_MCC = "CASE WHEN tp + tn <> 0 AND fp + fn = 0 THEN 1 WHEN tp + tn = 0 AND fp + fn <> 0 THEN -1 WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END"
for _name, _f, _sql in (("f1", metrics.weighted_f1, _F1), ("iou", metrics.weighted_iou, _IOU), ("mcc", metrics.weighted_mcc, _MCC)):
    _n = {"f1": 5, "iou": 6, "mcc": 7}[_name]
    Q[f"m{_n}_weighted_{_name}_mean"] = lambda spark, sf_dir, f=_f: f(_predictions(spark, sf_dir), "mean")
    O[f"m{_n}_weighted_{_name}_mean"] = PRED + EACH + f" SELECT round(avg({_sql}), 6) AS {_name}_weighted FROM s"
    Q[f"m{_n}_weighted_{_name}_pooled"] = lambda spark, sf_dir, f=_f: f(_predictions(spark, sf_dir), "pooled")
    O[f"m{_n}_weighted_{_name}_pooled"] = PRED + POOLED + f" SELECT round({_sql}, 6) AS {_name}_weighted FROM s"


@query("m8_metrics", PRED + " SELECT count(*) FILTER (pred >= 0.3 AND target = 1) / count(*) FILTER (target = 1) AS recall, count(*) FILTER (pred >= 0.3 AND target = 0) / count(*) FILTER (target = 0) AS fpr FROM p")
def m8(spark, sf_dir):
    return metrics.metrics(_predictions(spark, sf_dir), ["recall", "fpr"], 0.3)


SCORED = """WITH s AS (SELECT l.l_orderkey AS item_id, ('m' || l_linenumber) AS method, CAST(l.l_discount * 10 AS DOUBLE) AS score, o.o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_forged FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey)"""


def _scored(spark, sf_dir):
    scores = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("method"), (F.col("l_discount").cast("double") * 10).alias("score"))
    truth = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("is_forged"))
    return metrics.score_predictions(scores, truth)


@query("j19_score_predictions", SCORED + " SELECT item_id, method, round(score, 4) AS score, is_forged, score > 0.5 AS predicted, (score > 0.5) = is_forged AS correct FROM s")
def j19(spark, sf_dir):
    return _scored(spark, sf_dir).withColumn("score", F.round("score", 4))


@query("m9_reference_metrics", SCORED + ", a AS (SELECT method, round(avg(CASE WHEN (score > 0.5) = is_forged THEN 1.0 ELSE 0 END), 6) AS x, round(avg(score), 6) AS auc FROM s GROUP BY method) SELECT method, x AS accuracy, x AS precision, x AS recall, x AS f1, auc FROM a")
def m9(spark, sf_dir):
    return metrics.reference_metrics(_scored(spark, sf_dir))


@query("a16_method_report", """WITH a AS (SELECT ('m' || l_linenumber) AS method, round(avg(l_discount * 10), 6) AS mean, round(stddev_pop(CAST(l_discount AS DOUBLE) * 10), 6) AS std, round(min(l_discount * 10), 4) AS low, round(max(l_discount * 10), 4) AS high, round(avg(l_quantity), 6) AS time FROM lineitem GROUP BY 1)
    SELECT *, round(1 - std, 6) AS consistency, row_number() OVER (ORDER BY mean DESC, method) AS rank FROM a""")
def a16(spark, sf_dir):
    results = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("method"), F.round(F.col("l_discount").cast("double") * 10, 4).alias("score"), F.col("l_quantity").cast("double").alias("processing_time"))
    return metrics.method_report(results)


@query("a26_setting_impact", """WITH a AS (SELECT ('m' || l_linenumber) AS model, l_linestatus AS detector, avg(CAST(l_discount AS DOUBLE)) AS accuracy FROM lineitem GROUP BY 1, 2, l_returnflag), d AS (SELECT model, detector, max(accuracy) - min(accuracy) AS d FROM a GROUP BY 1, 2)
    SELECT model, round(max(d), 6) AS impact FROM d GROUP BY model""")
def a26(spark, sf_dir):
    return metrics.setting_impact(_accuracies(spark, sf_dir))


@query("a26_best_scores", """WITH a AS (SELECT ('m' || l_linenumber) AS model, l_linestatus AS detector, round(avg(CAST(l_discount AS DOUBLE)), 8) AS accuracy FROM lineitem GROUP BY 1, 2, l_returnflag), b AS (SELECT model, max(accuracy) AS accuracy FROM a GROUP BY 1)
    SELECT model, accuracy, min(detector) AS detector FROM a JOIN b USING (model, accuracy) GROUP BY 1, 2""")
def a26b(spark, sf_dir):
    return metrics.best_scores(_accuracies(spark, sf_dir).withColumn("accuracy", F.round("accuracy", 8)))


def _accuracies(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("model"), F.col("l_linestatus").alias("detector"), "l_returnflag").agg(F.avg(F.col("l_discount").cast("double")).alias("accuracy"))


@query("a27_profile_similarity")
def a27(spark, sf_dir):
    """Bin edges differ by rounding between engines; tested on a fixture."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast("double").alias("value"), "l_returnflag")
    return metrics.profile_similarity(lines.filter("l_returnflag = 'R'"), lines.filter("l_returnflag = 'A'"), 900.0, 105000.0)


@query("j18_make_pairs", """SELECT x.vec_id AS vec_a, y.vec_id AS vec_b, x.label = y.label AS same FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id AND (y.vec_id % 50 <> 0 OR x.vec_id < y.vec_id)
    WHERE x.vec_id % 50 = 0""")
def j18(spark, sf_dir):
    """The stated query set with every vector."""
    store = _store(spark, sf_dir).select("vec_id", "label")
    return vectors.make_pairs(store.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), store)
