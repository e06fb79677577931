import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from glossa.functions import vectors as vx
from glossa.operators import clusters, conformity
from glossa.operators import silhouette as ops


def brute(points, labels, metric):
    n = len(points)
    if metric == "cosine":
        points = points / np.linalg.norm(points, axis=1, keepdims=True)
    d = ((points[:, None] - points[None]) ** 2).sum(-1)
    if metric == "cosine":
        d = d / 2
    out = []
    for i in range(n):
        same = labels == labels[i]
        if same.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, same].sum() / (same.sum() - 1)
        b = min(d[i, labels == other].mean() for other in set(labels) - {labels[i]})
        out.append((b - a) / max(a, b))
    return out


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(2)
    labels = np.array([0] * 20 + [1] * 9 + [2] * 1 + [3] * 15)
    points = rng.normal(size=(45, 5)) + labels[:, None]
    data = [(i, int(l), [float(v) for v in p]) for i, (l, p) in enumerate(zip(labels, points))]
    return spark.createDataFrame(data, "id int, label int, v array<double>").cache(), points, labels


@pytest.mark.parametrize("cosine", [False, True])
def test_samples_against_pairs(cloud, cosine):
    df, points, labels = cloud
    want = brute(points, labels, "cosine" if cosine else "sq")
    got = ops.silhouette_samples(df, [], "label", "v", cosine, keep=["id"]).orderBy("id").collect()
    assert [r["silhouette"] for r in got] == pytest.approx(want, abs=1e-10)


@pytest.mark.parametrize("cosine,measure", [(False, "squaredEuclidean"), (True, "cosine")])
def test_mean_against_sparks_evaluator(cloud, cosine, measure):
    df, _, _ = cloud
    data = df.withColumn("f", array_to_vector("v")).withColumn("p", F.col("label").cast("double"))
    want = ClusteringEvaluator(featuresCol="f", predictionCol="p", distanceMeasure=measure).evaluate(data)
    assert ops.silhouette(df, [], "label", "v", cosine).first()["silhouette"] == pytest.approx(want, abs=1e-10)


def test_groups_do_not_mix(cloud):
    df, points, labels = cloud
    two = df.withColumn("g", F.lit("a")).unionByName(df.withColumn("g", F.lit("b")).withColumn("v", F.transform("v", lambda x: x * 9)))
    got = {r["g"]: r["silhouette"] for r in ops.silhouette(two, ["g"], "label", "v").collect()}
    assert got["a"] == pytest.approx(np.mean(brute(points, labels, "sq")))
    assert got["b"] == pytest.approx(got["a"])


def test_one_label_and_small_groups_are_null(spark):
    df = spark.createDataFrame([("one", 1, [float(i), 0.0]) for i in range(12)] + [("few", i % 2, [float(i), 1.0]) for i in range(9)], "g string, label int, v array<double>")
    got = {r["g"]: (r["silhouette"], r["n"]) for r in ops.silhouette(df, ["g"], "label", "v").collect()}
    assert got == {"one": (None, 12), "few": (None, 9)}
    tenth = df.unionByName(spark.createDataFrame([("few", 1, [3.0, 1.0])], df.schema))
    assert ops.silhouette(tenth, ["g"], "label", "v").filter("g = 'few'").first()["silhouette"] is not None


def test_row_order_and_partitions_do_not_matter(cloud):
    df, _, _ = cloud
    values = [ops.silhouette(df.repartition(n), [], "label", "v").first()["silhouette"] for n in (1, 7, 64)]
    assert values == pytest.approx([values[0]] * 3, abs=1e-12)


def test_number_of_blocks_does_not_matter(cloud, monkeypatch):
    df, points, labels = cloud
    monkeypatch.setattr(ops, "BLOCK_CELLS", 3)
    got = ops.silhouette_samples(df, [], "label", "v", keep=["id"]).orderBy("id").collect()
    assert [r["silhouette"] for r in got] == pytest.approx(brute(points, labels, "sq"), abs=1e-10)


def test_null_groups_and_copies_stay(cloud, monkeypatch):
    df, points, labels = cloud
    monkeypatch.setattr(ops, "COPIES", 2)
    thrice = df.drop("id").unionByName(df.drop("id")).unionByName(df.drop("id")).withColumn("g", F.lit(None).cast("string"))
    got = sorted(r["silhouette"] for r in ops.silhouette_samples(thrice, ["g"], "label", "v").collect())
    want = sorted(brute(np.tile(points, (3, 1)), np.tile(labels, 3), "sq"))
    assert got == pytest.approx(want, abs=1e-10)
    assert ops.silhouette(thrice, ["g"], "label", "v").first()["n"] == 135


def test_rows_without_label_or_vector_take_no_part(cloud, spark):
    df, points, labels = cloud
    more = df.unionByName(spark.createDataFrame([(90, None, [1.0] * 5), (91, 1, None)], df.schema))
    assert ops.silhouette(more, [], "label", "v").first()["n"] == 45
    assert ops.silhouette(df.limit(0), [], "label", "v").first().asDict() == {"silhouette": None, "n": 0}


def test_stability(cloud):
    df, points, labels = cloud
    scores = []
    for seed in range(5):
        plane = np.array([ops.sign_vector(seed, c, 5) for c in range(2)]).T
        scores.append(np.mean(brute(points @ plane, labels, "sq")))
    got = ops.silhouette_stability(df, [], "label", "v", 5).first()
    assert got["mean"] == pytest.approx(np.mean(scores))
    assert got["std"] == pytest.approx(np.std(scores))
    assert got["unstable"] == bool(np.std(scores) > 0.05)


def test_context_against_lemma_keeps_a_null_for_few_paraphrases(spark):
    rng = np.random.default_rng(4)
    data = [("m", f"t{i % 3}", f"p{i % 5}", i % 5 == 4 and i < 40, [float(v) for v in rng.normal(size=3)]) for i in range(60)]
    df = spark.createDataFrame(data, "model string, term string, prompt_key string, para boolean, v array<double>")
    got = ops.context_against_lemma(df, ["model"], "term", "prompt_key", "v", F.col("para")).first()
    assert got["sil_ctx_paraphrase"] is None
    assert got["delta_ctx_lemma"] == pytest.approx(got["sil_ctx"] - got["sil_lemma"])


def test_cosine_of_a_zero_vector_is_null(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<float>, b array<double>")
    assert [r[0] for r in df.select(vx.cosine("a", "b")).collect()] == [None, pytest.approx(1.0)]
    assert [r[0] for r in df.select(vx.l2_normalize("a")).collect()] == [None, pytest.approx([0.6, 0.8])]


def test_conformity_drops_only_uncovered_concepts(spark):
    responses = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 2.0]), (3, "zz", [1.0, 1.0])], "id int, c string, embedding array<float>")
    prototypes = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "c string, prototype array<double>")
    got = conformity.conformity(responses, prototypes, "c").orderBy("id").collect()
    assert [(r["id"], r["conformity"]) for r in got] == [(1, pytest.approx(1.0)), (2, pytest.approx(0.0))]


def test_feature_prototypes(spark):
    mentions = spark.createDataFrame([("c", "f1")] * 3 + [("c", "f2")] * 2 + [("c", "f0")] * 2 + [("c", "f3")], "c string, f string")
    vectors = spark.createDataFrame([("f0", [0.0, 0.0]), ("f1", [1.0, 0.0]), ("f2", [0.0, 9.0]), ("f3", [5.0, 5.0])], "f string, v array<float>")
    got = conformity.feature_prototypes(mentions, vectors, ["c"], "f", "v", 2).first()
    assert got["prototype"] == [0.5, 0.0]


def test_pca_against_svd(cloud):
    df, points, _ = cloud
    centred = points - points.mean(0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    want = points @ vt[:2].T
    for i in range(2):
        if vt[i][np.abs(vt[i]).argmax()] < 0:
            want[:, i] *= -1
    got = clusters.pca(df, "v", 2).orderBy("id").collect()
    assert np.array([r["projected"] for r in got]) == pytest.approx(want, abs=1e-8)


def test_slice_topics(cloud):
    df, _, _ = cloud
    got = clusters.slice_topics(df.withColumn("g", F.lit(1)), ["g"], "v", 3, 10)
    sizes = {r["topic"]: r["count"] for r in got.groupBy("topic").count().collect()}
    assert sum(sizes.values()) == 45
    assert all(n >= 10 for t, n in sizes.items() if t != -1)
