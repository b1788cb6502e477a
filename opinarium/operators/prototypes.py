"""Prototype classifier: per-class centroids, nearest class, thresholds."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import OTHER, label_name
from ..functions.vectors import dot, doubles, l2_normalize
from ..plans.config import SentimentConfig
from ..session import written
from .retrieval import top_k

CLASSES = 3
#: The score of a class without prototypes.
ABSENT = -1e9
#: Prototypes up to so many components and rows become literals of the scoring expression; beyond it they are joined.
LITERAL_COMPONENTS, LITERAL_ROWS = 4096, 256
#: Beyond the literals, up to this many (32 MB) are broadcast.
BROADCAST_COMPONENTS = 4 << 20


def centroids(df: DataFrame, vector: str, label: str, normalize: bool = True) -> DataFrame:
    """class_id, centroid: the mean of each class's (normalized) vectors, normalized again.

    Components are averaged with partial aggregates, one row a class and component.
    """
    x = l2_normalize(F.col(vector)) if normalize else doubles(F.col(vector))
    parts = df.where(F.col(vector).isNotNull()).select(F.col(label).cast("int").alias("class_id"), F.posexplode(x).alias("pos", "v"))
    means = parts.groupBy("class_id", "pos").agg(F.avg("v").alias("v"))
    out = means.groupBy("class_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"]).alias("centroid"))
    return out.withColumn("centroid", l2_normalize(F.col("centroid"))) if normalize else out


def fit(df: DataFrame, vector: str, label: str, config: SentimentConfig = SentimentConfig()) -> DataFrame:
    """proto_id, class_id, centroid: up to k prototypes for each class 0 to 2.

    k = 1 is the mean; more come from k_means() of all classes at once.
    """
    rows = df.where(F.col(label).between(0, CLASSES - 1) & F.col(vector).isNotNull()).withColumn(label, F.col(label).cast("int"))
    if config.k_per_class == 1:
        found = centroids(rows, vector, label, config.normalize)
        return found.select(F.col("class_id").alias("proto_id"), "class_id", "centroid")
    x = l2_normalize(F.col(vector)) if config.normalize else doubles(F.col(vector))
    made = k_means(rows.select(F.col(label).alias("class_id"), x.alias("x")), config.k_per_class)
    out = df.sparkSession.createDataFrame([(i, c, m) for i, (c, m) in enumerate(made)], "proto_id int, class_id int, centroid array<double>")
    return out.withColumn("centroid", l2_normalize(F.col("centroid"))) if config.normalize else out


#: Rounds of k-means after which it ends, settled or not.
ROUNDS = 20


def k_means(points: DataFrame, k: int, rounds: int = ROUNDS) -> list[tuple[int, list[float]]]:
    """(class_id, centre): up to k centres for each class of points (class_id, x), all classes in the same jobs.

    The first seed of a class is its least vector, each next one the vector
    farthest from its seeds (the least of equals); a class with fewer distinct
    vectors has fewer centres. Then vectors go to their nearest centre (the
    first of equals) and centres to their means, until none moves. The driver
    holds the centres only; means are partial sums, so no class meets in a task.
    """
    points = written(points, "points")

    def distance(centres: list[list[float]]):
        """To each centre, squared."""
        literal = lambda m: F.array(*(F.lit(float(v)) for v in m))
        return [F.aggregate(F.zip_with("x", literal(m), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for m in centres]

    def by_class(found: dict[int, list[list[float]]], value):
        """value of the class's centres, for each row."""
        out = F.lit(None)
        for c, centres in found.items():
            out = F.when(F.col("class_id") == c, value(distance(centres))).otherwise(out)
        return out

    least = lambda d: F.least(*d) if len(d) > 1 else d[0]
    found = {r["class_id"]: [r["x"]] for r in points.groupBy("class_id").agg(F.min("x").alias("x")).orderBy("class_id").collect()}
    for _ in range(k - 1) if found else ():
        far = points.withColumn("far", by_class(found, least)).where("far > 0").groupBy("class_id").agg(F.min(F.struct((-F.col("far")).alias("near"), "x")).alias("top"))
        more = {r["class_id"]: r["x"] for r in far.select("class_id", "top.x").collect()}
        for c, x in more.items():
            found[c].append(x)
        if not more:
            break
    for _ in range(rounds if k > 1 and found else 0):
        own = points.withColumn("own", by_class(found, lambda d: (F.array_position(F.array(*d), least(d)) - 1).cast("int")))
        sums = own.select("class_id", "own", F.posexplode("x").alias("pos", "v")).groupBy("class_id", "own", "pos").agg(F.avg("v").alias("v"))
        means = sums.groupBy("class_id", "own").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"]).alias("x")).collect()
        before = {c: list(m) for c, m in found.items()}
        for r in means:
            found[r["class_id"]][r["own"]] = r["x"]
        if all(max(abs(a - b) for a, b in zip(p, q)) < 1e-12 for c in found for p, q in zip(found[c], before[c])):
            break
    return [(c, [float(v) for v in m]) for c in sorted(found) for m in found[c]]


def _predicted(scores: list[Column]) -> tuple[Column, Column]:
    """The class of the highest score (ties: the lowest class) and that score."""
    best, top = F.lit(0), scores[0]
    for c in range(1, CLASSES):
        best, top = F.when(scores[c] > top, F.lit(c)).otherwise(best), F.greatest(top, scores[c])
    return best, top


def _predicted_in_blocks(df: DataFrame, vector: str, prototypes: DataFrame, normalize: bool, names: list[str]) -> DataFrame:
    """predict() for prototypes of any number."""
    rows = written(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    out = rows
    for c, n in enumerate(names):
        refs = prototypes.where(F.col("class_id") == c).select(F.monotonically_increasing_id().alias("ref_id"), F.col("centroid").alias("vector"))
        near = top_k(rows, refs, "_row", vector, 1, normalize).select(F.col("query_id").alias("_row"), F.col("sim").alias(n))
        out = out.join(near, "_row", "left").withColumn(n, F.when(F.col(vector).isNotNull(), F.coalesce(n, F.lit(ABSENT))))
    pred, sim = _predicted([F.col(n) for n in names])
    return out.drop("_row").withColumns({"pred": pred, "sim": sim})


def predict(df: DataFrame, vector: str, prototypes: DataFrame, normalize: bool = True) -> DataFrame:
    """df with s_negative, s_neutral, s_positive (largest similarity to the class's prototypes), pred and sim.

    A model's few prototypes become literals of one expression: no join and
    no shuffle. Larger sets are broadcast up to BROADCAST_COMPONENTS; beyond
    it rows meet them in blocks, each class's nearest prototype by top_k().
    """
    x = l2_normalize(F.col(vector)) if normalize else doubles(F.col(vector))
    names = ["s_negative", "s_neutral", "s_positive"]
    few = prototypes.select("class_id", "centroid").limit(LITERAL_ROWS + 1).collect()
    if len(few) > LITERAL_ROWS or sum(len(r["centroid"]) for r in few) > LITERAL_COMPONENTS:
        size = prototypes.agg(F.coalesce(F.sum(F.size("centroid")), F.lit(0))).first()[0]
        if size > BROADCAST_COMPONENTS:
            return _predicted_in_blocks(df, vector, prototypes, normalize, names)
        small = prototypes.agg(F.collect_list(F.struct("class_id", F.col("centroid").alias("c"))).alias("_protos"))
        out = df.withColumn("_x", x).crossJoin(F.broadcast(small))  # one row
        score = lambda c: F.coalesce(F.array_max(F.transform(F.filter("_protos", lambda p: p["class_id"] == c), lambda p: dot(F.col("_x"), p["c"]))), F.lit(ABSENT))
        out = out.withColumns({n: score(c) for c, n in enumerate(names)}).drop("_protos", "_x")
    else:
        literal = lambda m: F.array(*(F.lit(float(v)) for v in m))
        out = df.withColumn("_x", x)
        scores = {}
        for c, n in enumerate(names):
            sims = [dot(F.col("_x"), literal(r["centroid"])) for r in few if r["class_id"] == c]
            scores[n] = (F.greatest(*sims) if len(sims) > 1 else sims[0]) if sims else F.lit(ABSENT)
        out = out.withColumns(scores).drop("_x")
    pred, sim = _predicted([F.col(n) for n in names])
    return out.withColumns({"pred": pred, "sim": sim})


def apply_thresholds(df: DataFrame, thresholds: dict[int, float], pred: str = "pred", sim: str = "sim") -> DataFrame:
    """df with passed, and pred4: pred, or the class of others below its threshold."""
    limit = F.element_at(F.create_map(*(F.lit(x) for k, v in sorted(thresholds.items()) for x in (k, float(v)))), F.col(pred))
    return df.withColumn("passed", F.col(sim) >= limit).withColumn("pred4", F.when(F.col("passed"), F.col(pred)).otherwise(F.lit(OTHER)))


def with_labels(df: DataFrame) -> DataFrame:
    """df with pred_label and pred_source: texts below the threshold keep their nearest label, their source is llm."""
    return df.withColumns({"pred_label": label_name(F.col("pred")), "pred_source": F.when(F.col("passed"), "prototype").otherwise("llm")})


def save(prototypes: DataFrame, config: SentimentConfig, path: str, **meta) -> None:
    """Prototypes as Parquet, and a row of metadata beside them."""
    if prototypes.isEmpty():
        raise ValueError("the model isn't fitted")
    prototypes.coalesce(1).write.mode("overwrite").parquet(f"{path}/prototypes")
    told = {"k_per_class": config.k_per_class, "normalize": config.normalize, "thresholds": {str(k): v for k, v in config.thresholds.items()}, **meta}
    spark = prototypes.sparkSession
    spark.createDataFrame([(json.dumps(told, ensure_ascii=False),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, SentimentConfig, dict]:
    """Prototypes, the settings they were made with, and all metadata (missing metadata: defaults)."""
    found = spark.read.parquet(f"{path}/prototypes")
    try:
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()[0])
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        meta = {}
    default = SentimentConfig()
    return found, SentimentConfig(meta.get("k_per_class", default.k_per_class), meta.get("normalize", default.normalize), {int(k): v for k, v in meta.get("thresholds", {}).items()} or default.thresholds, enable_fallback=False), meta


def import_npz(spark: SparkSession, path: str) -> DataFrame:
    """Prototypes from a NumPy archive with C (rows of components) and proto2class."""
    import numpy as np

    with np.load(path, allow_pickle=False) as z:
        rows = [(i, int(c), [float(v) for v in m]) for i, (m, c) in enumerate(zip(z["C"], z["proto2class"]))]
    return spark.createDataFrame(rows, "proto_id int, class_id int, centroid array<double>")
