"""Boosted trees with MLlib: importance, training, search, scoring and the comparison of strategies."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysleuth.operators import imbalance, metrics
from paysleuth.plans.ordered import DEFAULT_POLICY, global_index, hashed_index
from paysleuth.session import materialized

# a fit's input may come with the features in this column (``assembled``)
VECTOR = "_vector"


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol=VECTOR, handleInvalid="keep")


def assembled(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """The label and the features as one vector, as a table: a fit reads its rows several times."""
    if VECTOR in df.columns:
        return df
    return materialized(_assembler(features).transform(df).select(label, VECTOR), "vectors")


def _with_vector(df: DataFrame, features: list[str], *kept: str) -> DataFrame:
    whole = df if VECTOR in df.columns else _assembler(features).transform(df)
    return whole.select(VECTOR, *kept)


def _weighted(df: DataFrame, label: str, weight: float) -> DataFrame:
    return df.withColumn("_weight", F.when(F.col(label) == 1, F.lit(float(weight))).otherwise(F.lit(1.0)))


def positive_weight(df: DataFrame, label: str = "label") -> float:
    counts = imbalance.class_counts(df, label).collect()[0]
    if counts["positives"] == 0:
        raise ValueError("No positive examples found: the weight is undefined.")
    return counts["negatives"] / counts["positives"]


def train_model(
    train: DataFrame,
    validation: DataFrame | None,
    features: list[str],
    label: str = "label",
    weight: float | None = None,
    trees: int = 20,
    depth: int = 4,
    rate: float = 0.1,
    tolerance: float = 0.001,
    subsample: float = 1.0,
    feature_share: str = "all",
    least_rows: int = 1,
    least_gain: float = 0.0,
    seed: int = 42,
) -> PipelineModel:
    """Boosted trees with weighted positives; with a validation part, boosting stops when it no longer gains."""
    weight = positive_weight(train, label) if weight is None else weight
    data = _with_vector(train, features, label).withColumn("_validation", F.lit(False))
    booster = GBTClassifier(
        labelCol=label,
        featuresCol=VECTOR,
        weightCol="_weight",
        maxIter=trees,
        maxDepth=depth,
        stepSize=rate,
        subsamplingRate=subsample,
        featureSubsetStrategy=feature_share,
        minInstancesPerNode=least_rows,
        minInfoGain=least_gain,
        seed=seed,
    )
    if validation is not None:
        data = data.unionByName(_with_vector(validation, features, label).withColumn("_validation", F.lit(True)))
        booster.setParams(validationIndicatorCol="_validation", validationTol=tolerance)
    return PipelineModel([_assembler(features), booster.fit(_weighted(data, label, weight))])


def score(
    df: DataFrame,
    model: PipelineModel,
    threshold: float = 0.5,
    model_version: str | None = None,
    keep: tuple[str, ...] = ("transaction_id",),
) -> DataFrame:
    """prediction_score, prediction_label and the model's version per row; one row out per row in."""
    scored = model.transform(df).withColumn("prediction_score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select(
        *keep,
        "prediction_score",
        (F.col("prediction_score") >= threshold).alias("prediction_label"),
        F.lit(model_version).cast("string").alias("model_version"),
    )


def _importances(df: DataFrame, trees, features: list[str]) -> DataFrame:
    values = trees.featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values, strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def feature_importance(df: DataFrame, features: list[str], label: str = "label", seed: int = 42, trees: int = 20):
    """(feature, importance) of a boosted model, the most important first."""
    model = train_model(df, None, features, label, trees=trees, depth=4, seed=seed)
    return _importances(df, model.stages[-1], features)


def forest_importance(df: DataFrame, features: list[str], label: str = "label", seed: int = 42, trees: int = 50):
    """The same from a random forest of depth 5."""
    forest = RandomForestClassifier(
        labelCol=label, featuresCol=VECTOR, numTrees=trees, maxDepth=5, seed=seed
    )
    return _importances(df, forest.fit(_with_vector(df, features, label)), features)


def imbalance_compare(
    train: DataFrame,
    validation: DataFrame,
    features: list[str],
    key: str = "transaction_id",
    label: str = "label",
    seed: int = 42,
) -> DataFrame:
    """Metrics of both strategies on the validation part; ``recommended`` marks the better F1."""
    grown = imbalance.smote(train, features, key, label, seed=seed)
    weight = positive_weight(train, label)
    models = {
        "smote": train_model(grown, None, features, label, weight=1.0, seed=seed),
        "scale_pos_weight": train_model(train, None, features, label, weight=weight, seed=seed),
    }
    rows = []
    for name, model in models.items():
        scored = score(validation, model, keep=(label,)).select(
            F.col(label).cast("int").alias("label"), F.col("prediction_score").alias("score")
        )
        one = metrics.binary_metrics(scored).select("f1_score", "precision", "recall").collect()[0]
        auc = metrics.roc_auc(scored).collect()[0][0]
        ap = metrics.pr_auc(scored).collect()[0][0]
        rows.append((name, one["f1_score"], one["precision"], one["recall"], auc, ap))
    top = max(range(2), key=lambda i: (rows[i][1], -i))
    out = [(*r, i == top, weight if (i == top and r[0] == "scale_pos_weight") else None) for i, r in enumerate(rows)]
    schema = (
        "strategy string, f1 double, precision double, recall double, roc_auc double, average_precision double, "
        "recommended boolean, recommended_weight double"
    )
    return train.sparkSession.createDataFrame(out, schema)


def _decision(hits: int, rounds: int, alpha: float) -> str:
    """Two-sided binomial test at 1/2."""
    tail = lambda n: sum(math.comb(rounds, i) for i in range(n, rounds + 1)) / 2**rounds
    if tail(hits) <= alpha:
        return "confirmed"
    return "rejected" if tail(rounds - hits) <= alpha else "tentative"


def _undecided(hits: int, seen: int, alpha: float, most: int) -> int:
    """How many rounds, up to ``most``, have to pass before the test can decide about a feature."""
    for more in range(1, most):
        if _decision(hits + more, seen + more, alpha) != "tentative" or _decision(hits, seen + more, alpha) != "tentative":
            return more
    return most


def shadow_feature_test(
    df: DataFrame,
    features: list[str],
    key: str = "transaction_id",
    label: str = "label",
    rounds: int = 20,
    trees: int = 50,
    seed: int = 42,
    confidence: float = 0.05,
    at_once: int = 4,
) -> DataFrame:
    """(feature, hits, rounds, decision): does a feature beat the best shuffled copy more often than by chance?

    One forest a round over the features and their shuffled copies; after each round every open feature is tested, at
    ``confidence`` divided by the number of features and of looks. Rejected features leave with their copies, confirmed
    ones stay in the forest for the others to compete with; when none is open the test ends. The copies give each row the
    values of another row: rows in hash order are paired with rows in key order by position, a permutation that
    needs no collecting. Rounds that must pass before anything can be decided have the same features: up to ``at_once`` of
    them run beside each other, as long as a round's rows do not fill the cores.
    """
    rows = df.select(F.col(key).alias("_key"), *features, F.col(label).alias(label))
    in_order = materialized(global_index(rows, ["_key"], "_at"), "shadow")
    total = in_order.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    at_once = max(1, min(at_once, cores // max(1, math.ceil(total / DEFAULT_POLICY.rows_per_segment))))
    alpha = confidence / (len(features) * rounds)
    hits, seen = dict.fromkeys(features, 0), dict.fromkeys(features, 0)
    decided = dict.fromkeys(features, "tentative")

    def beaten(r: int, inside: list[str]) -> list[str]:
        """The features above the best copy in round ``r``."""
        hashed = in_order.select("_key", *inside, F.xxhash64("_key", F.lit(seed + r)).alias("_h"))
        moved = hashed_index(hashed, "_h", ["_key"], "_at", total).select(
            "_at", *[F.col(c).alias("shadow_" + c) for c in inside]
        )
        names = inside + ["shadow_" + c for c in inside]
        both = assembled(in_order.join(moved, "_at"), names, label)
        scores = {x["feature"]: x["importance"] for x in forest_importance(both, names, label, seed + r, trees).collect()}
        best = max(scores["shadow_" + c] for c in inside)
        return [c for c in inside if scores[c] > best]

    done = 0
    with ThreadPoolExecutor(at_once) as pool:
        while done < rounds:
            inside = [c for c in features if decided[c] != "rejected"]
            open_ = [c for c in features if decided[c] == "tentative"]
            if not open_:
                break
            wave = min(_undecided(hits[c], seen[c], alpha, rounds - done) for c in open_)
            for above in pool.map(lambda r: beaten(r, inside), range(done, done + wave)):  # noqa: B023
                for c in open_:
                    hits[c] += c in above
                    seen[c] += 1
            done += wave
            decided |= {c: _decision(hits[c], seen[c], alpha) for c in open_}
    out = [(c, hits[c], seen[c], decided[c]) for c in features]
    return df.sparkSession.createDataFrame(out, "feature string, hits int, rounds int, decision string")
