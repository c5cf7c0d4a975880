"""Correlations, importances and the choice of features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMPORTANCE_THRESHOLD = 0.01
CORRELATION_THRESHOLD = 0.85


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of all pairs in long form (a, b, r), in one pass over the data.

    A column without variation has no correlation (NULL). Rows with a missing value are left out.
    """
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    together = [
        F.covar_pop(a, b).alias(f"c_{i}_{i + j + 1}")
        for i, a in enumerate(columns)
        for j, b in enumerate(columns[i + 1 :])
    ]
    one = doubles.agg(*together, *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(columns)])
    cells = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            spread = F.col(f"s_{i}") * F.col(f"s_{j}")
            shared = spread if i == j else F.col(f"c_{min(i, j)}_{max(i, j)}")
            cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.try_divide(shared, spread).alias("r")))
    return one.select(F.inline(F.array(*cells)))


def redundant_pairs(
    df: DataFrame, columns: list[str], threshold: float = CORRELATION_THRESHOLD
) -> DataFrame:
    """Pairs (earlier column, later column) with an absolute correlation above the threshold."""
    place = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    matrix = correlation_matrix(df, columns)
    upper = matrix.filter(F.try_element_at(place, F.col("a")) < F.try_element_at(place, F.col("b")))
    return upper.filter(F.abs("r") > threshold).orderBy(F.desc(F.abs("r")), "a", "b")


def select_features(
    columns: list[str],
    importances: DataFrame,
    pairs: DataFrame,
    rejected: list[str] | None = None,
    importance_threshold: float = IMPORTANCE_THRESHOLD,
) -> DataFrame:
    """(position, feature, importance, selected, drop_reason); one row per column, the first reason wins.

    importances: (feature, importance); pairs: (a, b, r). Both have at most one row per column or
    pair of columns, so they are read into the driver to apply the rules.
    """
    weight = {r["feature"]: float(r["importance"]) for r in importances.collect()}
    found = sorted(pairs.collect(), key=lambda r: (-abs(r["r"]), columns.index(r["a"]), columns.index(r["b"])))
    weaker = [p["a"] if weight.get(p["a"], 0.0) <= weight.get(p["b"], 0.0) else p["b"] for p in found]
    by_reason = {
        "low_importance": [f for f, w in weight.items() if w < importance_threshold],
        "redundant": weaker,
        "shadow_rejected": rejected or [],
    }
    reason: dict[str, str] = {}
    for why, names in by_reason.items():
        for name in names:
            reason.setdefault(name, why)
    rows = [(i, c, weight.get(c), c not in reason, reason.get(c)) for i, c in enumerate(columns)]
    schema = "position int, feature string, importance double, selected boolean, drop_reason string"
    return importances.sparkSession.createDataFrame(rows, schema)
