"""Category encoders kept as small tables (category, code), joined to the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysleuth.functions.scalars import null_as_text
from paysleuth.plans.ordered import DEFAULT_POLICY, SplitPolicy, running
from paysleuth.plans.sizing import as_lookup, small_table, with_row

SMOOTHING = 10.0
APPEARANCE = ("timestamp", "transaction_id")


def _smoothed(s: Column, n: Column, overall: Column, smoothing: float) -> Column:
    return (s + F.lit(smoothing) * overall) / (n + F.lit(smoothing))


def target_encode_fit(df: DataFrame, column: str, label: str = "is_fraud", smoothing: float = SMOOTHING) -> DataFrame:
    """(category, code): the label mean of a category, pulled towards the overall mean.

    The overall mean is the row with the NULL category; it is summed up from the per-category
    counts, so the data is read once.
    """
    y = F.col(label).cast("int")
    per = (
        df.filter(y.isNotNull())
        .groupBy(null_as_text(column).alias("category"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"))
    )
    overall = per.agg((F.sum("s") / F.sum("n")).alias("g"))
    joined = with_row(per, overall)
    codes = joined.select("category", _smoothed(F.col("s"), F.col("n"), F.col("g"), smoothing).alias("code"))
    return codes.unionByName(overall.select(F.lit(None).cast("string").alias("category"), F.col("g").alias("code")))


def target_encode(df: DataFrame, fitted: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Look the code up; an unseen category gets the overall mean."""
    fitted = _settled(fitted)
    default = fitted.filter(F.col("category").isNull()).select("code").collect()
    mean = F.lit(default[0][0] if default else None)
    return encode_lookup(df, fitted.filter(F.col("category").isNotNull()), column, mean, out)


def _settled(fitted: DataFrame) -> DataFrame:
    local = small_table(fitted)
    return fitted if local is None else local


def encode_lookup(df: DataFrame, fitted: DataFrame, column: str, default: Column, out: str | None = None) -> DataFrame:
    """Dictionary lookup with a default for absent keys."""
    keys = as_lookup(fitted.select(F.col("category").alias("_key"), F.col("code").alias("_code")))
    return _look_up(df, keys, column, default, out or f"{column}_encoded")


def _look_up(df: DataFrame, keys: DataFrame, column: str, default: Column, out: str) -> DataFrame:
    joined = df.join(keys, null_as_text(column) == F.col("_key"), "left")
    return joined.withColumn(out, F.coalesce(F.col("_code"), default)).drop("_key", "_code")


def _numbered(values: DataFrame, order: str, policy: SplitPolicy) -> DataFrame:
    """(category, code): position of each category in the given order."""
    coded = running(_settled(values).withColumn("_one", F.lit(1)), [], order, {"code": ("sum", "_one")}, policy=policy)
    return coded.select("category", F.coalesce(F.col("code"), F.lit(0)).cast("long").alias("code"))


def ordinal_encode_fit(
    df: DataFrame, column: str, order: tuple[str, str] = APPEARANCE, policy: SplitPolicy = DEFAULT_POLICY
) -> DataFrame:
    """(category, code): codes by first appearance in (timestamp, transaction_id) order."""
    first = df.groupBy(null_as_text(column).alias("category")).agg(F.min(F.struct(*order)).alias("_first"))
    return _numbered(first, "_first", policy)


def ordinal_encode(df: DataFrame, fitted: DataFrame, column: str, out: str | None = None) -> DataFrame:
    return encode_lookup(df, fitted, column, F.lit(-1).cast("long"), out)


def label_encode_fit(df: DataFrame, column: str, policy: SplitPolicy = DEFAULT_POLICY) -> DataFrame:
    """(category, code): codes by sorted value, 0 for the smallest."""
    return _numbered(df.select(null_as_text(column).alias("category")).distinct(), "category", policy)


def label_encode(df: DataFrame, column: str, out: str | None = None, policy: SplitPolicy = DEFAULT_POLICY) -> DataFrame:
    fitted = label_encode_fit(df, column, policy)
    return encode_lookup(df, fitted, column, F.lit(None).cast("long"), out or f"{column}_enc")


class EncoderSet:
    """Two target encoders and one ordinal encoder: one table (column, category, code).

    The row with the NULL category holds the code of an unseen category.
    """

    TARGET = ("merchant_category", "country")
    ORDINAL = ("device_type",)

    def __init__(self, codes: DataFrame):
        local = small_table(codes)
        self.codes = codes if local is None else local
        self._small = local is not None

    @classmethod
    def fit(cls, df: DataFrame, label: str = "is_fraud", smoothing: float = SMOOTHING, until=None) -> EncoderSet:
        """Fit all encoders in one pass over the labelled rows.

        ``until`` (an exclusive time) keeps later rows out of the codes.
        """
        y = F.col(label).cast("int")
        rows = df.filter(y.isNotNull())
        if until is not None:
            rows = rows.filter(F.col("timestamp") < F.lit(until).cast("timestamp"))
        names = (*cls.TARGET, *cls.ORDINAL)
        pairs = F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), null_as_text(c).alias("category")) for c in names])
        )
        long = rows.select(y.alias("_y"), F.struct(*APPEARANCE).alias("_at"), pairs.alias("_p"))
        stats = long.groupBy("_p.column", "_p.category").agg(
            F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"), F.min("_at").alias("_first")
        )
        stats = _settled(stats)  # the codes below read these rows more than once
        overall = stats.groupBy("column").agg((F.sum("s") / F.sum("n")).alias("g"))
        ranked = running(stats.withColumn("_one", F.lit(1)), ["column"], "_first", {"_rank": ("sum", "_one")})
        is_target = F.col("column").isin(*cls.TARGET)
        # one row per encoder
        joined = ranked.join(F.broadcast(overall), "column")
        code = F.when(is_target, _smoothed(F.col("s"), F.col("n"), F.col("g"), smoothing)).otherwise(
            F.coalesce(F.col("_rank"), F.lit(0)).cast("double")
        )
        unseen = overall.select(
            "column",
            F.lit(None).cast("string").alias("category"),
            F.when(is_target, F.col("g")).otherwise(F.lit(-1.0)).alias("code"),
        )
        return cls(joined.select("column", "category", code.alias("code")).unionByName(unseen))

    def unseen(self) -> dict[str, float]:
        return {r["column"]: r["code"] for r in self.codes.filter(F.col("category").isNull()).collect()}

    def transform(self, df: DataFrame) -> DataFrame:
        defaults = self.unseen()
        for c in (*self.TARGET, *self.ORDINAL):
            kind = "double" if c in self.TARGET else "long"
            keys = self.codes.filter((F.col("column") == c) & F.col("category").isNotNull()).select(
                F.col("category").alias("_key"), F.col("code").cast(kind).alias("_code")
            )
            if self._small:
                keys = F.broadcast(keys)
            df = _look_up(df, keys, c, F.lit(defaults.get(c)).cast(kind), f"{c}_encoded")
        return df

    def save(self, path: str) -> None:
        table = self.codes.coalesce(1) if self._small else self.codes
        table.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> EncoderSet:
        return cls(spark.read.parquet(path))
