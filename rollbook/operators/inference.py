"""Predictions: checking, storing, looking up, and turning them into probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.sources.shared import free

KEY = ("name", "country_id", "name_mode")
STORED = (*KEY, "gender", "probability", "count", "queried_at")
#: Names in one request to a predictor.
BATCH = 100
#: Confidence classes. Fixed values.
HIGH, MEDIUM, LOW, NONE = "alta confiança", "confiança moderada", "baixa confiança", "não identificado"


def violation(gender: Column, probability: Column, count: Column) -> Column:
    """Why a prediction is not valid; null if it is."""
    return (
        F.when(gender.isNotNull() & ~gender.isin("female", "male"), "gender")
        .when(gender.isNotNull() & probability.isNull(), "probability missing")
        .when(probability.isNotNull() & (F.isnan(probability) | (probability < 0) | (probability > 1)), "probability")
        .when(count.isNotNull() & (count < 0), "count")
    )


def split_valid(predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid predictions, and the others with the reason."""
    marked = predictions.withColumn("reason", violation(F.col("gender"), F.col("probability"), F.col("count")))
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def mismatches(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers (batch, pos, name, country_id) that differ from what was asked, or are missing or surplus: batch, pos, reason."""
    a, b = asked.alias("a"), answers.alias("b")
    both = a.join(b, [F.col("a.batch") == F.col("b.batch"), F.col("a.pos") == F.col("b.pos")], "full_outer")
    reason = (
        F.when(F.col("b.pos").isNull(), "missing").when(F.col("a.pos").isNull(), "surplus").when(~F.col("a.name").eqNullSafe(F.col("b.name")), "name")
        .when(F.col("b.country_id").isNotNull() & (F.col("b.country_id") != F.col("a.country_id")), "country")
    )
    return both.select(F.coalesce("a.batch", "b.batch").alias("batch"), F.coalesce("a.pos", "b.pos").alias("pos"), reason.alias("reason")).where("reason IS NOT NULL")


def upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store after replacing or adding rows by (name, country, mode): the latest ``queried_at`` stays, new rows before old
    at equal times. Only the stored columns are kept."""
    both = store.select(*STORED, F.lit(0).alias("fresh")).unionByName(new.select(*STORED, F.lit(1).alias("fresh")))
    latest = F.max_by(F.struct(*STORED), F.struct("queried_at", "fresh", F.struct("gender", "probability", "count")))
    return both.groupBy(*KEY).agg(latest.alias("row")).select("row.*")


def lookup(asked: DataFrame, store: DataFrame, country: str = "BR", mode: str = "full", name: str = "query_name") -> DataFrame:
    """``asked`` with gender, probability, count and known of its stored prediction. Another country or mode is a miss."""
    own = store.where((F.col("country_id") == country) & (F.col("name_mode") == mode)).select(
        F.col("name").alias("__name"), "gender", "probability", "count", F.lit(True).alias("known"))
    return asked.join(own, F.col(name) == F.col("__name"), "left").drop("__name").withColumn("known", F.coalesce("known", F.lit(False)))


def missing(asked: DataFrame, store: DataFrame, country: str = "BR", mode: str = "full", name: str = "query_name") -> DataFrame:
    """Distinct names without a stored answer, sorted into batches: name, batch, pos. An answer without gender is an answer."""
    own = store.where((F.col("country_id") == country) & (F.col("name_mode") == mode)).select("name")
    return numbered_batches(asked.select(F.col(name).alias("name")).distinct().join(own, "name", "left_anti"))


def numbered_batches(names: DataFrame) -> DataFrame:
    """name, batch, pos of distinct names: sorted, BATCH names in each batch."""
    return numbered(names, "name").select("name", F.floor(F.col("nth") / BATCH).alias("batch"), (F.col("nth") % BATCH).cast("int").alias("pos"))


def numbered(df: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """``df`` with nth, the 0-based place of its unique, non-null ``key``. A column nth of ``df`` is replaced, others stay whatever their names.

    The keys' quantiles part them into ranges; a row's range follows from its key alone, whoever computes it. Each range
    numbers its own rows and adds the rows of the ranges before, a table of a row per range; no task sees all rows.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    head, within, before = free(df, "head", "within", "before")
    parts = df.withColumn(head, _range_head(df, key, ranges))
    numbers = parts.withColumn(within, F.row_number().over(Window.partitionBy(head).orderBy(key)) - 1)
    sizes = parts.groupBy(head).agg(F.count("*").alias("n"))
    starts = sizes.select(head, F.coalesce(F.sum("n").over(Window.orderBy(head).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    return numbers.join(F.broadcast(starts), head).withColumn("nth", F.col(before) + F.col(within)).drop(head, within, before)


def _range_head(df: DataFrame, key: str, ranges: int) -> Column:
    """The number of range bounds that do not lie above the key. Bounds are keys: those of evenly spaced ranks of the hashed sample with the
    least hashes, so that they take one pass and no sort of all keys; they decide sizes alone, never the numbers."""
    few = df.select(F.col(key).alias("k")).where("k IS NOT NULL").orderBy(F.xxhash64("k"), "k").limit(ranges * 50)
    keys = sorted(r.k for r in few.collect())  # ranges * 50 at most
    bounds = sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []
    return _found(F.col(key), bounds) if bounds else F.lit(0)


def _found(key: Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` do not lie above the key, by halving: each key is made once, however many bounds there are, and held against
    the logarithm of their number."""
    steps, table = [1 << k for k in reversed(range(len(bounds).bit_length()))], F.array(*map(F.lit, bounds))
    search = lambda k: F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= k, at + step).otherwise(at))
    return F.transform(F.array(key), search)[0]


def apply_prediction(df: DataFrame, high: float = 0.90, medium: float = 0.75) -> DataFrame:
    """Add p_female, p_male and confidence_class from gender and probability.

    Without gender there is no p_female, never one half. The class goes by the probability of the predicted
    category, not by p_female.
    """
    if not 0 <= medium <= high <= 1:
        raise ValueError("thresholds must have 0 <= medium <= high <= 1")
    p, gender = F.col("probability"), F.col("gender")
    female = F.when(gender == "female", p).when(gender == "male", 1 - p)
    level = F.when(gender.isNull(), NONE).when(p >= high, HIGH).when(p >= medium, MEDIUM).otherwise(LOW)
    return df.withColumns({"p_female": female, "p_male": 1 - female, "confidence_class": level})


def infer(asked: DataFrame, store: DataFrame, **thresholds) -> DataFrame:
    return apply_prediction(lookup(asked, store), **thresholds)
