"""Expected counts with exact intervals over any grouping, their change in time, and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.periods import period_index
from rollbook.operators.distribution import distributions, merged, with_quantiles
from rollbook.operators.inference import HIGH, LOW, MEDIUM

METRICS = (
    "total", "resolvidos", "nao_identificados", "cobertura", "expected_female", "expected_male", "female_percent_resolved", "male_percent_resolved", "variance_female", "sd_female",
    "interval95_lower_resolved", "interval95_upper_resolved", "conservative_count_lower", "conservative_count_upper", "conservative_percent_lower", "conservative_percent_upper",
    "expected_female_percent_total_min", "expected_female_percent_total_max", "alta_confianca", "moderada", "baixa", "probability_media", "probability_mediana", "count_medio", "count_mediano",
)
ALL_COURSES = "Todos os cursos"


def ratio(a: Column, b: Column, times: float = 1.0) -> Column:
    """times * a / b, null where b is 0."""
    return F.when(b != 0, times * a / b)


def cells(records: DataFrame, keys: list[str]) -> DataFrame:
    """Records counted by keys and what the metrics use; the groupings below work on this much smaller table."""
    return records.groupBy(*keys, "p_female", "probability", "count", "confidence_class").agg(F.count("*").alias("n"))


def _aggregates() -> list[Column]:
    n, q = F.col("n"), F.col("p_female")
    known = q.isNotNull()
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    real = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    at = lambda c: F.when(known, F.col(c).cast("double"))
    mean = lambda c: F.sum(at(c) * n) / F.sum(F.when(at(c).isNotNull(), n))
    # the weighted median: percentile() with frequencies; a null has none
    middle = lambda c: F.expr(f"percentile(CASE WHEN p_female IS NOT NULL THEN CAST({c} AS DOUBLE) END, 0.5, n)")
    return [
        total(n).alias("total"), total(F.when(known, n)).alias("resolvidos"), real(q * n).alias("expected_female"), real(q * (1 - q) * n).alias("variance_female"),
        *[total(F.when(F.col("confidence_class") == c, n)).alias(name) for name, c in (("alta_confianca", HIGH), ("moderada", MEDIUM), ("baixa", LOW))],
        mean("probability").alias("probability_media"), middle("probability").alias("probability_mediana"), mean("count").alias("count_medio"), middle("count").alias("count_mediano"),
    ]


def _finished(sums: DataFrame, keys: list[str]) -> DataFrame:
    """All metrics from the sums and the bounds low, high of the number of successes."""
    n, r, e = F.col("total"), F.col("resolvidos"), F.col("expected_female")
    unknown, low, high = n - r, F.col("low"), F.col("high")
    when = lambda x: F.when(r > 0, x)
    return sums.withColumns({
        "nao_identificados": unknown, "cobertura": ratio(r, n), "expected_male": r - e,
        "female_percent_resolved": ratio(e, r, 100.0), "male_percent_resolved": ratio(r - e, r, 100.0), "sd_female": F.sqrt("variance_female"),
        "interval95_lower_resolved": when(low), "interval95_upper_resolved": when(high), "conservative_count_lower": low, "conservative_count_upper": high + unknown,
        "conservative_percent_lower": ratio(low, n, 100.0), "conservative_percent_upper": ratio(high + unknown, n, 100.0),
        "expected_female_percent_total_min": ratio(e, n, 100.0), "expected_female_percent_total_max": ratio(e + unknown, n, 100.0),
    }).select(*keys, *METRICS)


def _joined(sums: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """``sums`` with low and high of each group's distribution; 0 where it has none."""
    bounds = with_quantiles(bounds, {"low": 0.025, "high": 0.975}).select(*[F.col(k).alias(f"__{k}") for k in keys], "low", "high")
    if not keys:
        return sums.join(F.broadcast(bounds), F.lit(True), "left").fillna(0, ["low", "high"])  # one row
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return sums.join(bounds, on, "left").fillna(0, ["low", "high"])


def summarize(records: DataFrame, keys: list[str] | tuple = (), counted: bool = False) -> DataFrame:
    """The 25 METRICS of each group. Without keys one row, also for no records. ``counted``: records are ``cells``.

    Unknown inference is never counted as either: shares are of resolved records, the conservative bounds let every
    unknown be neither or all. Without resolved records shares and intervals are null, the conservative bounds 0 and U.
    """
    keys = list(keys)
    table = records if counted else cells(records, keys)
    return _finished(_joined(table.groupBy(*keys).agg(*_aggregates()), distributions(table, keys, "p_female", "n"), keys), keys)


def lattice(counted: DataFrame, keys: list[str], sets: list[tuple[str, ...]], always: tuple[str, ...] = ()) -> dict[tuple[str, ...], DataFrame]:
    """The distribution of each group of each set: set -> always, its keys, STATE.

    Cells meet the helper once, at the finest grouping. Every coarser set merges the distributions of the smallest set above it: their lengths
    grow with the square root of the records, so what goes up is small. The keys that a set leaves out deal a group over tasks.
    """
    spread = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    finest = tuple(k for k in keys if any(k in s for s in sets))
    made = {finest: distributions(counted, [*always, *finest], "p_female", "n")}
    for s in sorted(set(sets) - {finest}, key=lambda s: (-len(s), s)):
        above = min((k for k in made if set(s) < set(k)), key=lambda k: (len(k), k))
        gone = [k for k in above if k not in s]
        made[s] = merged(made[above], [*always, *s], F.pmod(F.xxhash64(*gone), F.lit(spread)), spread)
    return {s: made[s] for s in sets}


def grouping_sets(records: DataFrame, keys: list[str], sets: list[tuple[str, ...]], always: tuple[str, ...] = ()) -> DataFrame:
    """Metrics over several groupings at once: ``always`` plus each of ``sets``; level names the set ('' is the total).

    Records are counted to cells once; the cells are repeated for the sets' sums, their distributions merge upward (see ``lattice``).
    """
    table = cells(records, [*always, *keys])
    kinds = dict(table.dtypes)
    named = lambda s: [F.lit(",".join(s)).alias("level"), *always, *[F.col(k) if k in s else F.lit(None).cast(kinds[k]).alias(k) for k in keys]]
    rows = [table.select(*named(s), "p_female", "probability", "count", "confidence_class", "n") for s in sets]
    bounds = [states.select(*named(s), "draws", "offset", "mass") for s, states in lattice(table, keys, sets, always).items()]
    groups = ["level", *always, *keys]
    sums = reduce(DataFrame.unionByName, rows).groupBy(*groups).agg(*_aggregates())
    return _finished(_joined(sums, reduce(DataFrame.unionByName, bounds), groups), groups)


def report_sets(records: DataFrame) -> DataFrame:
    """Per kind: everything, by course, by year, by both, by period, by course and period."""
    sets = [(), ("curso_normalizado",), ("ano",), ("curso_normalizado", "ano"), ("periodo",), ("curso_normalizado", "periodo")]
    return grouping_sets(records, ["curso_normalizado", "ano", "periodo"], sets, ("tipo_registro",))


PUBLIC = ("tipo_registro", "curso", "agrupamento", "periodo", "total", "resolvidos", "nao_identificados", "cobertura", "expected_female", "expected_male", "female_percent_resolved",
          "male_percent_resolved", "variance_female", "interval95_lower_resolved", "interval95_upper_resolved")
PUBLIC_SETS = [("ano",), ("periodo",), ("curso_normalizado", "ano"), ("curso_normalizado", "periodo")]


def public_rows(records: DataFrame) -> DataFrame:
    """The public table: kind x (year, half year) x (all courses, each course). Not suppressed; scopes overlap."""
    return public_of(grouping_sets(records, ["curso_normalizado", "ano", "periodo"], PUBLIC_SETS, ("tipo_registro",)))


def public_of(rows: DataFrame) -> DataFrame:
    """The public table out of the rows of ``report_sets``."""
    by_year = F.col("level").endswith("ano")
    return rows.where(F.col("level").isin([",".join(s) for s in PUBLIC_SETS])).withColumns({
        "curso": F.when(F.col("level").startswith("curso"), F.col("curso_normalizado")).otherwise(ALL_COURSES),
        "agrupamento": F.when(by_year, "ano").otherwise("semestre"), "periodo": F.when(by_year, F.col("ano").cast("string")).otherwise(F.col("periodo")),
    }).select(*PUBLIC)


def series_of(rows: DataFrame, by_course: bool = False) -> DataFrame:
    """Kind by period, or kind and course by period, out of the rows of ``report_sets``; as ``temporal`` makes it from records."""
    keys = ["tipo_registro", *(["curso_normalizado"] if by_course else [])]
    return with_change(rows.where(F.col("level") == ",".join([*keys[1:], "periodo"])).select(*keys, "periodo", *METRICS), keys)


def with_change(rows: DataFrame, keys: list[str], value: str = "female_percent_resolved") -> DataFrame:
    """variacao_pp: the value minus that of the row before in the same series; null if either is null. Missing
    periods are not filled in."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(period_index(F.col("periodo"))))
    return rows.withColumn("variacao_pp", F.col(value) - before)


def temporal(records: DataFrame, by_course: bool = False, kind: str = "tipo_registro") -> DataFrame:
    keys = [kind, *(["curso_normalizado"] if by_course else [])]
    return with_change(summarize(records, [*keys, "periodo"]), keys)


def compare_periods(entrants: DataFrame, graduates: DataFrame) -> DataFrame:
    """Female shares of two series by period and their difference, null where one is missing."""
    a = entrants.select("periodo", F.col("female_percent_resolved").alias("female_percent_entrants"))
    b = graduates.select("periodo", F.col("female_percent_resolved").alias("female_percent_graduates"))
    return a.join(b, "periodo", "full_outer").withColumn("difference_pp_graduates_minus_entrants", F.col("female_percent_graduates") - F.col("female_percent_entrants"))


def dashboard_rollup(public: DataFrame, keys: list[str]) -> DataFrame:
    """Totals over chosen public rows; shares are of the sums, never means of shares. Don't add up across groupings or scopes."""
    n, r, e = F.col("total"), F.col("resolvidos"), F.col("expected_female")
    sums = public.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "resolvidos", "nao_identificados", "expected_female")])
    return sums.withColumns({"female_percent": ratio(e, r, 100.0), "coverage_percent": ratio(r, n, 100.0)})
