"""What a public table must hold: schema, dimensions, keys, metrics, arithmetic, intervals."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.operators.summary import PUBLIC

PUBLIC_SCHEMA = (
    "tipo_registro string, curso string, agrupamento string, periodo string, total bigint, resolvidos bigint, nao_identificados bigint, cobertura double, expected_female double, expected_male double, "
    "female_percent_resolved double, male_percent_resolved double, variance_female double, interval95_lower_resolved bigint, interval95_upper_resolved bigint"
)
KEY = ("tipo_registro", "curso", "agrupamento", "periodo")


#: Types that may stand where the schema names the first.
KINDS = {"string": {"string"}, "bigint": {"bigint", "int", "smallint", "tinyint"}, "double": {"double", "float"}}


def check_schema(rows: DataFrame) -> None:
    """Exactly the public columns, each of its own kind: words, counts, or real numbers."""
    if sorted(rows.columns) != sorted(PUBLIC):
        raise ValueError(f"columns differ from the public ones: {sorted(set(rows.columns) ^ set(PUBLIC))}")
    kinds, asked = dict(rows.dtypes), dict(field.split() for field in PUBLIC_SCHEMA.split(", "))
    wrong = {c: kinds[c] for c in PUBLIC if kinds[c] not in KINDS[asked[c]]}
    if wrong:
        raise ValueError(f"columns of another kind than the public ones: {wrong}")


def _rules() -> dict:
    c = F.col
    no = lambda x: ~F.coalesce(x, F.lit(False))
    near = lambda a, b: F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))  # noqa: E731  large sums have no ninth place
    n, r, u = c("total"), c("resolvidos"), c("nao_identificados")
    low, high = c("interval95_lower_resolved"), c("interval95_upper_resolved")
    by_year = c("agrupamento") == "ano"
    course = (F.trim("curso") != "") & (F.length("curso") <= 200) & ~c("curso").rlike(r"^[=+@-]|[\r\n\t<>]")
    finite = F.lit(True)
    for m in PUBLIC[4:]:
        x = c(m).cast("double")
        finite = finite & F.coalesce(~F.isnan(x) & (x >= 0) & (x < float("inf")), F.lit(True))
    share = lambda p, e: F.when(r == 0, c(p).isNull()).otherwise(F.coalesce(near(c(p), 100 * c(e) / F.nullif(r, F.lit(0))), F.lit(False)))
    return {
        "kind": no(c("tipo_registro").isin("ingressante", "concluinte")), "grouping": no(c("agrupamento").isin("ano", "semestre")), "course": no(course),
        "period": no(F.when(by_year, c("periodo").rlike(r"^\p{Nd}{4}$")).otherwise(c("periodo").rlike(r"^\p{Nd}{4}/[12]$"))), "metric": ~finite,
        "counts": no((n == r + u) & (n >= 1)), "estimates": no(near(c("expected_female") + c("expected_male"), r)),
        "coverage": no(F.abs(c("cobertura") - r / F.nullif(n, F.lit(0))) <= 1e-9 * F.greatest(F.abs("cobertura"), F.lit(0.0))),
        "shares": no(share("female_percent_resolved", "expected_female") & share("male_percent_resolved", "expected_male")),
        "interval": no(F.when(r == 0, low.isNull() & high.isNull()).otherwise((low >= 0) & (low <= high) & (high <= r))),
    }


def violations(rows: DataFrame) -> DataFrame:
    """The key and the rule of every broken rule; empty for a valid table."""
    check_schema(rows)
    broken = F.array_compact(F.array(*[F.when(x, F.lit(name)) for name, x in _rules().items()]))
    single = rows.select(*KEY, F.explode(broken).alias("rule"))
    twice = rows.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").select(*KEY, F.lit("key").alias("rule"))
    return single.union(twice)


# The version of the public format and the fields beside its rows.
PUBLIC_VERSION = 1
ENVELOPE = ("schema_version", "generated_at", "analysis_at")


def check_envelope(envelope: dict) -> None:
    """Exactly the fields of ENVELOPE, the known version, and two times in ISO 8601."""
    if set(envelope) != set(ENVELOPE) or envelope["schema_version"] != PUBLIC_VERSION:
        raise ValueError("unknown public format")
    for name in ENVELOPE[1:]:
        datetime.fromisoformat(envelope[name])


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, with repetitions counted: side, then the columns."""
    b = b.select(*a.columns)
    return a.exceptAll(b).select(F.lit("first").alias("side"), "*").union(b.exceptAll(a).select(F.lit("second").alias("side"), "*"))


def check_pair(a: DataFrame, b: DataFrame) -> None:
    if not difference(a, b).isEmpty():
        raise ValueError("the two publications differ")
