"""Suppression of small cells, pseudonyms, and what may be stored. None of it is a guarantee of anonymity."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions.text import hmac_token
from rollbook.operators.summary import with_change

#: Columns that stay in a suppressed row, and the marks of a row. Fixed values.
LABELS = ("curso_normalizado", "periodo", "ano", "periodo_ingresso", "grupo")
SMALL, FEW_RESOLVED, FEW_MATCHES, FEW_COHORT = "grupo pequeno suprimido", "inferência suprimida: poucos resolvidos", "correspondências pequenas suprimidas", "inferência de coorte suprimida"
MATCH_FIELDS = ("n_matches_exact_unique", "match_proportion", "resolved_matched", "expected_female_matched", "expected_male_matched")
DEFAULT_REASON = "revisão"
#: Settings that a stored snapshot may keep. Fixed values, but for the predictor's name mode and batch size, which have names of our own.
SETTINGS = ("PROJECT_NAME", "COUNTRY_ID", "HIGH_CONFIDENCE", "MEDIUM_CONFIDENCE", "MONTE_CARLO_ITERATIONS", "RANDOM_SEED", "MIN_FOLLOWUP_SEMESTERS", "COURSES_OF_INTEREST", "COURSE_ALIASES", "MIN_GROUP_SIZE", "NAME_MODE", "BATCH_SIZE")


def protect(rows: DataFrame, minimum: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """Null what small counts would tell, and say so in ``privacidade``. Counts of 0 are not small.

    A group of fewer than ``minimum`` keeps its labels alone (LABELS and ``keep``); else one with few resolved keeps
    its total too; else few matches null the match fields. Then few resolved entrants or matches of a cohort
    null their expectations. Later marks replace earlier ones.
    """
    if minimum < 1:
        raise ValueError("minimum must be positive")
    names, labels = rows.columns, {*LABELS, *keep}
    small = lambda c: F.coalesce((F.col(c) > 0) & (F.col(c) < minimum), F.lit(False)) if c in names else F.lit(False)
    size = next((c for c in ("total", "n_ingressantes", "n") if c in names), "")
    out = rows.withColumns({"__group": small(size), "__few": small("resolvidos") & ~small(size), "__match": small("n_matches_exact_unique") & ~small(size)})
    values = {}
    for c in names:
        if c not in labels:
            gone = F.col("__group") | (F.col("__few") if c != "total" else F.lit(False)) | (F.col("__match") if c in MATCH_FIELDS else F.lit(False))
            values[c] = F.when(~gone, F.col(c))
    # the match count of a row with few resolved is already gone when it is looked at
    mark = F.when(F.col("__group"), SMALL).when(F.col("__match") & ~F.col("__few"), FEW_MATCHES).when(F.col("__few"), FEW_RESOLVED)
    out = out.withColumns(values | {"privacidade": mark}).drop("__group", "__few", "__match")
    for suffix in ("entrants", "matched"):
        fields = [c for c in (f"resolved_{suffix}", f"expected_female_{suffix}", f"expected_male_{suffix}") if c in names]
        if f"resolved_{suffix}" in names:
            out = out.withColumn("__few", small(f"resolved_{suffix}"))
            out = out.withColumns({c: F.when(~F.col("__few"), F.col(c)) for c in fields} | {"privacidade": F.when(F.col("__few"), FEW_COHORT).otherwise(F.col("privacidade"))}).drop("__few")
    return out


def protected_series(rows: DataFrame, keys: list[str], minimum: int = 5) -> DataFrame:
    """``protect``, then the change anew from what is left, so that a hidden value can't be worked out."""
    return with_change(protect(rows, minimum, tuple(keys)), keys)


def pseudonymize(records: DataFrame, key: bytes | None = None) -> DataFrame:
    """Names become tokens, all else that tells a person goes; links still give the same matches.

    The key is random and of one run, so tokens of two runs don't agree; under one key a retried task makes the same
    tokens. No shuffle.
    """
    names = set(records.columns)
    changed = {"nome_chave": hmac_token(F.col("nome_chave"), key or secrets.token_bytes(32)), "nome_original": F.lit(""), "nome_normalizado": F.lit(""), "pagina": F.lit(0), "numero_sequencial": F.lit(0).cast("long"),
               **{c: F.lit(None).cast("string") for c in ("turno", "tipo_ingresso", "motivo_entrada")}}
    return records.withColumns({c: v for c, v in changed.items() if c in names}).drop("source_sha256")


def document_labels(documents: DataFrame, name: str = "arquivo", order: str = "ordinal") -> DataFrame:
    """name, label documento_001, ... by first appearance. The table of distinct documents is small beside their records."""
    from rollbook.operators.inference import numbered

    first = documents.groupBy(name).agg(F.min(order).alias("first"))
    return numbered(first, "first").select(name, F.format_string("documento_%03d", F.col("nth") + 1).alias("label"))


def kept_settings(settings: dict) -> dict:
    return {k: v for k, v in settings.items() if k in SETTINGS}


def review_summary(review: DataFrame, reason: str = "motivo") -> DataFrame:
    return review.groupBy(F.coalesce(F.col(reason), F.lit(DEFAULT_REASON)).alias("motivo")).agg(F.count("*").alias("quantidade"))


def leaked_names(exported: DataFrame, names: DataFrame, name: str = "nome_original") -> DataFrame:
    """Values of text columns of ``exported`` that are names of people: column, value. Must be empty."""
    texts = [c for c, kind in exported.dtypes if kind == "string"]
    pairs = exported.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in texts])).alias("x")).select("x.*").where("value IS NOT NULL").distinct()
    return pairs.join(names.select(F.col(name).alias("value")), "value", "left_semi")
