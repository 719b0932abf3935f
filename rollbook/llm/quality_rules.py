"""Quality rules whose cutoffs come from labelled holdouts, with a bound on the share of good documents they reject."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import WORD, cut, free, row_key

#: Rule -> its metric over the columns of ``measures``, and candidate cutoffs from strict to lenient. Fixed values.
RULES = {
    "symbols": ("n_symbols / word_chars", (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3)),
    "repeats": ("n_repeat_words / n_words", (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4)),
    "lines": ("n_dup_lines / n_lines", (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7)),
    "shouts": ("n_shouts / n_words", (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8)),
}
#: Among good documents of any stratum at most FALSE_SHARE are rejected by the learnt cutoffs, with confidence 1 - DOUBT.
FALSE_SHARE, DOUBT = 0.02, 0.05

#: Words in three-word windows found twice or more: equal neighbours among the sorted windows give the starts, and a
#: start adds the words from it on that the previous start has not covered.
_REPEATED = """
CASE WHEN size(windows) = size(array_distinct(windows)) THEN 0L ELSE
aggregate(
  transform(array(array_sort(transform(windows, (w, i) -> struct(w, i)))), s ->
    array_sort(transform(filter(s, (x, i) -> x.w = get(s, i - 1).w OR x.w = get(s, i + 1).w), x -> x.i)))[0],
  struct(-3 AS last, 0L AS total),
  (a, p) -> struct(p AS last, a.total + least(3, p - a.last) AS total),
  a -> a.total)
END
"""


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Per row of ``docs``: doc_id, stratum and the counts that the rules use, all long.

    n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words, n_shouts (exclamation marks).
    Null and empty texts count 0 everywhere. Nothing is shuffled: a text's windows are compared inside its own row, so a very
    long text is a long array there. Other columns of ``docs``, whatever their names, play no part.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({
        "words": F.regexp_extract_all("text", F.lit(f"({WORD})"), 1),
        "lines": F.expr(rf"filter(split(text, '\n'), x -> x rlike '{WORD}')".replace("\\", "\\\\")),
    })
    rows = rows.withColumn("windows", F.expr("CASE WHEN size(words) < 3 THEN array() ELSE transform(sequence(0, size(words) - 3), i -> concat_ws(' ', words[i], words[i + 1], words[i + 2])) END"))
    return rows.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_REPEATED).alias("n_repeat_words"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_shouts"),
    )


def cutoffs(measured: DataFrame, labels: DataFrame, false_share: float = FALSE_SHARE, doubt: float = DOUBT) -> DataFrame:
    """The cutoff of each rule and stratum: stratum, rule, cutoff, n_good, n_rejected, p_value.

    Holdout: the rows of ``measured`` that ``labels`` (doc_id, quality) marks good; ids labelled both ways are not
    good. A candidate rejects k of a stratum's n good documents. The exact binomial test asks how likely k or fewer
    are if the true share were false_share / rules: P(Bin(n, share) <= k). The strictest candidate passes whose
    p-value, and that of each more lenient one, is at most doubt / (rules * strata) (Bonferroni over the rules and
    strata; within one rule the candidates are tested from lenient to strict and testing stops at the first that
    fails, which needs no further correction). The shares add up over the rules, so all rules of a stratum together
    reject at most false_share of its good documents, with confidence 1 - doubt over all strata at once.

    A stratum with too few labels gets no row: its documents meet the base rule only. No labels: no rows.
    """
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = measured.where("n_words > 0").join(good, "doc_id", "left_semi")
    counts = held.groupBy("stratum").agg(
        F.count("*").alias("n_good"),
        *[F.count_if(F.expr(metric) > F.lit(c)).alias(f"{rule}_{i}") for rule, (metric, grid) in RULES.items() for i, c in enumerate(grid)],
    )
    tests = F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), F.col(f"{rule}_{i}").alias("n_rejected"))
        for rule, (_, grid) in RULES.items() for i, c in enumerate(grid)
    ]))
    share = false_share / len(RULES)
    tail = f"""aggregate(sequence(0L, n_rejected), struct(n_good * ln(1 - {share!r}D) AS here, 0D AS total),
        (a, i) -> struct(a.here + CASE WHEN i < n_good THEN ln((n_good - i) / (i + 1D)) + ln({share!r}D / (1 - {share!r}D)) ELSE 0D END AS here, a.total + exp(a.here) AS total),
        a -> a.total)"""
    tried = counts.select("stratum", "n_good", tests.alias("t")).select("stratum", "n_good", "t.*").withColumn(
        "p_value", F.when(F.col("n_rejected") > F.col("n_good") * 4 * share + 50, F.lit(1.0)).otherwise(F.expr(tail)))
    # beyond four times the allowed count the tail is 1 to all digits that matter; it is not summed
    strata = counts.agg(F.greatest(F.count("*"), F.lit(1)).alias("n_strata"))
    passed = tried.join(F.broadcast(strata), F.lit(True)).withColumn("ok", F.col("p_value") <= doubt / (len(RULES) * F.col("n_strata")))
    first = passed.groupBy("stratum", "rule").agg(F.max(F.when(~F.col("ok"), F.col("step"))).alias("failed"))
    same = [F.col("p.stratum").eqNullSafe(F.col("f.stratum")), F.col("p.rule") == F.col("f.rule"), F.col("p.step") == F.coalesce(F.col("f.failed") + 1, F.lit(0))]
    return passed.alias("p").join(first.alias("f"), same).select("p.stratum", "p.rule", "p.cutoff", "p.n_good", "p.n_rejected", "p.p_value")


def verdicts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", **risk) -> DataFrame:
    """Counts of every document, base_failed and kept, a row for each row of ``docs``.

    base_failed: fewer than 50 words, or more than half of them in repeated windows. kept: not base_failed and no
    metric over its stratum's learnt cutoff (see ``cutoffs``). Null and empty texts fail. A null stratum is a stratum.
    Repeated rows are judged alike and each counts in the holdout. The table of cutoffs has at most one row for
    each rule and stratum; it is grouped to one row per stratum and joined, however Spark sees fit.
    """
    measured = cut(measures(docs, doc_id, text, stratum))
    chosen = cutoffs(measured, labels, **risk).groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff")).withColumnRenamed("stratum", "known")
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    over = F.lit(False)
    for rule, (metric, _) in RULES.items():
        over = over | F.coalesce((F.col("n_words") > 0) & (F.expr(metric.replace("/", "/ nullif(") + ", 0)") > F.col(rule)), F.lit(False))
    joined = measured.join(chosen, F.col("stratum").eqNullSafe(F.col("known")), "left")
    return joined.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & ~over).drop("known", *RULES)


def kept_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", **risk) -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` keeps, whole. Rows that agree in id and text stay or go together: they stay
    if one of them, in its own stratum, is kept. Other columns stay, whatever their names. An empty table stays empty."""
    key = free(docs, "key")[0]
    keyed = docs.withColumn(key, row_key(doc_id, text))
    good = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("labelled"), "quality")
    # the verdicts go by row key; labels follow the ids to it
    held = keyed.select(F.col(doc_id).alias("labelled"), F.col(key).alias("doc_key")).join(good, "labelled").select(F.col("doc_key").alias("doc_id"), "quality")
    kept = verdicts(keyed, held, key, text, stratum, **risk).where("kept").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(kept, key, "left_semi").select(*docs.columns)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    got = verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_GRID = ", ".join(f"('{rule}', {i}, {c!r}::DOUBLE)" for rule, (_, grid) in RULES.items() for i, c in enumerate(grid))
ORACLE_SQL = {"op4_quality_rules": rf"""
WITH w AS (SELECT rowid AS r, doc_id, lang, coalesce(text, '') AS text FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
v AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM v)),
p AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
c AS (SELECT r, sum(least(3, i - before))::BIGINT AS n_repeat_words FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -9) AS before FROM p WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, lang, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(regexp_extract_all(text, '!'))::BIGINT AS n_shouts FROM v LEFT JOIN c USING (r)),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
x AS (SELECT doc_id, lang, n_words, rule, CASE rule WHEN 'symbols' THEN n_symbols / nullif(word_chars, 0) WHEN 'repeats' THEN n_repeat_words / nullif(n_words, 0)
    WHEN 'lines' THEN n_dup_lines / nullif(n_lines, 0) ELSE n_shouts / nullif(n_words, 0) END AS metric FROM m, (VALUES ('symbols'), ('repeats'), ('lines'), ('shouts')) AS q(rule) WHERE n_words > 0),
t AS (SELECT lang, grid.rule, step, cutoff, count(*) AS n, count(*) FILTER (metric > cutoff) AS k FROM x JOIN good USING (doc_id) JOIN (VALUES {_GRID}) AS grid(rule, step, cutoff) ON grid.rule = x.rule GROUP BY ALL),
s AS (SELECT t.*, CASE WHEN k >= n THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({FALSE_SHARE / len(RULES)!r}) + (n - i) * ln(1 - {FALSE_SHARE / len(RULES)!r})))
    FROM (SELECT unnest(range(0, k + 1)) AS i)) END AS p FROM t),
o AS (SELECT *, p <= {DOUBT!r} / ({len(RULES)} * (SELECT count(DISTINCT coalesce(lang, chr(1))) FROM t)) AS ok FROM s),
f AS (SELECT lang, rule, coalesce(max(step) FILTER (NOT ok), -1) + 1 AS step FROM o GROUP BY ALL),
z AS (SELECT o.lang, rule, o.cutoff FROM o JOIN f USING (rule, step) WHERE o.lang IS NOT DISTINCT FROM f.lang),
bad AS (SELECT DISTINCT doc_id FROM x JOIN z ON x.rule = z.rule AND x.lang IS NOT DISTINCT FROM z.lang WHERE metric > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM m
"""}
