"""Linking entrants to later graduates, only where the link is unique in both directions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.periods import period_index
from rollbook.operators.inference import numbered
from rollbook.sources.shared import cut, spread_join

MATCH = ("entrant_id", "graduate_id", "status", "curso_normalizado", "periodo_ingresso", "periodo_conclusao", "semesters_to_graduation")


def match_cohorts(records: DataFrame) -> DataFrame:
    """One row per entrant with MATCH columns: exact_unique, ambiguous or not_found.

    Candidates are graduates of the same course and name key in a strictly later period. exact_unique needs one
    candidate of the entrant that is the candidate of no other entrant. No pairs are made: people are first counted by
    (course, name, period, kind), so that even a name that very many share is few rows; on those, running sums
    tell the later graduates and the earlier entrants. With one later graduate, that one is the last of its name.
    """
    graduate = F.col("tipo_registro") == "concluinte"
    keys = ["curso_normalizado", "nome_chave"]
    counts = records.where(F.col("tipo_registro").isin("ingressante", "concluinte")).groupBy(*keys, "period_idx").agg(
        F.count_if(graduate).alias("g"), F.count_if(~graduate).alias("e"), F.max_by(F.when(graduate, F.struct("record_id", "periodo")), F.when(graduate, F.col("record_id"))).alias("who"))
    name = Window.partitionBy(*keys)
    ahead = name.orderBy("period_idx").rowsBetween(1, Window.unboundedFollowing)
    behind = name.orderBy("period_idx").rowsBetween(Window.unboundedPreceding, -1)
    known = counts.withColumns({"later": F.coalesce(F.sum("g").over(ahead), F.lit(0)), "earlier": F.coalesce(F.sum("e").over(behind), F.lit(0))})
    last = F.max(F.when(F.col("g") > 0, F.struct("period_idx", "who", "earlier"))).over(name)
    known = known.withColumn("last", last).where("e > 0").select(*keys, "period_idx", "later", "last")
    entrants = records.where(F.col("tipo_registro") == "ingressante").select("record_id", "periodo", "period_idx", *keys)
    on = [F.col("r.period_idx") == F.col("k.period_idx"), *[F.col(f"r.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys]]
    exact = (F.col("later") == 1) & (F.col("last.earlier") == 1)
    return entrants.alias("r").join(known.alias("k"), on, "left").select(
        F.col("r.record_id").alias("entrant_id"), F.when(exact, F.col("last.who.record_id")).alias("graduate_id"),
        F.when(exact, "exact_unique").when(F.col("later") > 0, "ambiguous").otherwise("not_found").alias("status"),
        F.col("r.curso_normalizado").alias("curso_normalizado"), F.col("r.periodo").alias("periodo_ingresso"), F.when(exact, F.col("last.who.periodo")).alias("periodo_conclusao"),
        F.when(exact, F.col("last.period_idx") - F.col("r.period_idx")).alias("semesters_to_graduation"))


#: Graduates that one row of the candidates' table holds.
LIST = 1024


@dataclass
class Candidates:
    """All candidate lists without their pairs. Graduates stand once, in the order of course, name, period and id; the candidates of an entrant, those of its
    course and name of later periods, are the ``n`` from place ``first`` on. However many share a name, there is a row a person."""

    graduates: DataFrame  # block, ids (LIST graduates in order)
    entrants: DataFrame  # entrant_id, first (null without candidates), n


def candidate_index(records: DataFrame) -> Candidates:
    """``Candidates`` of all entrants; the records are read once, and what the index needs of them is written."""
    keys = ["curso_normalizado", "nome_chave"]
    spread = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = records.where(F.col("tipo_registro").isin("ingressante", "concluinte")).select("record_id", "tipo_registro", "period_idx", *keys)
    rows = cut(rows.repartition(spread, "record_id"))  # all tasks have as much, whatever the records' own parts
    people = rows.where("curso_normalizado IS NOT NULL AND nome_chave IS NOT NULL")
    # numbers as hex digits with the sign turned around: in the order of the numbers, negative ones first
    digits = lambda c: F.lpad(F.hex(F.col(c).cast("long").bitwiseXOR(F.lit(-1 << 63))), 16, "0")
    spot = F.concat_ws("\x00", *keys, digits("period_idx"), digits("record_id"))
    placed = cut(numbered(people.where("tipo_registro = 'concluinte'").withColumn("spot", spot), "spot").select("record_id", "period_idx", *keys, "nth"))
    cells = placed.groupBy(*keys, "period_idx").agg(F.min("nth").alias("start"), F.count("*").alias("g"))
    entered = people.where("tipo_registro = 'ingressante'")
    cells = cells.unionByName(entered.select(*keys, "period_idx").distinct(), allowMissingColumns=True).groupBy(*keys, "period_idx").agg(F.min("start").alias("start"), F.sum("g").alias("g"))
    ahead = Window.partitionBy(*keys).orderBy("period_idx").rowsBetween(1, Window.unboundedFollowing)  # a row for each period of a name
    later = cells.withColumns({"first": F.min("start").over(ahead), "n": F.coalesce(F.sum("g").over(ahead), F.lit(0))}).select(*keys, "period_idx", "first", "n")
    known = spread_join(entered, later, [*keys, "period_idx"], ["record_id"]).select(F.col("record_id").alias("entrant_id"), "first", "n")
    lost = rows.where("tipo_registro = 'ingressante' AND (curso_normalizado IS NULL OR nome_chave IS NULL)").select(F.col("record_id").alias("entrant_id"), F.lit(None).cast("long").alias("first"), F.lit(0).cast("long").alias("n"))
    blocks = placed.groupBy(F.floor(F.col("nth") / LIST).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "record_id"))), lambda x: x["record_id"]).alias("ids"))
    return Candidates(blocks, known.union(lost))


def candidate_pages(index: Candidates, size: int = LIST, page: int | None = None) -> DataFrame:
    """entrant_id, page, candidate_ids: the lists expanded in pages of ``size``, in the order of the index; with ``page`` that page alone, for those
    who look at one list at a time."""
    if size < 1:
        raise ValueError("size must be positive")
    pages = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / size)) if page is None else F.array(F.lit(page).cast("long"))
    asked = index.entrants.where(F.col("n") > (page or 0) * size).select("entrant_id", "first", "n", F.explode(pages).alias("page"))
    low = F.col("first") + F.col("page") * size
    asked = asked.select("entrant_id", "page", low.alias("low"), F.least(low + size, F.col("first") + F.col("n")).alias("high"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / LIST), F.floor((F.col("high") - 1) / LIST))))
    met = spread_join(asked, index.graduates, ["block"], ["entrant_id", "page"], "inner")
    begin = F.greatest(F.col("low") - F.col("block") * LIST, F.lit(0))
    own = F.slice("ids", (begin + 1).cast("int"), (F.least(F.col("high") - F.col("block") * LIST, F.lit(LIST)) - begin).cast("int"))
    parts = met.groupBy("entrant_id", "page").agg(F.array_sort(F.collect_list(F.struct("block", own.alias("ids")))).alias("parts"))
    return parts.select("entrant_id", "page", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("candidate_ids"))


def match_candidates(records: DataFrame) -> DataFrame:
    """entrant_id, graduate_id of every candidate pair: as many rows as there are pairs. ``candidate_index`` has the same in a row a person."""
    return candidate_pages(candidate_index(records)).select("entrant_id", F.explode("candidate_ids").alias("graduate_id"))


def candidate_lists(pages: DataFrame) -> DataFrame:
    """entrant_id, candidate_ids: the whole lists of ``candidate_pages``, ids in order, joined by semicolons."""
    ids = F.array_sort(F.flatten(F.collect_list("candidate_ids")))
    return pages.groupBy("entrant_id").agg(F.array_join(F.transform(ids, lambda x: x.cast("string")), ";").alias("candidate_ids"))


def latest_graduation(records: DataFrame) -> DataFrame:
    """curso_normalizado (null: all), latest period of graduates."""
    grads = records.where(F.col("tipo_registro") == "concluinte")
    return grads.rollup("curso_normalizado").agg(F.max_by("periodo", period_index(F.col("periodo"))).alias("latest"), F.grouping("curso_normalizado").alias("is_all"))


def enrich(records: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches with p_female, p_male of the entrant and latest_course, latest_all."""
    latest = latest_graduation(records)
    course = latest.where("is_all = 0").select("curso_normalizado", F.col("latest").alias("latest_course"))
    overall = latest.where("is_all = 1").agg(F.max("latest").alias("latest_all"))
    people = records.select(F.col("record_id").alias("entrant_id"), "p_female", "p_male")
    return matches.join(people, "entrant_id").join(course, "curso_normalizado", "left").join(F.broadcast(overall), F.lit(True))  # one row


def summarize_cohorts(records: DataFrame, matches: DataFrame, min_followup: int | None = None) -> DataFrame:
    """Per course and entry period: entrants, exact matches, their resolved and expected counts, follow-up, match proportion.

    followup_semesters: from entry to the course's latest graduation period, at least 0; null without graduates. With
    ``min_followup``, cohorts of less or unknown follow-up are left out.
    """
    exact = F.col("status") == "exact_unique"
    real = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    sums = enrich(records, matches).groupBy("curso_normalizado", "periodo_ingresso").agg(
        F.count("*").alias("n_ingressantes"), F.count("p_female").alias("resolved_entrants"), real("p_female").alias("expected_female_entrants"), real("p_male").alias("expected_male_entrants"),
        F.count_if(exact).alias("n_matches_exact_unique"), F.count(F.when(exact, F.col("p_female"))).alias("resolved_matched"),
        real(F.when(exact, F.col("p_female"))).alias("expected_female_matched"), real(F.when(exact, F.col("p_male"))).alias("expected_male_matched"),
        F.first("latest_all").alias("latest_graduation_period"), F.first("latest_course").alias("latest_graduation_period_course"))
    followup = F.greatest(F.lit(0), period_index(F.col("latest_graduation_period_course")) - period_index(F.col("periodo_ingresso")))
    out = sums.withColumn("followup_semesters", F.when(F.col("latest_graduation_period_course").isNotNull(), followup)).withColumn("match_proportion", F.col("n_matches_exact_unique") / F.col("n_ingressantes"))
    return out if min_followup is None else out.where(F.col("followup_semesters") >= min_followup)


def time_to_graduation(spark, matches: DataFrame) -> DataFrame:
    """n, mean, median, least and most semesters of exact matches: grupo 'global' (always there) and each course."""
    d = F.col("semesters_to_graduation")
    exact = matches.where(F.col("status") == "exact_unique")
    rows = exact.rollup("curso_normalizado").agg(
        F.count("*").alias("n"), F.avg(d).alias("media_semestres"), F.percentile(d, F.lit(0.5)).alias("mediana_semestres"), F.min(d).alias("min_semestres"), F.max(d).alias("max_semestres"), F.grouping("curso_normalizado").alias("all"))
    rows = rows.withColumn("grupo", F.when(F.col("all") == 1, "global").otherwise(F.col("curso_normalizado"))).drop("all", "curso_normalizado")
    named = spark.range(1).select(F.lit("global").alias("grupo"))
    empty = named.join(rows.select("grupo"), "grupo", "left_anti").select("grupo", F.lit(0).cast("long").alias("n"))
    return rows.unionByName(empty, allowMissingColumns=True).select("grupo", "n", "media_semestres", "mediana_semestres", "min_semestres", "max_semestres")
