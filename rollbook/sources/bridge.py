"""The registry tables made of the given order and customer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollbook.functions.periods import format_period, period_index
from rollbook.functions.text import plain_name_key
from rollbook.operators.inference import infer


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders O as entrants and F as graduates, the customer as the person, the priority as the course."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "F"))
    joined = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    year, half = F.year("o_orderdate"), F.when(F.month("o_orderdate") <= 6, 1).otherwise(2)
    kind = F.when(F.col("o_orderstatus") == "O", "ingressante").otherwise("concluinte")
    course, period = plain_name_key(F.col("o_orderpriority")), format_period(year, half)
    return joined.select(
        F.col("o_orderkey").alias("record_id"), kind.alias("tipo_registro"), F.concat_ws("_", kind, course, period).alias("arquivo"), F.lit(1).alias("pagina"),
        F.col("o_orderkey").alias("numero_sequencial"), F.col("o_orderpriority").alias("curso_original"), course.alias("curso_normalizado"),
        year.alias("ano"), half.alias("semestre"), period.alias("periodo"), period_index(period).alias("period_idx"),
        F.col("c_name").alias("nome_original"), plain_name_key(F.col("c_name")).alias("nome_chave"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored predictions by customer name: some missing, some without answer, probabilities on a grid of hundredths."""
    k = F.col("c_custkey")
    answered = k % 11 != 1
    return table(spark, sf_dir, "customer").where(k % 11 != 0).select(
        F.upper("c_name").alias("name"), F.lit("BR").alias("country_id"), F.lit("full").alias("name_mode"),
        F.when(answered, F.when(k % 5 < 2, "female").otherwise("male")).alias("gender"),
        F.when(answered, F.round(0.5 + (k % 51) / 100.0, 2)).alias("probability"),
        F.when(k % 17 != 0, 1 + k % 1000).alias("count"), F.lit("2026-01-01T00:00:00").alias("queried_at"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry with its predictions."""
    asked = registry(spark, sf_dir).withColumn("query_name", F.upper("nome_original"))
    return infer(asked, predictions(spark, sf_dir))


def rosters(spark: SparkSession, sf_dir: str, rows_per_page: int = 50) -> DataFrame:
    """Page texts (doc_id, page_no, text) that list the registry, one document per ``arquivo``."""
    reg = registry(spark, sf_dir).withColumn("person", roster_name(F.col("nome_original")))
    nth = F.row_number().over(_in_document())
    reg = reg.withColumn("page_no", F.floor((nth - 1) / rows_per_page).cast("int") + 1)
    entrant = F.col("tipo_registro") == "ingressante"
    line = F.concat_ws(" ", F.col("numero_sequencial"), F.col("person"), F.when(entrant, F.lit("Vestibular VESTIBULAR NOTURNO")).otherwise(F.lit("NOTURNO")))
    pages = reg.groupBy("arquivo", "page_no", "tipo_registro", "curso_original", "ano", "semestre").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("numero_sequencial", line.alias("line")))), lambda x: x["line"]), "\n").alias("rows"))
    title = F.when(entrant, F.lit(TITLES["ingressante"])).otherwise(F.lit(TITLES["concluinte"]))
    header = F.concat(F.when(entrant, F.lit("")).otherwise(F.lit("CONCLUINTES NO ")), F.lit("ANO/SEMESTRE: "), F.col("ano"), F.lit(" / "), F.col("semestre"))
    text = F.concat_ws("\n", title, F.concat(F.lit("CURSO: "), F.col("curso_original")), header, F.lit("SEQ NOME"), F.col("rows"))
    return pages.select(F.col("arquivo").alias("doc_id"), "page_no", text.alias("text"))


def faulty_rosters(spark: SparkSession, sf_dir: str, rows_per_page: int = 50) -> DataFrame:
    """``rosters`` numbered from 1 in each document, with the faults that real ones have. What happens to a row follows from its number,
    what happens to a document from its period:

    rows: graduates 5, 16, 27... have their names wrapped around the number; 8, 19, 30... come twice, at times with another shift;
    2, 13, 24... share their number with another name in every fourth period.
    documents, by period mod 6: right total, total one too high, two totals, right subtotal, a blank page, no title. By period mod 7:
    3 ends with a header without a period and a row below it, 4 with a number alone.
    """
    reg = registry(spark, sf_dir).withColumn("person", roster_name(F.col("nome_original")))
    reg = reg.withColumns({"nth": F.row_number().over(_in_document()), "n": F.count("*").over(_in_document().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    entrant, nth, period = F.col("tipo_registro") == "ingressante", F.col("nth"), F.col("period_idx")
    row = lambda person, shift: F.concat_ws(" ", nth, person, F.when(entrant, F.lit("Vestibular VESTIBULAR")), F.lit(shift))
    words, plain_row = F.split("person", " ", 2), row(F.col("person"), "NOTURNO")
    wrapped = F.concat_ws("\n", words[0], F.concat(nth, F.lit(" NOTURNO")), words[1])
    lines = (
        F.when((nth % 11 == 5) & ~entrant, wrapped)
        .when(nth % 11 == 8, F.concat_ws("\n", plain_row, F.when((nth % 2 == 0) & (period % 4 == 2), row(F.col("person"), "MATUTINO")).otherwise(plain_row)))
        .when((nth % 11 == 2) & (period % 4 == 1), F.concat_ws("\n", plain_row, row(F.concat("person", F.lit(" X")), "NOTURNO")))
        .otherwise(plain_row)
    )
    total = lambda k: F.concat(F.lit("Total: "), F.col("n") + k)
    tail = F.concat_ws(
        "\n", F.when(period % 6 == 0, total(0)).when(period % 6 == 1, total(1)).when(period % 6 == 2, F.concat_ws("\n", total(0), total(1))).when(period % 6 == 3, F.concat(F.lit("Subtotal de matriculados: "), "n")),
        F.when(period % 7 == 3, F.lit("ANO/SEMESTRE: sem data\n99999 FULANO Vestibular NOTURNO")).when(period % 7 == 4, F.lit("12345")))
    reg = reg.withColumns({"page_no": F.floor((nth - 1) / rows_per_page).cast("int") + 1, "line": F.when(nth == F.col("n"), F.concat_ws("\n", lines, F.when(tail != "", tail))).otherwise(lines)})
    pages = reg.groupBy("arquivo", "page_no", "tipo_registro", "curso_original", "ano", "semestre", "period_idx").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]), "\n").alias("rows"))
    title = F.when(period % 6 == 5, F.lit("LISTA")).when(entrant, F.lit(TITLES["ingressante"])).otherwise(F.lit(TITLES["concluinte"]))
    header = F.concat(F.when(entrant, F.lit("")).otherwise(F.lit("CONCLUINTES NO ")), F.lit("ANO/SEMESTRE: "), F.col("ano"), F.lit(" / "), F.col("semestre"))
    text = F.concat_ws("\n", title, F.concat(F.lit("CURSO: "), F.col("curso_original")), header, F.lit("SEQ NOME"), F.col("rows"))
    blank = reg.where((nth == F.col("n")) & (period % 6 == 4)).select(F.col("arquivo").alias("doc_id"), (F.col("page_no") + 1).alias("page_no"), F.lit(" \n").alias("text"))
    return pages.select(F.col("arquivo").alias("doc_id"), "page_no", text.alias("text")).union(blank)


def _in_document():
    return Window.partitionBy("arquivo").orderBy("numero_sequencial")


def roster_name(name):
    """A valid name out of a customer's: no digits, no number sign."""
    return F.translate(F.upper(name), "0123456789#", "ABCDEFGHIJ ")


from rollbook.operators.extract import TITLES  # noqa: E402
