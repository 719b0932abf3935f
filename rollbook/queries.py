"""The registered queries of the registry library, each beside the SQL that it must agree with."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions import periods, text
from rollbook.jobs import report
from rollbook.operators import charts, cohorts, distribution, extract, inference, privacy, quality, summary
from rollbook.sources import bridge, commits, predictions, scan, store
from rollbook.sources.bridge import table
from rollbook.sources.shared import cut, shared_folder

QUERIES: dict = {}
ORACLE_SQL: dict = {}

COURSES = ("1-urgent", "2-High")
ALIASES = {"1-URGENT": "Urgente", "5-low": "Baixa"}
TOKEN_KEY = b"a key for tests only"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


REG = """registry AS (SELECT o_orderkey AS record_id, CASE o_orderstatus WHEN 'O' THEN 'ingressante' ELSE 'concluinte' END AS tipo_registro, o_orderpriority AS curso_original,
    trim(regexp_replace(upper(o_orderpriority), '[^A-Z0-9]+', ' ', 'g')) AS curso_normalizado, year(o_orderdate)::INT AS ano, (CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END)::INT AS semestre,
    year(o_orderdate) || '/' || (CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END) AS periodo, (year(o_orderdate) * 2 + CASE WHEN month(o_orderdate) <= 6 THEN 0 ELSE 1 END)::INT AS period_idx,
    c_name AS nome_original, trim(regexp_replace(upper(c_name), '[^A-Z0-9]+', ' ', 'g')) AS nome_chave, upper(c_name) AS query_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('O', 'F'))"""
PRED = """predictions AS (SELECT upper(c_name) AS name, 'BR' AS country_id, 'full' AS name_mode, CASE WHEN c_custkey % 11 = 1 THEN NULL WHEN c_custkey % 5 < 2 THEN 'female' ELSE 'male' END AS gender,
    CASE WHEN c_custkey % 11 <> 1 THEN round(0.5 + (c_custkey % 51) / 100.0, 2)::DOUBLE END AS probability, CASE WHEN c_custkey % 17 <> 0 THEN 1 + c_custkey % 1000 END AS count,
    '2026-01-01T00:00:00' AS queried_at FROM customer WHERE c_custkey % 11 <> 0)"""
REC = f"""{REG}, {PRED}, records AS (SELECT r.*, p.gender, p.probability, p.count, p.name IS NOT NULL AS known,
    CASE gender WHEN 'female' THEN probability WHEN 'male' THEN 1 - probability END AS p_female,
    CASE gender WHEN 'female' THEN 1 - probability WHEN 'male' THEN 1 - (1 - probability) END AS p_male,
    CASE WHEN gender IS NULL THEN 'não identificado' WHEN probability >= 0.9 THEN 'alta confiança' WHEN probability >= 0.75 THEN 'confiança moderada' ELSE 'baixa confiança' END AS confidence_class
    FROM registry r LEFT JOIN predictions p ON r.query_name = p.name)"""


def dist_sql(source: str, key: str) -> str:
    """CTEs that end in pmf(key, k, mass, cdf) by the transform of the characteristic function, and bounds(key, low, high)."""
    return f"""h AS (SELECT {key} AS key, p_female AS q, count(*) AS c FROM {source} GROUP BY ALL), sizes AS (SELECT key, coalesce(sum(c) FILTER (q IS NOT NULL), 0)::BIGINT AS n FROM h GROUP BY key),
    pts AS (SELECT key, n, unnest(range(0, n + 1)) AS l FROM sizes),
    cf AS (SELECT pts.key, pts.n, l, coalesce(sum(c * ln(greatest(sqrt((1 - q + q * cos(2 * pi() * l / (n + 1))) ** 2 + (q * sin(2 * pi() * l / (n + 1))) ** 2), 1e-300))), 0) AS size,
        coalesce(sum(c * atan2(q * sin(2 * pi() * l / (n + 1)), 1 - q + q * cos(2 * pi() * l / (n + 1)))), 0) AS turn FROM pts LEFT JOIN h ON pts.key = h.key AND q IS NOT NULL GROUP BY ALL),
    mass AS (SELECT key, k, greatest(sum(exp(size) * cos(turn - 2 * pi() * ((l * k) % (n + 1)) / (n + 1))) / (n + 1), 0) AS mass FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM cf) GROUP BY key, k, n),
    pmf AS (SELECT *, sum(mass) OVER (PARTITION BY key ORDER BY k) AS cdf FROM mass),
    bounds AS (SELECT key, coalesce(min(k) FILTER (cdf >= 0.025), max(k)) AS low, coalesce(min(k) FILTER (cdf >= 0.975), max(k)) AS high FROM pmf GROUP BY key)"""


def sums_sql(keys: list[str], source: str = "records") -> str:
    """CTEs stats(keys, the 25 metrics) of groups of ``source``."""
    key = "concat_ws('|', " + ", ".join(f"coalesce({k}::VARCHAR, '-')" for k in keys) + ")" if keys else "''"
    cols = "".join(f"{k}, " for k in keys)
    return dist_sql(source, key) + f""", sums AS (SELECT {cols}{key} AS key, count(*) AS total, count(p_female) AS resolvidos, coalesce(sum(p_female), 0) AS e, coalesce(sum(p_female * (1 - p_female)), 0) AS v,
        count(*) FILTER (confidence_class = 'alta confiança') AS alta_confianca, count(*) FILTER (confidence_class = 'confiança moderada') AS moderada, count(*) FILTER (confidence_class = 'baixa confiança') AS baixa,
        avg(probability) FILTER (p_female IS NOT NULL) AS probability_media, median(probability) FILTER (p_female IS NOT NULL) AS probability_mediana,
        avg(count) FILTER (p_female IS NOT NULL) AS count_medio, median(count) FILTER (p_female IS NOT NULL) AS count_mediano FROM {source} {"GROUP BY ALL" if keys else ""}),
    stats AS (SELECT {cols}total, resolvidos, total - resolvidos AS nao_identificados, resolvidos / nullif(total, 0) AS cobertura, e AS expected_female, resolvidos - e AS expected_male, 100 * e / nullif(resolvidos, 0) AS female_percent_resolved,
        100 * (resolvidos - e) / nullif(resolvidos, 0) AS male_percent_resolved, v AS variance_female, sqrt(v) AS sd_female, CASE WHEN resolvidos > 0 THEN low END AS interval95_lower_resolved,
        CASE WHEN resolvidos > 0 THEN high END AS interval95_upper_resolved, low AS conservative_count_lower, high + total - resolvidos AS conservative_count_upper, 100 * low / nullif(total, 0) AS conservative_percent_lower,
        100 * (high + total - resolvidos) / nullif(total, 0) AS conservative_percent_upper, 100 * e / nullif(total, 0) AS expected_female_percent_total_min, 100 * (e + total - resolvidos) / nullif(total, 0) AS expected_female_percent_total_max,
        alta_confianca, moderada, baixa, probability_media, probability_mediana, count_medio, count_mediano FROM sums JOIN bounds USING (key))"""


REALS = {
    "cobertura", "expected_female", "expected_male", "female_percent_resolved", "male_percent_resolved", "variance_female", "sd_female", "conservative_percent_lower", "conservative_percent_upper", "expected_female_percent_total_min",
    "expected_female_percent_total_max", "probability_media", "probability_mediana", "count_medio", "count_mediano", "variacao_pp", "female_percent_entrants", "female_percent_graduates", "difference_pp_graduates_minus_entrants",
    "expected_female_entrants", "expected_male_entrants", "expected_female_matched", "expected_male_matched", "match_proportion", "media_semestres", "mediana_semestres", "female_percent", "coverage_percent", "lower_percent", "upper_percent",
    "match_percent", "mass", "cdf", "p_female", "p_male", "probability", "expected_share",
}


def even(df: DataFrame) -> DataFrame:
    """Real columns rounded to six places and counts as long, as the SQL side has them."""
    kinds = dict(df.dtypes)

    def one(c):
        if c in REALS:
            return (F.round(F.col(c).cast("double") + F.lit(1e-10), 6) + F.lit(0.0)).alias(c)
        return F.col(c).cast("long").alias(c) if kinds[c] in ("int", "bigint") else F.col(c)

    return df.select(*[one(c) for c in df.columns])


ALL = list(summary.METRICS)
S4 = ["total", "resolvidos", "nao_identificados", "cobertura", "expected_female", "female_percent_resolved", "variance_female", "interval95_lower_resolved", "interval95_upper_resolved", "conservative_count_upper"]


def longs(columns: list[str], text_columns: tuple[str, ...]) -> str:
    return ", ".join(c if c in text_columns else f"round({c}::DOUBLE + 1e-10, 6) + 0.0 AS {c}" if c in REALS else f"{c}::BIGINT AS {c}" for c in columns)


WORDS = ("tipo_registro", "curso_normalizado", "periodo", "level", "curso", "agrupamento", "periodo_ingresso", "periodo_conclusao", "status", "grupo", "privacidade", "latest_graduation_period", "latest_graduation_period_course", "candidate_ids")


def picked(columns: list[str]) -> str:
    return longs(columns, WORDS)


# --- sources and sinks ---------------------------------------------------------------------------------------------


@query("""SELECT doc_id, sha256(text) AS digest, doc_id % 3 <> 0 AS archived, doc_id % 3 = 0 OR (NOT bool_or(doc_id % 3 = 0) OVER (PARTITION BY text) AND doc_id = min(doc_id) FILTER (doc_id % 3 <> 0) OVER (PARTITION BY text)) AS kept FROM documents""")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("archived", F.col("doc_id") % 3 != 0)
    return scan.content_dedup(docs, "text")


@query()
def discover_documents(spark, sf_dir):
    return scan.discover_documents(spark, sf_dir, "parquet")


def _folder(spark: SparkSession) -> str:
    """A new folder below the one that all machines share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@query(f"WITH {REC} SELECT record_id, tipo_registro, curso_normalizado, periodo, nome_original, numero_sequencial::BIGINT AS numero_sequencial, round(p_female, 6) + 0.0 AS p_female FROM (SELECT * REPLACE ('' AS nome_original), 0 AS numero_sequencial FROM records)")
def snapshot_round_trip(spark, sf_dir):
    folder = _folder(spark)
    store.write_snapshot(bridge.records(spark, sf_dir), folder, {"MIN_GROUP_SIZE": 5, "OTHER": 1})
    rows, _ = store.read_snapshot(spark, folder)
    return even(rows.select("record_id", "tipo_registro", "curso_normalizado", "periodo", "nome_original", "numero_sequencial", "p_female"))


@query(f"""WITH {PRED}, fresh AS (SELECT name, country_id, name_mode, 'female' AS gender, 0.99 AS probability, 7 AS count, '2026-02-01T00:00:00' AS queried_at FROM predictions WHERE hash(name) IS NOT NULL AND right(name, 1) = '7')
SELECT name, country_id, name_mode, gender, round(probability::DOUBLE, 6) + 0.0 AS probability, count::BIGINT AS count, queried_at FROM predictions WHERE right(name, 1) <> '7' UNION ALL SELECT * REPLACE (round(probability::DOUBLE, 6) + 0.0 AS probability, count::BIGINT AS count) FROM fresh""")
def prediction_store_upsert(spark, sf_dir):
    old = bridge.predictions(spark, sf_dir)
    new = old.where("right(name, 1) = '7'").withColumns({"gender": F.lit("female"), "probability": F.lit(0.99), "count": F.lit(7).cast("long"), "queried_at": F.lit("2026-02-01T00:00:00")})
    return even(inference.upsert(old, new))


# the same as a stored table: all predictions, then those of names that end in 7 anew
@query(ORACLE_SQL["prediction_store_upsert"])
def prediction_table(spark, sf_dir):
    folder, old = _folder(spark), bridge.predictions(spark, sf_dir)
    predictions.save(spark, folder, old)
    new = {"gender": F.lit("female"), "probability": F.lit(0.99), "count": F.lit(7).cast("long"), "queried_at": F.lit("2026-02-01T00:00:00")}
    predictions.save(spark, folder, old.where("right(name, 1) = '7'").withColumns(new))
    return even(predictions.load(spark, folder))


# what the stored table has no answer to; stored answers without a gender are answers
@query(f"WITH {REC}, m AS (SELECT DISTINCT query_name FROM records WHERE NOT known) SELECT query_name AS name, (row_number() OVER (ORDER BY query_name) - 1) // 100 AS batch, (row_number() OVER (ORDER BY query_name) - 1) % 100 AS pos FROM m")
def prediction_table_missing(spark, sf_dir):
    folder = _folder(spark)
    predictions.save(spark, folder, bridge.predictions(spark, sf_dir))
    return even(predictions.missing(spark, folder, bridge.registry(spark, sf_dir).select(F.upper("nome_original").alias("query_name"))))


# four snapshots one after another: two are kept, the last one holds
@query(f"WITH {REG} SELECT 3::BIGINT AS last_number, 2::BIGINT AS kept, 2::BIGINT AS folders, 9::BIGINT AS minimum, count(*) AS n_rows FROM registry WHERE tipo_registro = 'concluinte'")
def snapshot_versions(spark, sf_dir):
    folder, rec = _folder(spark), bridge.records(spark, sf_dir)
    for minimum, rows in ((5, rec), (7, rec.where("tipo_registro = 'ingressante'")), (8, rec), (9, rec.where("tipo_registro = 'concluinte'"))):
        store.write_snapshot(rows, folder, {"MIN_GROUP_SIZE": minimum})
    rows, settings = store.read_snapshot(spark, folder)
    log = commits.history(spark, folder)
    beside = {"last_number": log[-1][0], "kept": len(log), "folders": len(commits.versions(spark, folder)), "minimum": settings["MIN_GROUP_SIZE"]}
    return even(rows.agg(*[F.lit(v).cast("long").alias(k) for k, v in beside.items()], F.count("*").alias("n_rows")))


@query(f"WITH {REC} SELECT DISTINCT query_name, gender, round(probability, 6) + 0.0 AS probability, count::BIGINT AS count, known FROM records")
def prediction_store_get(spark, sf_dir):
    asked = bridge.registry(spark, sf_dir).select(F.upper("nome_original").alias("query_name")).distinct()
    return even(inference.lookup(asked, bridge.predictions(spark, sf_dir)))


# --- functions -----------------------------------------------------------------------------------------------------

LATIN = "SELECT DISTINCT unnest(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS word FROM documents"


def _words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"([^ \t\n\r]+)"), 1)).alias("word")).distinct()


@query(f"SELECT word, trim(regexp_replace(nfc_normalize(word), '\\s+', ' ', 'g')) AS name FROM ({LATIN})")
def normalize_name(spark, sf_dir):
    return _words(spark, sf_dir).select("word", text.normalize_name("word").alias("name"))


@query(f"SELECT word, trim(regexp_replace(replace(upper(strip_accents(replace(word, 'ß', 'SS'))), '_', ' '), '[^\\pL\\pN]+', ' ', 'g')) AS key FROM ({LATIN})")
def name_key_of_words(spark, sf_dir):
    return _words(spark, sf_dir).select("word", text.name_key("word").alias("key"))


@query(f"WITH {REG} SELECT DISTINCT nome_original, upper(nome_original) AS whole, upper(split_part(nome_original, ' ', 1)) AS first FROM registry")
def query_name(spark, sf_dir):
    names = bridge.registry(spark, sf_dir).select("nome_original").distinct()
    return names.select("nome_original", text.query_name(F.col("nome_original")).alias("whole"), text.query_name(F.col("nome_original"), "first").alias("first"))


@query(f"WITH {REG} SELECT record_id, periodo, period_idx::BIGINT AS period_idx, (1998 * 2 + 1 - period_idx)::BIGINT AS until FROM registry")
def period_functions(spark, sf_dir):
    reg = bridge.registry(spark, sf_dir)
    p = periods.format_period(F.col("ano"), F.col("semestre"))
    return even(reg.select("record_id", p.alias("periodo"), periods.period_index(p).alias("period_idx"), periods.semester_difference(p, F.lit("1998/2")).alias("until")))


@query(f"WITH {REG} SELECT record_id, CASE curso_normalizado WHEN '1 URGENT' THEN 'URGENTE' WHEN '5 LOW' THEN 'BAIXA' ELSE curso_normalizado END AS curso FROM registry")
def course_alias(spark, sf_dir):
    return bridge.registry(spark, sf_dir).select("record_id", text.course_alias(F.col("curso_normalizado"), ALIASES).alias("curso"))


@query(f"WITH {REC} SELECT record_id, gender, round(p_female, 6) + 0.0 AS p_female, round(p_male, 6) + 0.0 AS p_male, confidence_class FROM records")
def apply_prediction(spark, sf_dir):
    return even(bridge.records(spark, sf_dir).select("record_id", "gender", "p_female", "p_male", "confidence_class"))


@query("SELECT c_custkey, regexp_matches(x, '^[\\pL\\pM .''’-]+$') AND x = upper(x) AS valid FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN translate(upper(c_name), '0123456789#', 'ABCDEFGHIJ ') ELSE translate(c_name, '0123456789#', 'ABCDEFGHIJ ') END AS x FROM customer)")
def valid_name(spark, sf_dir):
    k, n = F.col("c_custkey") % 3, F.col("c_name")
    name = F.when(k == 0, n).when(k == 1, bridge.roster_name(n)).otherwise(F.translate(n, "0123456789#", "ABCDEFGHIJ "))
    return table(spark, sf_dir, "customer").select("c_custkey", text.valid_name(name).alias("valid"))


def _hmac_sql(value: str, key: bytes) -> str:
    pads = ["".join(f"{x ^ b:02x}" for x in key.ljust(64, b"\0")) for b in (0x5C, 0x36)]
    return f"sha256(unhex('{pads[0]}') || unhex(sha256(unhex('{pads[1]}') || encode({value}))))"


@query(f"SELECT c_name, {_hmac_sql('c_name', TOKEN_KEY)} AS token FROM customer")
def hmac_token(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_name", text.hmac_token(F.col("c_name"), TOKEN_KEY).alias("token"))


# --- filters and checks --------------------------------------------------------------------------------------------


@query(f"WITH {REG} SELECT record_id, curso_normalizado, periodo FROM registry WHERE tipo_registro = 'concluinte' AND curso_normalizado IN ('1 URGENT', '2 HIGH') AND period_idx BETWEEN 3992 AND 3997")
def filters(spark, sf_dir):
    reg = bridge.registry(spark, sf_dir).where("tipo_registro = 'concluinte'").where(F.col("curso_normalizado").isin(text.keys_of(COURSES)))
    return charts.in_range(reg, "periodo", "1996/1", "1998/2").select("record_id", "curso_normalizado", "periodo")


@query("""WITH p AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'other' WHEN 1 THEN NULL ELSE 'male' END AS gender, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 1.5 ELSE 0.5 END AS probability, CASE c_custkey % 3 WHEN 0 THEN -1 ELSE 1 END AS count FROM customer)
SELECT c_custkey, CASE WHEN gender = 'other' THEN 'gender' WHEN gender IS NOT NULL AND probability IS NULL THEN 'probability missing' WHEN probability > 1 THEN 'probability' WHEN count < 0 THEN 'count' END AS reason FROM p""")
def valid_prediction(spark, sf_dir):
    k = F.col("c_custkey")
    gender = F.when(k % 7 == 0, "other").when(k % 7 > 1, "male")
    probability = F.when(k % 5 == 1, 1.5).when(k % 5 > 1, 0.5)
    return table(spark, sf_dir, "customer").select("c_custkey", inference.violation(gender, probability, F.when(k % 3 == 0, -1).otherwise(1)).alias("reason"))


@query("""SELECT (c_custkey // 100)::BIGINT AS batch, (c_custkey % 100)::BIGINT AS pos, CASE WHEN c_custkey % 13 = 0 THEN 'missing' ELSE 'name' END AS reason FROM customer WHERE c_custkey % 13 = 0 OR c_custkey % 17 = 0""")
def response_matches_query(spark, sf_dir):
    k = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(F.floor(k / 100).alias("batch"), (k % 100).alias("pos"), F.col("c_name").alias("name"), F.lit("BR").alias("country_id"))
    answers = table(spark, sf_dir, "customer").where(k % 13 != 0).select(F.floor(k / 100).alias("batch"), (k % 100).alias("pos"), F.when(k % 17 == 0, "X").otherwise(F.col("c_name")).alias("name"), F.lit("BR").alias("country_id"))
    return even(inference.mismatches(asked, answers))


@query(f"WITH {REG} SELECT curso_normalizado, periodo, nome_original, {_hmac_sql('nome_chave', TOKEN_KEY)} AS nome_chave, 0::BIGINT AS pagina, 0::BIGINT AS numero_sequencial FROM (SELECT * REPLACE ('' AS nome_original) FROM registry)")
def pseudonymize(spark, sf_dir):
    rows = privacy.pseudonymize(bridge.registry(spark, sf_dir), TOKEN_KEY)
    return even(rows.select("curso_normalizado", "periodo", "nome_original", "nome_chave", "pagina", "numero_sequencial"))


# made-up tokens are planted in one text of fifty, as none of the tables has any
@query("""WITH texts AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN coalesce(text, '') || ' ghp_' || left(sha256(doc_id::VARCHAR), 36) ELSE text END AS text FROM documents
    UNION ALL SELECT -1 - page_id, CASE WHEN page_id % 50 = 0 THEN coalesce(html, '') || ' github_pat_' || left(sha256(page_id::VARCHAR), 40) ELSE html END FROM pages)
SELECT min(doc_id) AS doc_id, rule FROM (SELECT doc_id, text, unnest(list_filter([CASE WHEN regexp_matches(text, 'gh[pousr]_[A-Za-z0-9]{20,}') THEN 'token' END, CASE WHEN regexp_matches(text, 'github_pat_[A-Za-z0-9_]{30,}') THEN 'fine_grained_token' END,
CASE WHEN regexp_matches(text, '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----') THEN 'private_key' END], lambda x: x IS NOT NULL)) AS rule FROM texts) GROUP BY text, rule""")
def secret_scan(spark, sf_dir):
    def planted(name, key, text, prefix, n):
        mark = F.concat(F.coalesce(F.col(text), F.lit("")), F.lit(prefix), F.substring(F.sha2(F.col(key).cast("string"), 256), 1, n))
        return table(spark, sf_dir, name).select(F.col(key).alias("doc_id"), F.when(F.col(key) % 50 == 0, mark).otherwise(F.col(text)).alias("text"))

    pages = planted("pages", "page_id", "html", " github_pat_", 40).withColumn("doc_id", -1 - F.col("doc_id"))
    return scan.secret_scan(planted("documents", "doc_id", "text", " ghp_", 36).union(pages))


# --- extraction ----------------------------------------------------------------------------------------------------

ROSTER = f"{REG}, roster AS (SELECT *, translate(upper(nome_original), '0123456789#', 'ABCDEFGHIJ ') AS person, concat_ws('_', tipo_registro, curso_normalizado, periodo) AS arquivo, row_number() OVER (PARTITION BY tipo_registro, curso_normalizado, periodo ORDER BY record_id) AS nth FROM registry)"


def _stored(pages: DataFrame) -> DataFrame:
    """Pages as a stored table of several files, which they are where they don't come from the bridge."""
    return cut(pages.repartition(pages.sparkSession.sparkContext.defaultParallelism))


def _extracted(spark, sf_dir, reuse: bool = False) -> extract.Extraction:
    return extract.extract(_stored(bridge.rosters(spark, sf_dir)), reuse=reuse)


@query(f"WITH {ROSTER} SELECT DISTINCT arquivo AS doc_id, tipo_registro AS kind, false AS empty FROM roster")
def detect_document_kind(spark, sf_dir):
    return extract.detect_kind(bridge.rosters(spark, sf_dir))


@query(f"WITH {ROSTER} SELECT arquivo, ((nth - 1) // 50)::BIGINT + 1 AS pagina, record_id AS numero_sequencial, tipo_registro, curso_original, curso_normalizado, ano::BIGINT AS ano, semestre::BIGINT AS semestre, periodo, person AS nome_original, 'NOTURNO' AS turno, CASE tipo_registro WHEN 'ingressante' THEN 'Vestibular' END AS tipo_ingresso FROM roster")
def parse_rosters(spark, sf_dir):
    return even(_extracted(spark, sf_dir).records.select("arquivo", "pagina", "numero_sequencial", "tipo_registro", "curso_original", "curso_normalizado", "ano", "semestre", "periodo", "nome_original", "turno", "tipo_ingresso"))


@query(f"WITH {ROSTER} SELECT arquivo AS doc_id, count(*) AS registros_brutos, count(*) AS registros_unicos, 0::BIGINT AS duplicacoes_removidas, false AS needs_ocr, CASE WHEN count(*) > count(DISTINCT person) THEN 'WARNING' ELSE 'OK' END AS status, false AS blocking FROM roster GROUP BY arquivo")
def document_audit(spark, sf_dir):
    return even(_extracted(spark, sf_dir, reuse=True).documents.select("doc_id", "registros_brutos", "registros_unicos", "duplicacoes_removidas", "needs_ocr", "status", "blocking"))


@query(f"WITH {ROSTER}, n AS (SELECT *, count(*) OVER (PARTITION BY arquivo, person) AS n FROM roster) SELECT arquivo AS doc_id, ((nth - 1) // 50)::BIGINT + 1 AS pagina, record_id AS numero_sequencial, 'homônimo' AS motivo FROM n WHERE n > 1")
def homonym_review(spark, sf_dir):
    return even(_extracted(spark, sf_dir).review.select("doc_id", "pagina", "numero_sequencial", "motivo"))


@query(f"WITH {ROSTER} SELECT arquivo AS doc_id, 'homonym' AS code, (count(*) FILTER (n > 1))::BIGINT AS n FROM (SELECT arquivo, person, count(*) AS n FROM roster GROUP BY ALL) GROUP BY arquivo HAVING n > 0")
def document_warnings(spark, sf_dir):
    return _extracted(spark, sf_dir, reuse=True).warnings.groupBy("doc_id", "code").agg(F.count("*").alias("n"))


# rosters with faults, see bridge.faulty_rosters: found(rows that become records), told(one row for each warning), audit(one row for each document)
FAULTS = f"""{ROSTER}, numbered AS (SELECT *, count(*) OVER (PARTITION BY arquivo) AS n, (nth - 1) // 50 + 1 AS page FROM roster),
titled AS (SELECT *, tipo_registro = 'concluinte' AND nth % 11 = 5 AS wrapped FROM numbered WHERE period_idx % 6 <> 5),
kept AS (SELECT *, wrapped AND ((nth - 1) % 50 IN (0, 49) OR nth = n) AS lost FROM titled),
found AS (SELECT arquivo, page, nth, person, wrapped FROM kept WHERE NOT lost UNION ALL SELECT arquivo, page, nth, person || ' X', false FROM kept WHERE nth % 11 = 2 AND period_idx % 4 = 1),
docs AS (SELECT DISTINCT arquivo, period_idx, n FROM numbered), known AS (SELECT * FROM docs WHERE period_idx % 6 <> 5),
sizes AS (SELECT arquivo, count(*) AS uniques FROM found GROUP BY 1), again AS (SELECT arquivo, count(*) AS repeats FROM kept WHERE nth % 11 = 8 GROUP BY 1),
declared AS (SELECT *, CASE period_idx % 6 WHEN 0 THEN n WHEN 1 THEN n + 1 WHEN 3 THEN n END AS total FROM known),
told AS (SELECT arquivo, 'bad_name' AS code FROM kept WHERE lost UNION ALL SELECT arquivo, 'diverging_repeat' FROM kept WHERE nth % 22 = 8 AND period_idx % 4 = 2
    UNION ALL SELECT DISTINCT arquivo, 'sequence_conflict' FROM kept WHERE nth % 11 = 2 AND period_idx % 4 = 1 UNION ALL SELECT arquivo, 'homonym' FROM found GROUP BY arquivo, person HAVING count(*) > 1
    UNION ALL SELECT arquivo, unnest(['bad_period', 'no_context']) FROM known WHERE period_idx % 7 = 3 UNION ALL SELECT arquivo, 'lone_sequence' FROM known WHERE period_idx % 7 = 4
    UNION ALL SELECT arquivo, 'no_text' FROM known WHERE period_idx % 6 = 4 UNION ALL SELECT arquivo, 'several_totals' FROM known WHERE period_idx % 6 = 2
    UNION ALL SELECT arquivo, 'unknown_kind' FROM docs WHERE period_idx % 6 = 5 UNION ALL SELECT arquivo, 'total_mismatch' FROM declared JOIN sizes USING (arquivo) WHERE total <> uniques),
warned AS (SELECT arquivo, count(*) AS n_warnings, count(*) FILTER (code <> 'homonym') AS hard, string_agg(code, ' | ' ORDER BY code) AS avisos FROM told GROUP BY 1),
audit AS (SELECT arquivo AS doc_id, coalesce(uniques, 0) + coalesce(repeats, 0) AS registros_brutos, coalesce(uniques, 0) AS registros_unicos, coalesce(repeats, 0) AS duplicacoes_removidas, total AS total_pdf,
    docs.period_idx % 6 = 4 AS needs_ocr, coalesce(n_warnings, 0) AS n_warnings, coalesce(avisos, '') AS avisos, CASE WHEN n_warnings > 0 THEN 'WARNING' ELSE 'OK' END AS status, coalesce(hard, 0) > 0 AS blocking
    FROM docs LEFT JOIN declared USING (arquivo) LEFT JOIN sizes USING (arquivo) LEFT JOIN again USING (arquivo) LEFT JOIN warned USING (arquivo))"""


def _faulty(spark, sf_dir, reuse: bool = True) -> extract.Extraction:
    return extract.extract(_stored(bridge.faulty_rosters(spark, sf_dir)), reuse=reuse)


@query(f"WITH {FAULTS} SELECT * FROM audit")
def faulty_audit(spark, sf_dir):
    return even(_faulty(spark, sf_dir).documents.drop("kind"))


@query(f"WITH {FAULTS} SELECT arquivo, page AS pagina, nth AS numero_sequencial, person AS nome_original FROM found")
def faulty_records(spark, sf_dir):
    return even(_faulty(spark, sf_dir, reuse=False).records.select("arquivo", "pagina", "numero_sequencial", "nome_original"))


@query(f"WITH {FAULTS} SELECT arquivo, page AS pagina, nth AS numero_sequencial, person AS nome_original FROM found WHERE wrapped")
def wrapped_names(spark, sf_dir):
    rows = _faulty(spark, sf_dir, reuse=False).records.where("tipo_registro = 'concluinte' AND numero_sequencial % 11 = 5")
    return even(rows.select("arquivo", "pagina", "numero_sequencial", "nome_original"))


@query(f"WITH {FAULTS} SELECT arquivo AS doc_id, code, count(*) AS n FROM told GROUP BY ALL")
def faulty_warnings(spark, sf_dir):
    return _faulty(spark, sf_dir).warnings.groupBy("doc_id", "code").agg(F.count("*").alias("n"))


@query(f"WITH {FAULTS} SELECT count(*) AS documentos, sum(registros_unicos)::BIGINT AS registros, sum(n_warnings)::BIGINT AS avisos, sum(duplicacoes_removidas)::BIGINT AS duplicacoes_internas_removidas FROM audit")
def run_totals(spark, sf_dir):
    return extract.run_totals(_faulty(spark, sf_dir).documents)


# documents without any fault, those of homonyms alone, and those that block; each outcome from the data
@query(f"""WITH {FAULTS}, part AS (SELECT *, CASE WHEN blocking THEN 'blocking' WHEN status <> 'OK' THEN 'advisory' ELSE 'clean' END AS part FROM audit)
SELECT name AS part, coalesce(bool_or(blocking), false) AS any_blocking, coalesce(bool_or(status <> 'OK'), false) AS any_warning FROM (VALUES ('all'), ('blocking'), ('advisory'), ('clean')) AS v(name) LEFT JOIN part ON name = part OR name = 'all' GROUP BY name""")
def run_gate(spark, sf_dir):
    docs = cut(_faulty(spark, sf_dir).documents)  # each part reads them
    parts = {"all": F.lit(True), "blocking": F.col("n_warnings") > F.size(F.filter(F.split("avisos", r" \| "), lambda x: x == extract.ADVISORY)), "clean": F.col("n_warnings") == 0}
    parts["advisory"] = ~parts["blocking"] & ~parts["clean"]
    return reduce(DataFrame.union, [extract.run_gate(docs.where(c)).select(F.lit(k).alias("part"), "any_blocking", "any_warning") for k, c in parts.items()])


@query(f"WITH {ROSTER} SELECT 'homônimo' AS motivo, count(*) AS quantidade FROM (SELECT count(*) OVER (PARTITION BY arquivo, person) AS n FROM roster) WHERE n > 1 HAVING count(*) > 0")
def review_summary(spark, sf_dir):
    return privacy.review_summary(_extracted(spark, sf_dir).review)


@query(f"WITH {ROSTER} SELECT tipo_registro, curso_normalizado, periodo, arquivo, count(*) AS n FROM roster GROUP BY ALL")
def document_group_counts(spark, sf_dir):
    return _extracted(spark, sf_dir).records.groupBy("tipo_registro", "curso_normalizado", "periodo", "arquivo").agg(F.count("*").alias("n"))


@query(f"WITH {ROSTER}, d AS (SELECT DISTINCT arquivo FROM roster WHERE tipo_registro = 'concluinte') SELECT arquivo AS doc_id FROM d UNION ALL SELECT 'copy ' || arquivo FROM d")
def cross_document_overlap(spark, sf_dir):
    pages = _stored(bridge.rosters(spark, sf_dir))
    copies = pages.where("doc_id LIKE 'concluinte%'").withColumn("doc_id", F.concat(F.lit("copy "), "doc_id"))
    return extract.extract(pages.union(copies)).overlaps


@query(f"WITH {ROSTER}, d AS (SELECT arquivo, min(record_id) AS first FROM roster GROUP BY arquivo) SELECT arquivo, 'documento_' || lpad((row_number() OVER (ORDER BY first))::VARCHAR, 3, '0') AS label FROM d")
def document_label(spark, sf_dir):
    return privacy.document_labels(bridge.registry(spark, sf_dir), "arquivo", "record_id")


# --- joins ---------------------------------------------------------------------------------------------------------


@query(f"WITH {REC}, m AS (SELECT DISTINCT query_name FROM records WHERE NOT known) SELECT query_name AS name, (row_number() OVER (ORDER BY query_name) - 1) // 100 AS batch, (row_number() OVER (ORDER BY query_name) - 1) % 100 AS pos FROM m")
def missing_predictions(spark, sf_dir):
    asked = bridge.registry(spark, sf_dir).select(F.upper("nome_original").alias("query_name"))
    return even(inference.missing(asked, bridge.predictions(spark, sf_dir)))


PAIRS = "pairs AS (SELECT e.record_id AS entrant_id, g.record_id AS graduate_id FROM registry e JOIN registry g ON e.tipo_registro = 'ingressante' AND g.tipo_registro = 'concluinte' AND e.curso_normalizado = g.curso_normalizado AND e.nome_chave = g.nome_chave AND g.period_idx > e.period_idx)"
MATCHES = f"""{PAIRS}, by_e AS (SELECT entrant_id, count(*) AS n, min(graduate_id) AS g FROM pairs GROUP BY 1), by_g AS (SELECT graduate_id, count(*) AS n FROM pairs GROUP BY 1),
matches AS (SELECT e.record_id AS entrant_id, CASE WHEN by_e.n = 1 AND by_g.n = 1 THEN by_e.g END AS graduate_id, CASE WHEN by_e.n = 1 AND by_g.n = 1 THEN 'exact_unique' WHEN by_e.n > 0 THEN 'ambiguous' ELSE 'not_found' END AS status,
    e.curso_normalizado, e.periodo AS periodo_ingresso, CASE WHEN by_e.n = 1 AND by_g.n = 1 THEN x.periodo END AS periodo_conclusao, CASE WHEN by_e.n = 1 AND by_g.n = 1 THEN x.period_idx - e.period_idx END AS semesters_to_graduation
    FROM registry e LEFT JOIN by_e ON e.record_id = by_e.entrant_id LEFT JOIN by_g ON by_e.g = by_g.graduate_id LEFT JOIN registry x ON x.record_id = by_e.g WHERE e.tipo_registro = 'ingressante')"""


@query(f"WITH {REG}, {MATCHES} SELECT {picked(list(cohorts.MATCH))} FROM matches")
def match_cohorts(spark, sf_dir):
    return even(cohorts.match_cohorts(bridge.registry(spark, sf_dir)))


@query(f"WITH {REG}, {PAIRS} SELECT entrant_id, string_agg(graduate_id::VARCHAR, ';' ORDER BY graduate_id) AS candidate_ids FROM pairs GROUP BY entrant_id")
def match_candidates(spark, sf_dir):
    return cohorts.candidate_lists(cohorts.candidate_pages(cohorts.candidate_index(bridge.registry(spark, sf_dir))))


# the same lists without their pairs: how many candidates an entrant has and where they begin among all graduates
@query(f"""WITH {REG}, {PAIRS}, g AS (SELECT record_id, row_number() OVER (ORDER BY curso_normalizado, nome_chave, period_idx, record_id) - 1 AS nth FROM registry WHERE tipo_registro = 'concluinte')
SELECT e.record_id AS entrant_id, min(nth)::BIGINT AS first, count(nth) AS n FROM registry e LEFT JOIN pairs ON e.record_id = entrant_id LEFT JOIN g ON g.record_id = graduate_id WHERE e.tipo_registro = 'ingressante' GROUP BY 1""")
def candidate_index(spark, sf_dir):
    return cohorts.candidate_index(bridge.registry(spark, sf_dir)).entrants


@query(f"WITH {REG} SELECT curso_normalizado, max_by(periodo, period_idx) AS latest, 0::BIGINT AS is_all FROM registry WHERE tipo_registro = 'concluinte' GROUP BY 1 UNION ALL SELECT NULL, max_by(periodo, period_idx), 1 FROM registry WHERE tipo_registro = 'concluinte'")
def latest_graduation(spark, sf_dir):
    return cohorts.latest_graduation(bridge.registry(spark, sf_dir)).withColumn("is_all", F.col("is_all").cast("long"))


COHORT = ["curso_normalizado", "periodo_ingresso", "n_ingressantes", "resolved_entrants", "expected_female_entrants", "expected_male_entrants", "n_matches_exact_unique", "resolved_matched", "expected_female_matched", "expected_male_matched",
          "latest_graduation_period", "latest_graduation_period_course", "followup_semesters", "match_proportion"]
COHORT_TAIL = """lc AS (SELECT curso_normalizado, max_by(periodo, period_idx) AS lp, max(period_idx) AS li FROM registry WHERE tipo_registro = 'concluinte' GROUP BY 1),
cohorts AS (SELECT m.curso_normalizado, periodo_ingresso, count(*) AS n_ingressantes, count(p_female) AS resolved_entrants, coalesce(sum(p_female), 0) AS expected_female_entrants, coalesce(sum(p_male), 0) AS expected_male_entrants,
    count(*) FILTER (status = 'exact_unique') AS n_matches_exact_unique, count(p_female) FILTER (status = 'exact_unique') AS resolved_matched, coalesce(sum(p_female) FILTER (status = 'exact_unique'), 0) AS expected_female_matched,
    coalesce(sum(p_male) FILTER (status = 'exact_unique'), 0) AS expected_male_matched, (SELECT max_by(lp, li) FROM lc) AS latest_graduation_period, any_value(lp) AS latest_graduation_period_course,
    greatest(0, any_value(li) - any_value(period_idx)) AS followup_semesters, (count(*) FILTER (status = 'exact_unique')) / count(*) AS match_proportion
    FROM matches m JOIN records r ON r.record_id = m.entrant_id LEFT JOIN lc ON lc.curso_normalizado = m.curso_normalizado GROUP BY 1, 2)"""
COHORT_SQL = f"{REC}, {MATCHES}, {COHORT_TAIL}"


@query(f"WITH {COHORT_SQL} SELECT {picked(COHORT)} FROM cohorts")
def summarize_cohorts(spark, sf_dir):
    rec = bridge.records(spark, sf_dir)
    return even(cohorts.summarize_cohorts(rec, cohorts.match_cohorts(rec)).select(*COHORT))


@query(f"WITH {COHORT_SQL} SELECT {picked(COHORT)} FROM cohorts WHERE followup_semesters >= 6")
def summarize_cohorts_followed(spark, sf_dir):
    rec = bridge.records(spark, sf_dir)
    return even(cohorts.summarize_cohorts(rec, cohorts.match_cohorts(rec), 6).select(*COHORT))


TIMES = ["grupo", "n", "media_semestres", "mediana_semestres", "min_semestres", "max_semestres"]
TIME_SQL = """times AS (SELECT coalesce(curso_normalizado, 'global') AS grupo, count(*) AS n, avg(semesters_to_graduation) AS media_semestres, median(semesters_to_graduation) AS mediana_semestres,
    min(semesters_to_graduation) AS min_semestres, max(semesters_to_graduation) AS max_semestres FROM matches WHERE status = 'exact_unique' GROUP BY ROLLUP (curso_normalizado))"""


@query(f"WITH {REG}, {MATCHES}, {TIME_SQL} SELECT {picked(TIMES)} FROM times")
def time_to_graduation(spark, sf_dir):
    return even(cohorts.time_to_graduation(spark, cohorts.match_cohorts(bridge.registry(spark, sf_dir))))


# --- summaries -----------------------------------------------------------------------------------------------------


@query(f"WITH {REC}, {sums_sql([])} SELECT {picked(ALL)} FROM stats")
def summarize(spark, sf_dir):
    return even(summary.summarize(bridge.records(spark, sf_dir)))


# the same from the root of the lattice: distributions made by kind, course and period, merged upward
@query(f"WITH {REC}, {sums_sql([])} SELECT {picked(ALL)} FROM stats")
def summarize_whole(spark, sf_dir):
    keys = ["tipo_registro", "curso_normalizado", "periodo"]
    sets = [(), ("tipo_registro",), ("tipo_registro", "periodo"), tuple(keys)]
    return even(summary.grouping_sets(bridge.records(spark, sf_dir), keys, sets).where("level = ''").select(*ALL))


@query(f"WITH {REC}, {sums_sql(['tipo_registro', 'curso_normalizado', 'periodo'])} SELECT {picked(['tipo_registro', 'curso_normalizado', 'periodo', *ALL])} FROM stats")
def grouped_summary(spark, sf_dir):
    return even(summary.summarize(bridge.records(spark, sf_dir), ["tipo_registro", "curso_normalizado", "periodo"]))


def _sets_sql(sets: list[tuple[str, ...]]) -> str:
    one = lambda c, s: c if c in s else f"NULL AS {c}"
    return "sets AS (" + " UNION ALL ".join(
        f"SELECT '{','.join(s)}' AS level, tipo_registro, {one('curso_normalizado', s)}, {one('ano', s)}, {one('periodo', s)}, p_female, probability, count, confidence_class FROM records" for s in sets) + ")"


SETS = [(), ("curso_normalizado",), ("ano",), ("curso_normalizado", "ano"), ("periodo",), ("curso_normalizado", "periodo")]
LEVELS = ["level", "tipo_registro", "curso_normalizado", "ano", "periodo"]


@query(f"WITH {REC}, {_sets_sql(SETS)}, {sums_sql(LEVELS, 'sets')} SELECT {picked([*LEVELS, *S4])} FROM stats")
def summary_grouping_sets(spark, sf_dir):
    return even(summary.report_sets(bridge.records(spark, sf_dir)).select(*LEVELS, *S4))


PUBLIC = list(summary.PUBLIC)
PUBLIC_SQL = f"""{REC}, {_sets_sql(SETS[2:])}, {sums_sql(LEVELS, 'sets')}, public AS (SELECT tipo_registro, coalesce(curso_normalizado, 'Todos os cursos') AS curso, CASE WHEN level LIKE '%ano' THEN 'ano' ELSE 'semestre' END AS agrupamento,
    coalesce(periodo, ano::VARCHAR) AS periodo, {', '.join(PUBLIC[4:])} FROM stats)"""


@query(f"WITH {PUBLIC_SQL} SELECT {picked(PUBLIC)} FROM public")
def public_rows(spark, sf_dir):
    return even(summary.public_rows(bridge.records(spark, sf_dir)))


@query(f"WITH {PUBLIC_SQL} SELECT {picked(PUBLIC)} FROM public")
def publish_json_csv(spark, sf_dir):
    folder = _folder(spark)
    store.publish(summary.public_rows(bridge.records(spark, sf_dir)), folder)
    return even(store.read_publication(spark, folder))


# a publication of stored records: its envelope beside what its rows add up to
@query(f"WITH {PUBLIC_SQL} SELECT 1::BIGINT AS schema_version, true AS of_snapshot, true AS in_order, count(*) AS n_rows, sum(total)::BIGINT AS total FROM public")
def publication_envelope(spark, sf_dir):
    folder = _folder(spark)
    store.write_snapshot(bridge.records(spark, sf_dir), f"{folder}/snapshot", {"MIN_GROUP_SIZE": 5})
    rows, _ = store.read_snapshot(spark, f"{folder}/snapshot")
    written = store.snapshot_time(spark, f"{folder}/snapshot")
    store.publish(summary.public_rows(rows), f"{folder}/public", written)
    envelope = store.read_envelope(spark, f"{folder}/public")
    beside = {"schema_version": envelope["schema_version"], "of_snapshot": envelope["analysis_at"] == written, "in_order": envelope["analysis_at"] <= envelope["generated_at"]}
    return even(store.read_publication(spark, f"{folder}/public").agg(*[F.lit(v).alias(k) for k, v in beside.items()], F.count("*").alias("n_rows"), F.sum("total").alias("total")))


@query("SELECT ''::VARCHAR AS tipo_registro, ''::VARCHAR AS curso, ''::VARCHAR AS agrupamento, ''::VARCHAR AS periodo, ''::VARCHAR AS rule WHERE false")
def validate_public(spark, sf_dir):
    return quality.violations(summary.public_rows(bridge.records(spark, sf_dir)))


@query(f"""WITH {PUBLIC_SQL} SELECT tipo_registro, curso, agrupamento, periodo, 'counts' AS rule FROM public WHERE agrupamento = 'ano' UNION ALL SELECT tipo_registro, curso, agrupamento, periodo, 'coverage' FROM public WHERE agrupamento = 'ano'""")
def find_violations(spark, sf_dir):
    rows = summary.public_rows(bridge.records(spark, sf_dir))
    return quality.violations(rows.withColumn("total", F.col("total") + F.when(F.col("agrupamento") == "ano", 1).otherwise(0)))


@query(f"WITH {PUBLIC_SQL} SELECT side, agrupamento, count(*) AS differences FROM public, (VALUES ('first'), ('second')) AS s(side) WHERE agrupamento = 'ano' GROUP BY ALL")
def publications_equal(spark, sf_dir):
    rows = summary.public_rows(bridge.records(spark, sf_dir)).select("tipo_registro", "curso", "agrupamento", "periodo", "total")
    changed = rows.repartition(3).withColumn("total", F.col("total") + F.when(F.col("agrupamento") == "ano", 1).otherwise(0))
    return quality.difference(rows, changed).groupBy("side", "agrupamento").agg(F.count("*").alias("differences"))


@query(f"WITH {PUBLIC_SQL} SELECT tipo_registro, sum(total)::BIGINT AS total, sum(resolvidos)::BIGINT AS resolvidos, sum(nao_identificados)::BIGINT AS nao_identificados, round(sum(expected_female), 6) + 0.0 AS expected_female, round(100 * sum(expected_female) / sum(resolvidos), 6) + 0.0 AS female_percent, round(100 * sum(resolvidos) / sum(total), 6) + 0.0 AS coverage_percent FROM public WHERE agrupamento = 'semestre' AND curso = 'Todos os cursos' AND periodo >= '1997/1' GROUP BY 1")
def dashboard_rollup(spark, sf_dir):
    rows = summary.public_rows(bridge.records(spark, sf_dir)).where((F.col("agrupamento") == "semestre") & (F.col("curso") == summary.ALL_COURSES))
    return even(summary.dashboard_rollup(charts.in_range(rows, "periodo", "1997/1"), ["tipo_registro"]))


@query(f"WITH {PUBLIC_SQL} SELECT tipo_registro, curso, periodo, total::BIGINT AS total, CASE WHEN resolvidos > 0 THEN round(expected_female, 6) + 0.0 END AS expected_female FROM public WHERE agrupamento = 'semestre' AND curso = '1 URGENT' AND periodo BETWEEN '1996/1' AND '1999/2' ORDER BY curso, periodo")
def dashboard_table(spark, sf_dir):
    rows = summary.public_rows(bridge.records(spark, sf_dir)).where((F.col("agrupamento") == "semestre") & (F.col("curso") == "1 URGENT"))
    rows = charts.in_range(rows, "periodo", "1996/1", "1999/2").withColumn("expected_female", F.when(F.col("resolvidos") > 0, F.col("expected_female")))
    return even(rows.orderBy("curso", periods.period_index(F.col("periodo"))).select("tipo_registro", "curso", "periodo", "total", "expected_female"))


@query(f"WITH {REG} SELECT DISTINCT 'course' AS dimension, curso_normalizado AS value FROM registry UNION ALL SELECT DISTINCT 'period', periodo FROM registry")
def distinct_dims(spark, sf_dir):
    reg = bridge.registry(spark, sf_dir)
    pick = lambda name, c: reg.select(F.lit(name).alias("dimension"), F.col(c).alias("value")).distinct()
    return pick("course", "curso_normalizado").union(pick("period", "periodo"))


@query(f"WITH {REC} SELECT count(*) AS records, count(p_female) AS resolvidos, count(DISTINCT concat(tipo_registro, curso_normalizado, periodo)) AS documents, round(100 * count(p_female) / count(*), 6) + 0.0 AS coverage_percent FROM records")
def coverage_and_totals(spark, sf_dir):
    rec = bridge.records(spark, sf_dir)
    return even(rec.agg(F.count("*").alias("records"), F.count("p_female").alias("resolvidos"), F.count_distinct("arquivo").alias("documents"), (100 * F.count("p_female") / F.count("*")).alias("coverage_percent")))


# --- distributions -------------------------------------------------------------------------------------------------

@query(f"WITH {REC}, {dist_sql('records', 'tipo_registro || periodo')} SELECT key, k, round(mass + 1e-10, 6) + 0.0 AS mass, round(cdf + 1e-10, 6) + 0.0 AS cdf FROM pmf")
def poisson_binomial(spark, sf_dir):
    rec = bridge.records(spark, sf_dir).withColumn("key", F.concat("tipo_registro", "periodo"))
    return even(distribution.cumulative(distribution.distributions(rec, ["key"]), ["key"]))


@query(f"WITH {REC}, {dist_sql('records', 'curso_normalizado || tipo_registro || periodo')} SELECT key, k, round(mass + 1e-10, 6) + 0.0 AS mass, round(cdf + 1e-10, 6) + 0.0 AS cdf FROM pmf")
def poisson_binomial_whole(spark, sf_dir):
    rec = bridge.records(spark, sf_dir).withColumn("key", F.concat("curso_normalizado", "tipo_registro", "periodo"))
    return even(distribution.cumulative(distribution.distributions(rec, ["key"]), ["key"]))


@query(f"WITH {REC}, {dist_sql('records', 'tipo_registro || periodo')}, q AS (SELECT key, min(k) FILTER (cdf >= 0.5) AS p50 FROM pmf GROUP BY key) SELECT key, low::BIGINT AS p2_5, p50::BIGINT AS p50, high::BIGINT AS p97_5 FROM bounds JOIN q USING (key)")
def pmf_quantile(spark, sf_dir):
    rec = bridge.records(spark, sf_dir).withColumn("key", F.concat("tipo_registro", "periodo"))
    return even(distribution.with_quantiles(distribution.distributions(rec, ["key"]), {"p2_5": 0.025, "p50": 0.5, "p97_5": 0.975}).select("key", "p2_5", "p50", "p97_5"))


@query()
def monte_carlo_difference(spark, sf_dir):
    return distribution.monte_carlo_difference(bridge.records(spark, sf_dir), "tipo_registro", "ingressante", "concluinte")


# the exact distribution of the difference: all pairs of the two windows, by the whole number n_a * B - n_b * A
DIFFERENCE = f"""{REC}, {dist_sql('records', 'tipo_registro')}, a AS (SELECT *, max(k) OVER () AS n FROM pmf WHERE key = 'ingressante'), b AS (SELECT *, max(k) OVER () AS n FROM pmf WHERE key = 'concluinte'),
pairs AS (SELECT a.n * b.k - b.n * a.k AS m, any_value(a.n * b.n) AS nn, sum(a.mass * b.mass) AS mass FROM a, b WHERE a.mass > 1e-14 AND b.mass > 1e-14 GROUP BY 1), d AS (SELECT 100.0 * m / nn AS d, sum(mass) OVER (ORDER BY m) AS cdf FROM pairs)"""


@query(f"WITH {DIFFERENCE} SELECT {', '.join(f'round(min(d) FILTER (cdf >= {a}) + 1e-10, 6) + 0.0 AS {c}' for c, a in (('p2_5', 0.025), ('p50', 0.5), ('p97_5', 0.975)))} FROM d")
def exact_difference(spark, sf_dir):
    got = distribution.exact_difference(bridge.records(spark, sf_dir), "tipo_registro", "ingressante", "concluinte", {"p2_5": 0.025, "p50": 0.5, "p97_5": 0.975})
    return got.select(*[(F.round(F.col(c) + 1e-10, 6) + 0.0).alias(c) for c in got.columns])


# a simulated quantile lies between the exact ones five standard errors of its probability below and above
NEAR = {name: [round(a + k * 5 * (a * (1 - a) / 100_000) ** 0.5, 6) for k in (-1, 1)] for name, a in (("p2_5", 0.025), ("p50", 0.5), ("p97_5", 0.975))}


@query(f"WITH {DIFFERENCE} " + " UNION ALL ".join(f"SELECT '{c}' AS quantile, round(min(d) FILTER (cdf >= {low}) + 1e-10, 6) + 0.0 AS low, round(min(d) FILTER (cdf >= {high}) + 1e-10, 6) + 0.0 AS high, true AS inside FROM d" for c, (low, high) in NEAR.items()))
def monte_carlo_bounds(spark, sf_dir):
    rec = bridge.records(spark, sf_dir)
    drawn = distribution.monte_carlo_difference(rec, "tipo_registro", "ingressante", "concluinte")
    exact = distribution.exact_difference(rec, "tipo_registro", "ingressante", "concluinte", {f"{c}_{k}": a for c, bounds in NEAR.items() for k, a in enumerate(bounds)})
    even_ = lambda c: F.round(F.col(c) + 1e-10, 6) + 0.0
    rows = [F.struct(F.lit(c).alias("quantile"), even_(f"{c}_0").alias("low"), even_(f"{c}_1").alias("high"), F.col(c).between(F.col(f"{c}_0") - 1e-9, F.col(f"{c}_1") + 1e-9).alias("inside")) for c in NEAR]
    return drawn.join(F.broadcast(exact), F.lit(True)).select(F.explode(F.array(*rows)).alias("x")).select("x.*")  # one row each


# --- windows, privacy, charts --------------------------------------------------------------------------------------

SERIES = ["tipo_registro", "periodo", *S4, "variacao_pp"]
CHANGE = "female_percent_resolved - lag(female_percent_resolved) OVER (PARTITION BY {keys} ORDER BY periodo) AS variacao_pp"


@query(f"WITH {REC}, {sums_sql(['tipo_registro', 'periodo'])}, t AS (SELECT *, {CHANGE.format(keys='tipo_registro')} FROM stats) SELECT {picked(SERIES)} FROM t")
def temporal_change(spark, sf_dir):
    return even(summary.temporal(bridge.records(spark, sf_dir)).select(*SERIES))


def protect_sql(source: str, labels: list[str], values: list[str], minimum: int) -> str:
    small, few = f"(total > 0 AND total < {minimum})", f"(resolvidos > 0 AND resolvidos < {minimum})"
    cells = ", ".join(f"CASE WHEN NOT {small}{'' if v == 'total' else f' AND NOT {few}'} THEN {v} END AS {v}" for v in values)
    return f"safe AS (SELECT {', '.join(labels)}, {cells}, CASE WHEN {small} THEN '{privacy.SMALL}' WHEN {few} THEN '{privacy.FEW_RESOLVED}' END AS privacidade FROM {source})"


@query(f"WITH {REC}, {sums_sql(['tipo_registro', 'curso_normalizado', 'periodo'])}, {protect_sql('stats', ['tipo_registro', 'curso_normalizado', 'periodo'], S4, 68)}, t AS (SELECT *, {CHANGE.format(keys='tipo_registro, curso_normalizado')} FROM safe) SELECT {picked(['tipo_registro', 'curso_normalizado', 'periodo', *S4, 'variacao_pp', 'privacidade'])} FROM t")
def temporal_change_by_course_suppressed(spark, sf_dir):
    rows = privacy.protected_series(summary.temporal(bridge.records(spark, sf_dir), by_course=True), ["tipo_registro", "curso_normalizado"], 68)
    return even(rows.select("tipo_registro", "curso_normalizado", "periodo", *S4, "variacao_pp", "privacidade"))


@query(f"WITH {REC}, {sums_sql(['tipo_registro', 'periodo'])}, {protect_sql('stats', ['tipo_registro', 'periodo'], S4, 5)}, t AS (SELECT *, {CHANGE.format(keys='tipo_registro')} FROM safe) SELECT {picked([*SERIES, 'privacidade'])} FROM t")
def temporal_change_suppressed(spark, sf_dir):
    rows = privacy.protected_series(summary.temporal(bridge.records(spark, sf_dir)), ["tipo_registro"])
    return even(rows.select(*SERIES, "privacidade"))


@query(f"WITH {REC}, {sums_sql(['tipo_registro', 'curso_normalizado', 'periodo'])}, {protect_sql('stats', ['tipo_registro', 'curso_normalizado', 'periodo'], ALL, 65)} SELECT {picked(['tipo_registro', 'curso_normalizado', 'periodo', *ALL, 'privacidade'])} FROM safe")
def protect_summaries(spark, sf_dir):
    return even(privacy.protect(summary.summarize(bridge.records(spark, sf_dir), ["tipo_registro", "curso_normalizado", "periodo"]), 65, ("tipo_registro",)))


# the rules in their order: a small cohort keeps its labels alone; else few matches hide what is said of matches; then few resolved
# entrants, and few resolved matches that are still shown, hide their expectations, and the last mark stays
SHOWN = "CASE WHEN few_matches THEN NULL ELSE {0} END AS {0}"


@query(f"""WITH {COHORT_SQL}, a AS (SELECT *, n_matches_exact_unique BETWEEN 1 AND 8 AS few_matches, resolved_entrants BETWEEN 1 AND 8 AS few_entrants FROM cohorts WHERE n_ingressantes >= 9),
b AS (SELECT curso_normalizado, periodo_ingresso, n_ingressantes, few_matches, few_entrants, resolved_entrants, expected_female_entrants, {', '.join(SHOWN.format(c) for c in ('n_matches_exact_unique', 'match_proportion', 'resolved_matched', 'expected_female_matched'))} FROM a),
c AS (SELECT *, coalesce(resolved_matched BETWEEN 1 AND 8, false) AS few_resolved FROM b)
SELECT curso_normalizado, periodo_ingresso, n_ingressantes::BIGINT AS n_ingressantes, CASE WHEN NOT few_entrants THEN resolved_entrants END::BIGINT AS resolved_entrants, round(CASE WHEN NOT few_entrants THEN expected_female_entrants END, 6) + 0.0 AS expected_female_entrants,
n_matches_exact_unique::BIGINT AS n_matches_exact_unique, CASE WHEN NOT few_resolved THEN resolved_matched END::BIGINT AS resolved_matched, round(CASE WHEN NOT few_resolved THEN expected_female_matched END, 6) + 0.0 AS expected_female_matched, round(match_proportion, 6) + 0.0 AS match_proportion,
CASE WHEN few_entrants OR few_resolved THEN '{privacy.FEW_COHORT}' WHEN few_matches THEN '{privacy.FEW_MATCHES}' END AS privacidade FROM c
UNION ALL SELECT curso_normalizado, periodo_ingresso, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '{privacy.SMALL}' FROM cohorts WHERE n_ingressantes < 9""")
def protect_cohorts(spark, sf_dir):
    rec = bridge.records(spark, sf_dir)
    rows = privacy.protect(cohorts.summarize_cohorts(rec, cohorts.match_cohorts(rec)), 9)
    return even(rows.select("curso_normalizado", "periodo_ingresso", "n_ingressantes", "resolved_entrants", "expected_female_entrants", "n_matches_exact_unique", "resolved_matched", "expected_female_matched", "match_proportion", "privacidade"))


@query(f"""WITH {REC}, {sums_sql(['tipo_registro', 'periodo'])}, a AS (SELECT * FROM stats WHERE tipo_registro = 'ingressante' AND periodo <> '1997/1'), b AS (SELECT * FROM stats WHERE tipo_registro = 'concluinte' AND periodo <> '1996/2')
SELECT periodo, round(a.female_percent_resolved, 6) + 0.0 AS female_percent_entrants, round(b.female_percent_resolved, 6) + 0.0 AS female_percent_graduates, round(b.female_percent_resolved - a.female_percent_resolved, 6) + 0.0 AS difference_pp_graduates_minus_entrants FROM a FULL JOIN b USING (periodo)""")
def compare_periods(spark, sf_dir):
    rows = summary.summarize(bridge.records(spark, sf_dir), ["tipo_registro", "periodo"])
    return even(summary.compare_periods(rows.where("tipo_registro = 'ingressante' AND periodo <> '1997/1'"), rows.where("tipo_registro = 'concluinte' AND periodo <> '1996/2'")))


CHART = ["tipo_registro", "periodo", "total", "female_percent_resolved", "lower_percent", "upper_percent", "coverage_percent"]


@query(f"""WITH {REC}, part AS (SELECT * FROM records WHERE period_idx BETWEEN 3992 AND 3999 AND NOT (tipo_registro = 'concluinte' AND periodo = '1997/2')), {sums_sql(['tipo_registro', 'periodo'], 'part')}, x AS (SELECT * FROM (SELECT DISTINCT tipo_registro FROM stats), (SELECT DISTINCT periodo FROM stats)),
s AS (SELECT *, 100 * interval95_lower_resolved / nullif(resolvidos, 0) AS lower_percent, 100 * interval95_upper_resolved / nullif(resolvidos, 0) AS upper_percent, 100 * cobertura AS coverage_percent FROM x LEFT JOIN stats USING (tipo_registro, periodo)) SELECT {picked(CHART)} FROM s""")
def series_table(spark, sf_dir):
    rec = bridge.records(spark, sf_dir).where("NOT (tipo_registro = 'concluinte' AND periodo = '1997/2')")
    return even(charts.series_table(rec, 5, "1996/1", "1999/2").select(*CHART))


@query(f"""WITH {COHORT_SQL} SELECT curso_normalizado, periodo_ingresso, round(100 * CASE WHEN n_ingressantes >= 5 AND (n_matches_exact_unique = 0 OR n_matches_exact_unique >= 5) THEN match_proportion END, 6) + 0.0 AS match_percent,
CASE WHEN n_ingressantes >= 5 THEN followup_semesters::BIGINT END AS followup_semesters FROM cohorts WHERE periodo_ingresso BETWEEN '1996/1' AND '1999/2'""")
def cohort_match_share(spark, sf_dir):
    return even(charts.cohort_match_share(bridge.records(spark, sf_dir), 5, "1996/1", "1999/2"))


@query(f"WITH {REG}, {MATCHES}, {TIME_SQL} SELECT {picked(['grupo', 'n', 'media_semestres', 'min_semestres', 'max_semestres'])} FROM times WHERE grupo <> 'global' AND n >= 5")
def course_duration(spark, sf_dir):
    return even(charts.course_duration(bridge.registry(spark, sf_dir)))


COMPOSED = ["female_percent_resolved", "male_percent_resolved", "coverage_percent"]


@query(f"WITH {REC}, part AS (SELECT * FROM records WHERE tipo_registro = 'ingressante'), {sums_sql(['ano'], 'part')}, s AS (SELECT *, 100 * cobertura AS coverage_percent FROM stats) SELECT ano::BIGINT AS ano, {picked(COMPOSED)} FROM s")
def composition_by_year(spark, sf_dir):
    return even(charts.composition(bridge.records(spark, sf_dir), "ingressante", by_year=True).select("ano", *COMPOSED))


@query(f"WITH {REC}, s AS (SELECT 100 * sum(p_female) / count(p_female) AS female_percent_resolved, 100 * (count(p_female) - sum(p_female)) / count(p_female) AS male_percent_resolved, 100 * count(p_female) / count(*) AS coverage_percent FROM records WHERE tipo_registro = 'concluinte') SELECT {picked(COMPOSED)} FROM s")
def composition_total(spark, sf_dir):
    return even(charts.composition(bridge.records(spark, sf_dir), "concluinte").select(*COMPOSED))


# names planted as courses must be found, and nothing else
@query(f"""WITH {REG} SELECT DISTINCT 'curso' AS "column", nome_original AS value FROM registry WHERE record_id % 97 = 0""")
def pii_absence_check(spark, sf_dir):
    rec = bridge.records(spark, sf_dir)
    public = summary.public_rows(rec).select("tipo_registro", "curso", "periodo")
    planted = rec.where("record_id % 97 = 0").select("tipo_registro", F.col("nome_original").alias("curso"), "periodo")
    return privacy.leaked_names(public.union(planted), rec.select("nome_original"))


@query(f"WITH {REG}, {MATCHES} SELECT 'matching ambíguo' AS motivo, count(*) AS quantidade FROM matches WHERE status = 'ambiguous'")
def report_review(spark, sf_dir):
    return report.report_tables(bridge.records(spark, sf_dir))["review"]


COHORT_FIELDS = [c for c in COHORT if c not in ("curso_normalizado", "periodo_ingresso")]


def report_sql(minimum: int, followup: int | None = None) -> str:
    """Every cell of the seven tables: report, row, metric, value, text."""
    small = lambda c: f"coalesce({c} > 0 AND {c} < {minimum}, false)"
    trio = lambda of: [f"resolved_{of}", f"expected_female_{of}", f"expected_male_{of}"]
    unless = lambda flag, columns: ", ".join(f"CASE WHEN NOT {flag} THEN {c} END AS {c}" for c in columns)

    def cells(name: str, labels: list[str], fields: list[str], words: tuple[str, ...] = ("privacidade",)) -> str:
        row = "concat_ws('|', " + ", ".join(f"coalesce({c}::VARCHAR, '-')" for c in labels) + ")"
        each = ", ".join(f"{{'metric': '{c}', 'value': NULL::DOUBLE, 'text': {c}::VARCHAR}}" if c in words else f"{{'metric': '{c}', 'value': round({c}::DOUBLE + 1e-10, 6) + 0.0, 'text': NULL::VARCHAR}}" for c in fields)
        return f"SELECT '{name}' AS report, row, x.metric, x.value, x.text FROM (SELECT {row} AS row, unnest([{each}]) AS x FROM {name})"

    periods_ = ("privacidade", "latest_graduation_period", "latest_graduation_period_course")
    kind, course = "tipo_registro", "curso_normalizado"
    shown = [*ALL, "variacao_pp", "privacidade"]
    return f"""WITH {REC}, {_sets_sql(SETS)}, {sums_sql(LEVELS, 'sets')}, {protect_sql('stats', LEVELS, ALL, minimum)}, {MATCHES}, {COHORT_TAIL}, {TIME_SQL},
temporal AS (SELECT *, {CHANGE.format(keys=kind)} FROM safe WHERE level = 'periodo'), temporal_by_course AS (SELECT *, {CHANGE.format(keys=f'{kind}, {course}')} FROM safe WHERE level = 'curso_normalizado,periodo'),
comparison AS (SELECT periodo, e.female_percent_resolved AS female_percent_entrants, g.female_percent_resolved AS female_percent_graduates, g.female_percent_resolved - e.female_percent_resolved AS difference_pp_graduates_minus_entrants
    FROM (SELECT * FROM temporal WHERE {kind} = 'ingressante') e FULL JOIN (SELECT * FROM temporal WHERE {kind} = 'concluinte') g USING (periodo)),
c1 AS (SELECT {course}, periodo_ingresso, {small('n_ingressantes')} AS few, {small('n_matches_exact_unique')} AS few_matches, {', '.join(COHORT_FIELDS)} FROM cohorts {f'WHERE followup_semesters >= {followup}' if followup is not None else ''}),
c2 AS (SELECT * REPLACE ({unless('(few OR few_matches)', privacy.MATCH_FIELDS)}, {unless('few', [c for c in COHORT_FIELDS if c not in privacy.MATCH_FIELDS])}) FROM c1),
c3 AS (SELECT *, {small('resolved_entrants')} AS few_entrants, {small('resolved_matched')} AS few_matched FROM c2),
c4 AS (SELECT * REPLACE ({unless('few_entrants', trio('entrants'))}, {unless('few_matched', trio('matched'))}), CASE WHEN few_entrants OR few_matched THEN '{privacy.FEW_COHORT}' WHEN few THEN '{privacy.SMALL}' WHEN few_matches THEN '{privacy.FEW_MATCHES}' END AS privacidade FROM c3),
d1 AS (SELECT grupo, {unless(small('n'), TIMES[1:])}, CASE WHEN {small('n')} THEN '{privacy.SMALL}' END AS privacidade FROM times),
r1 AS (SELECT 'matching ambíguo' AS motivo, count(*) AS quantidade FROM matches WHERE status = 'ambiguous' HAVING count(*) > 0)
{cells('temporal', [kind, 'periodo'], shown)} UNION ALL {cells('temporal_by_course', [kind, course, 'periodo'], shown)} UNION ALL {cells('safe', LEVELS, shown[:-2] + ['privacidade']).replace("'safe' AS report", "'summaries' AS report")}
UNION ALL {cells('comparison', ['periodo'], ['female_percent_entrants', 'female_percent_graduates', 'difference_pp_graduates_minus_entrants'])}
UNION ALL {cells('c4', [course, 'periodo_ingresso'], [*COHORT_FIELDS, 'privacidade'], periods_).replace("'c4' AS report", "'cohorts' AS report")}
UNION ALL {cells('d1', ['grupo'], [*TIMES[1:], 'privacidade']).replace("'d1' AS report", "'durations' AS report")} UNION ALL {cells('r1', ['motivo'], ['quantidade']).replace("'r1' AS report", "'review' AS report")}"""


def _cells(tables: dict) -> DataFrame:
    return report.melted(tables).withColumn("value", F.round(F.col("value") + 1e-10, 6) + 0.0)


@query(report_sql(5))
def full_report(spark, sf_dir):
    return _cells(report.report_tables(bridge.records(spark, sf_dir)))


# the report as a run: written, then read again; cohorts of three years of follow-up or more
@query(report_sql(9, 6))
def write_report_tables(spark, sf_dir):
    folder = _folder(spark)
    report.run(bridge.records(spark, sf_dir), folder, minimum=9, min_followup=6)
    return _cells(report.read(spark, folder))


# the report out of stored records: the stored floor of 7 holds against the 5 that is asked for
@query(report_sql(7))
def rebuild_from_snapshot(spark, sf_dir):
    folder = _folder(spark)
    store.write_snapshot(bridge.records(spark, sf_dir), f"{folder}/snapshot", {"MIN_GROUP_SIZE": 7})
    report.rebuild(spark, f"{folder}/snapshot", f"{folder}/report", minimum=5)
    return _cells(report.read(spark, f"{folder}/report"))
