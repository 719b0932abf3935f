"""Records out of the page texts of rosters. Lines without a safe boundary do not become records."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.periods import format_period, period_index
from rollbook.functions.text import course_alias, name_key, normalize_name, valid_name
from rollbook.sources.shared import cut

# Titles by kind, and the words and patterns that the rosters use.
TITLES = {"ingressante": "RELACAO DE ALUNOS INGRESSANTES", "concluinte": "RELACAO DE ALUNOS PARA COLACAO DE GRAU"}
PERIOD = r"(?iU)ANO/SEMESTRE\s*:\s*(\d{4})\s*/\s*([12])(?!\d)"
GRADUATE_PERIOD = r"(?iU)CONCLUINTES\s+NO\s+ANO/SEMESTRE\s*:\s*(\d{4})\s*/\s*([12])(?!\d)"
NO_COURSE = r"(?iU)RELAÇÃO|UNIVERSIDADE|UNIDADE|^\d|ANO/SEMESTRE|Página"
SHIFT = "NOTURNO|MATUTINO|VESPERTINO|INTEGRAL|DIURNO"
ENTRY = r"Vestibular|SISU|ENEM|SAS|Graduado|Transferência(?:\s+(?:Interna|Externa))?|Portador de Diploma|Reingresso|Reingresso Especial|Processo Seletivo"
TOTAL, SUBTOTAL = r"(?iU)^Total\s*:\s*(\d+)\s*$", r"(?iU)^Subtotal de matriculados\s*:\s*(\d+)\s*$"
LINE_ENDS = r"\R|[\x1c-\x1e]"
#: The one warning that does not block a document.
ADVISORY = "homonym"


#: Pages of a document that a task orders together; a longer document is as many tasks.
PAGES = 1024


def _block(pages: DataFrame) -> DataFrame:
    return pages.withColumn("block", F.floor(F.col("page_no") / PAGES).cast("long"))


def _carried(blocks: DataFrame, value: str) -> DataFrame:
    """``blocks`` (doc_id, block, ...) with ``value`` of the last block of the document before that has one."""
    return blocks.withColumn(value, F.last(value, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))


def detect_kind(pages: DataFrame) -> DataFrame:
    """doc_id, kind (null if no title or both), empty: titles are looked for in the key of the whole text.

    Keys are made page by page. Of a page only its two ends go on, as a title may run over a page break. The pages that have a key are numbered in
    blocks; each block has, besides its own, as many pages of the next one as a title has letters, so that no row holds a whole document and none of
    a title's places is lost.
    """
    reach = max(len(t) for t in TITLES.values())
    rows = _block(pages.select("doc_id", "page_no", name_key(F.coalesce("text", F.lit(""))).alias("key")))
    found = {k: F.contains("key", F.lit(t)).alias(k) for k, t in TITLES.items()}
    ends = F.when(F.length("key") > 2 * reach, F.concat(F.left("key", F.lit(reach)), F.lit("\0"), F.right("key", F.lit(reach)))).otherwise(F.col("key"))
    rows = rows.select("doc_id", "block", "page_no", *found.values(), F.when(F.col("key") != "", ends).alias("ends"))
    docs = rows.groupBy("doc_id").agg(*[F.bool_or(k).alias(k) for k in TITLES], (F.count("ends") == 0).alias("empty"))
    written = rows.where("ends IS NOT NULL")
    before = written.groupBy("doc_id", "block").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    nth = F.row_number().over(Window.partitionBy("doc_id", "block").orderBy("page_no", "ends")) - 1
    placed = written.withColumn("nth", nth).join(before, ["doc_id", "block"]).withColumn("nth", F.col("nth") + F.col("before"))
    width = max(PAGES, reach)
    own = F.floor(F.col("nth") / width)
    shared = F.when((F.col("nth") % width < reach) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))
    near = placed.select("doc_id", "nth", "ends", F.explode(shared).alias("part")).groupBy("doc_id", "part").agg(F.array_sort(F.collect_list(F.struct("nth", "ends"))).alias("near"))
    breaks = near.select("doc_id", F.array_join(F.transform("near", lambda x: x["ends"]), " ").alias("key")).groupBy("doc_id").agg(*[F.bool_or(c).alias(f"{k}_over") for k, c in found.items()])
    docs = docs.join(breaks, "doc_id", "left")
    has = {k: F.col(k) | F.coalesce(f"{k}_over", F.lit(False)) for k in TITLES}
    kind = F.when(has["ingressante"] != has["concluinte"], F.when(has["ingressante"], "ingressante").otherwise("concluinte"))
    return docs.select("doc_id", kind.alias("kind"), "empty")


def _number(text: Column, pattern: str = r"(?U)^(\d+)\s+") -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("long")


def _header(kind: Column, line: Column, before: Column) -> Column:
    """What a line that names a period says: course, year and half; without a period all are null, which resets the context."""
    of = lambda k: F.when(kind == "concluinte", F.regexp_extract(line, GRADUATE_PERIOD, k)).otherwise(F.regexp_extract(line, PERIOD, k)).try_cast("int")
    known = of(1).isNotNull()
    course = F.when(F.coalesce(before, F.lit("")) != "", F.when(~before.rlike(NO_COURSE), F.regexp_replace(before, r"(?iU)^CURSO\s*:\s*", "")))
    return F.struct(F.when(known, course).alias("course"), F.when(known, of(1)).alias("year"), F.when(known, of(2)).alias("half"))


def _names_period(line: Column) -> Column:
    return F.upper(line).contains("ANO/SEMESTRE")


def with_context(pages: DataFrame, kinds: DataFrame) -> DataFrame:
    """doc_id, kind, page_no, i (0-based among the lines that aren't blank), line, the two lines before and after, context (course, year, half) of the last
    header up to the line, header_found, header_bad; for pages of documents of a known kind.

    A header's course is the line before it on the page, unless that looks like another title line. A line that names
    a period but has none resets course and period; so does the next header. Context goes on over pages.

    A segmented scan: each page's last header, the last of each block of pages, carried over a document's blocks, then over the pages of
    a block, then over the lines of a page, which is cut at its own headers. Pages meet their document's kind and carried header by (document,
    block), so the pages of one document, however many, are dealt over tasks.
    """
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), LINE_ENDS), lambda x: F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")), lambda x: x != "")
    rows = _block(pages.select("doc_id", "page_no", lines.alias("lines")))
    blocks = rows.select("doc_id", "block").distinct().join(kinds.where("kind IS NOT NULL").select("doc_id", "kind"), "doc_id")
    # so many parts, however small they are, and pages never gathered for a broadcast: lines cost more work than bytes
    rows = rows.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "block").join(blocks.hint("merge"), ["doc_id", "block"])
    starts = F.filter(F.transform("lines", lambda x, i: F.when(_names_period(x), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("starts", starts)
    at = F.element_at("starts", -1)
    rows = rows.withColumn("last", F.when(F.size("starts") > 0, _header(F.col("kind"), F.get("lines", at), F.get("lines", at - 1))))
    ends = rows.where("last IS NOT NULL").groupBy("doc_id", "block").agg(F.max_by("last", "page_no").alias("carry"))
    carried = _carried(blocks.select("doc_id", "block").join(ends, ["doc_id", "block"], "left"), "carry").where("carry IS NOT NULL")
    reading = Window.partitionBy("doc_id", "block").orderBy("page_no", "lines").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before_page", F.last("last", ignorenulls=True).over(reading)).join(carried, ["doc_id", "block"], "left").withColumn("carry", F.coalesce("before_page", "carry"))
    cuts = F.when(F.get("starts", F.lit(0)) == 0, F.col("starts")).otherwise(F.concat(F.array(F.lit(0)), "starts"))
    rows = rows.select("doc_id", "kind", "page_no", "lines", "carry", cuts.alias("cuts")).select("*", F.posexplode("cuts").alias("nth", "first"))
    end = F.coalesce(F.get("cuts", F.col("nth") + 1), F.size("lines"))
    head = F.get("lines", F.col("first"))
    rows = rows.withColumn("context", F.when(_names_period(head), _header(F.col("kind"), head, F.get("lines", F.col("first") - 1))).otherwise(F.col("carry")))
    rows = rows.select("doc_id", "kind", "page_no", "lines", "context", "first", F.posexplode(F.slice("lines", F.col("first") + 1, end - F.col("first"))).alias("pos", "line"))
    named = _names_period(F.col("line"))
    known = F.col("context.year").isNotNull()
    i = F.col("first") + F.col("pos")
    near = lambda k: F.get("lines", i + k)
    return rows.select(
        "doc_id", "kind", "page_no", i.alias("i"), "line", near(-2).alias("before_2"), near(-1).alias("before"), near(1).alias("after"), near(2).alias("after_2"), "context",
        (named & known).alias("header_found"), (named & ~known).alias("header_bad"))


def wrapped_name() -> Column:
    """A graduate's name on the lines around its row, if the rows two lines off carry the numbers next to its own."""
    parts = [F.col("before"), F.col("after")]
    whole = (_number(F.col("before_2")) == F.col("seq") - 1) & (_number(F.col("after_2")) == F.col("seq") + 1)
    for part in parts:
        whole = whole & valid_name(part) & ~part.rlike(rf"(?iU)\b(?:{SHIFT})\b")
    return F.when(F.coalesce(whole, F.lit(False)), F.concat_ws(" ", *parts)).otherwise(F.lit(""))


def parse_rows(lines: DataFrame) -> DataFrame:
    """``with_context`` rows with seq, original, turno, tipo_ingresso and code: null for a record, else why it is none.

    Rows that are neither records nor suspicious have seq null and code null.
    """
    entrant = F.col("kind") == "ingressante"
    row = r"(?U)^(\d+)\s+(.+)$"
    rows = lines.withColumns({"seq": _number(F.col("line"), row), "payload": F.regexp_extract("line", row, 2)})
    at = lambda words, k: F.regexp_extract("payload", rf"(?iU)^(.*?)\b({words})\b", k)
    rows = rows.withColumns({"entry": F.when(entrant, at(ENTRY, 2)), "shift": at(SHIFT, 2), "head": F.rtrim(F.when(entrant, at(ENTRY, 1)).otherwise(at(SHIFT, 1)))})
    bounded = F.when(entrant, F.col("entry") != "").otherwise(F.col("shift") != "")
    rows = rows.withColumn("original", F.when((F.col("head") == "") & ~entrant, wrapped_name()).otherwise(F.col("head")))
    safe = (F.coalesce("context.course", F.lit("")) != "") & F.col("context.year").isNotNull()
    code = (
        F.when(F.col("seq").isNull(), F.when(F.col("line").rlike(r"(?U)^\d+$"), "lone_sequence")).when(~safe, "no_context").when(~bounded, "no_columns").when(~valid_name(F.col("original")), "bad_name")
    )
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return rows.withColumns({"code": code, "turno": F.upper(blank("shift")), "tipo_ingresso": blank("entry")})


IDENTITY = ["tipo_registro", "arquivo", "curso_normalizado", "periodo", "numero_sequencial", "nome_chave"]


PARSED = ("doc_id", "kind", "page_no", "i", "context", "seq", "code", "original", "turno", "tipo_ingresso", "header_found", "header_bad")


class Extraction:
    """What ``extract`` gives; each table is made when it is asked for."""

    def __init__(self, pages: DataFrame, aliases: dict[str, str], reuse: bool):
        hold = cut if reuse else lambda df: df
        self._pages, self._kinds = pages, hold(detect_kind(pages))
        parsed = parse_rows(with_context(pages, self._kinds))
        self._lines = lines = hold(parsed.select(*PARSED, _number(F.col("line"), TOTAL).alias("total"), _number(F.col("line"), SUBTOTAL).alias("subtotal")))
        course, period = F.col("context.course"), format_period(F.col("context.year"), F.col("context.half"))
        #: Records with their repetitions.
        self.raw = lines.where("seq IS NOT NULL AND code IS NULL").select(
            F.col("kind").alias("tipo_registro"), F.col("doc_id").alias("arquivo"), F.col("page_no").alias("pagina"), "i", F.col("seq").alias("numero_sequencial"), course.alias("curso_original"),
            course_alias(name_key(course), aliases).alias("curso_normalizado"), F.col("context.year").alias("ano"), F.col("context.half").alias("semestre"), period.alias("periodo"),
            period_index(period).alias("period_idx"), F.col("original").alias("nome_original"), normalize_name(F.col("original")).alias("nome_normalizado"), name_key(F.col("original")).alias("nome_chave"), "turno", "tipo_ingresso")
        same = Window.partitionBy(*IDENTITY).orderBy("pagina", "i")
        self._nth = hold(self.raw.withColumns({"nth": F.row_number().over(same), "first": F.first(F.struct("turno", "tipo_ingresso")).over(same)}))
        #: Rows in which every identity is, repetitions or not: those that are written, if any.
        self._people = (self._nth if reuse else self.raw).select(*IDENTITY)
        #: Unique records.
        self.records = self._nth.where("nth = 1").drop("nth", "first", "i")

    @cached_property
    def _homonyms(self) -> DataFrame:
        return self.records.withColumn("n", F.count("*").over(Window.partitionBy("arquivo", "curso_normalizado", "periodo", "nome_chave"))).where("n > 1")

    @cached_property
    def _blank(self) -> DataFrame:
        blank = self._pages.where(~F.coalesce(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))).select("doc_id", "page_no")
        return blank.join(self._kinds.where("kind IS NOT NULL").select("doc_id"), "doc_id")

    @cached_property
    def _counts(self) -> DataFrame:
        """A row for each document: what was counted, without status."""
        counted = self._lines.groupBy("doc_id").agg(
            *[f(c).alias(f"{name}_{c}") for c in ("total", "subtotal") for name, f in (("least", F.min), ("most", F.max))], F.count_if(F.col("seq").isNotNull() & F.col("code").isNull()).alias("registros_brutos"))
        sizes = self.records.groupBy(F.col("arquivo").alias("doc_id")).agg(F.count("*").alias("registros_unicos"))
        blank = self._blank.groupBy("doc_id").agg(F.count("*").alias("blank_pages"))
        least, most = [F.coalesce(f"{name}_total", f"{name}_subtotal") for name in ("least", "most")]
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        return self._kinds.join(counted, "doc_id", "left").join(sizes, "doc_id", "left").join(blank, "doc_id", "left").select(
            "doc_id", "kind", zero("registros_brutos").alias("registros_brutos"), zero("registros_unicos").alias("registros_unicos"), (zero("registros_brutos") - zero("registros_unicos")).alias("duplicacoes_removidas"),
            F.when(least == most, least).alias("total_pdf"), F.coalesce(least < most, F.lit(False)).alias("several"),
            F.when(F.col("kind").isNull(), F.col("empty")).otherwise(F.coalesce("blank_pages", F.lit(0)) > 0).alias("needs_ocr"))

    @cached_property
    def overlaps(self) -> DataFrame:
        """doc_id of each document that has a record which another has, too. Repetitions change nothing, so they needn't be found: by itself this takes one
        pass over the pages and one shuffle of the rows."""
        anywhere = Window.partitionBy(*[c for c in IDENTITY if c != "arquivo"])
        shared = self._people.select("arquivo", (F.min("arquivo").over(anywhere) < F.max("arquivo").over(anywhere)).alias("both")).where("both")
        return shared.select(F.col("arquivo").alias("doc_id")).distinct()

    @cached_property
    def warnings(self) -> DataFrame:
        """doc_id, page_no, line, code"""
        none = F.lit(None).cast("int")
        many = lambda **codes: F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), k) for k, c in codes.items()]))).alias("code")
        of = lambda df, code: df.select(F.col("arquivo").alias("doc_id"), none.alias("page_no"), none.alias("line"), F.lit(code).alias("code"))
        own = F.array(F.col("code"), F.when(F.col("header_bad"), "bad_period"), F.when(F.col("header_found") & F.col("context.course").isNull(), "no_course"))
        people, known = self.records.select(*IDENTITY), F.col("kind").isNotNull()
        conflicts = people.groupBy("arquivo", "curso_normalizado", "periodo", "numero_sequencial").agg(F.count_distinct("nome_chave").alias("names")).where("names > 1")
        parts = [
            self._lines.select("doc_id", F.col("page_no").cast("int").alias("page_no"), F.col("i").alias("line"), F.explode(F.array_compact(own)).alias("code")),
            self._blank.select("doc_id", F.col("page_no").cast("int").alias("page_no"), none.alias("line"), F.lit("no_text").alias("code")),
            of(self._nth.where(~F.col("first").eqNullSafe(F.struct("turno", "tipo_ingresso"))), "diverging_repeat"),
            of(conflicts.select("arquivo").distinct(), "sequence_conflict"),
            of(self._homonyms.select("arquivo", "curso_normalizado", "periodo", "nome_chave").distinct(), ADVISORY),
            of(self.overlaps.withColumnRenamed("doc_id", "arquivo"), "overlap"),
            self._counts.select("doc_id", none.alias("page_no"), none.alias("line"), many(
                unknown_kind=~known, no_records=known & (F.col("registros_unicos") == 0), several_totals=known & F.col("several"), total_mismatch=known & (F.col("total_pdf") != F.col("registros_unicos")))),
        ]
        return reduce(DataFrame.union, parts)

    @cached_property
    def review(self) -> DataFrame:
        """doc_id, pagina, numero_sequencial, motivo, nome_chave"""
        return self._homonyms.select(F.col("arquivo").alias("doc_id"), "pagina", "numero_sequencial", F.lit("homônimo").alias("motivo"), "nome_chave")

    @cached_property
    def documents(self) -> DataFrame:
        """One row per document: counts, flags, status."""
        return document_status(self._counts.drop("several"), self.warnings)


def extract(pages: DataFrame, aliases: dict[str, str] | None = None, reuse: bool = False) -> Extraction:
    """All documents of ``pages`` (doc_id, page_no from 1, text) at once.

    Blank pages ask for OCR. Repetitions of one identity are dropped after the first. Documents of unknown kind are
    not parsed. Null texts count as blank; no pages, no rows. ``reuse`` writes kinds, parsed lines and records to the checkpoint folder, for
    those who read the documents or the warnings, which are made of several parts.
    """
    return Extraction(pages, aliases or {}, reuse)


def document_status(documents: DataFrame, warnings: DataFrame) -> DataFrame:
    """Add n_warnings, avisos (codes, sorted), status OK or WARNING, and blocking: OCR, or any warning but a homonym."""
    counts = warnings.groupBy("doc_id", "code").agg(F.count("*").cast("int").alias("k"))
    spelled = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("code", "k"))), lambda x: F.array_repeat(x["code"], x["k"]))), " | ")
    own = counts.groupBy("doc_id").agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.when(F.col("code") != ADVISORY, F.col("k"))), F.lit(0)).alias("hard"), spelled.alias("avisos"))
    joined = documents.join(own, "doc_id", "left")
    n, hard = F.coalesce("n", F.lit(0)), F.coalesce("hard", F.lit(0))
    return joined.select(
        *documents.columns, n.alias("n_warnings"), F.coalesce("avisos", F.lit("")).alias("avisos"), F.when((n > 0) | F.col("needs_ocr"), "WARNING").otherwise("OK").alias("status"), (F.col("needs_ocr") | (hard > 0)).alias("blocking"))


def run_gate(documents: DataFrame) -> DataFrame:
    """One row: any_blocking, any_warning. No documents: neither."""
    return documents.agg(F.coalesce(F.bool_or("blocking"), F.lit(False)).alias("any_blocking"), F.coalesce(F.bool_or(F.col("status") != "OK"), F.lit(False)).alias("any_warning"))


def run_totals(documents: DataFrame) -> DataFrame:
    """One row on a run: documents, records, warnings, removed repetitions. No documents: zeros."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return documents.agg(
        F.count("*").alias("documentos"), total("registros_unicos").alias("registros"), total("n_warnings").alias("avisos"), total("duplicacoes_removidas").alias("duplicacoes_internas_removidas"))
