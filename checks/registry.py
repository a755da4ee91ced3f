"""All registered queries, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import ctes as sq
from checks.tables import (
    CHAIN_SQL,
    CHAIN_TEXT,
    FLOW_ROWS,
    FLOW_TEXT,
    DOC_PATH,
    JAVA_PATH,
    SCOPE_ROWS,
    SCOPE_TEXT,
    answer_lines,
    java_sources,
    label_questions,
    table,
    text_sources,
)
from fieldtrace import fixed
from fieldtrace.functions import text as tx
from fieldtrace.operators import chunking, dedup, embedding, generation, index, knn, progress
from fieldtrace.plans import (
    entries as en,
    extraction,
    ingest,
    lineage,
    questions,
    rag,
    reach,
    search,
    tokens as tk,
)
from fieldtrace.session import hold, new_path
from fieldtrace.sources import files, reports, store as st
from fieldtrace.streaming import answer_log, answers, changes, gathering, ingest as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def hash_embed(df: DataFrame, text_col: str) -> DataFrame:
    return embedding.hash_embed(df, text_col)


def _scoped(spark: SparkSession, sf: str) -> DataFrame:
    return tk.scoped(tk.dealt(java_sources(spark, sf)))


def _statements(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.pojo_statements(_scoped(spark, sf))


def _mappings(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.field_mappings(java_sources(spark, sf))


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return en.entries(_mappings(spark, sf))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")


# === sources and sinks =========================================================================


def _tree(spark: SparkSession, sf: str) -> str:
    """The texts as files in a folder per language."""
    path = new_path(spark, "tree")
    table(spark, sf, "documents").select("lang", F.col("text").alias("value")).write.partitionBy(
        "lang"
    ).option("maxRecordsPerFile", 1000).text(path)
    return path


def _lang():
    return F.regexp_extract("file_path", "/lang=([^/]+)/", 1).alias("lang")


@check(
    "source_scan",
    "select lang, cast(sum(length(text) + 1) as bigint) as n_chars from documents "
    "where lang <> 'de' group by lang",
)
def _(spark, sf):
    found = files.scan_files(
        spark, _tree(spark, sf), extensions=[".txt"], exclude=["**/lang=de/**", "**/*Test.txt"]
    )
    texts = files.read_text(found)
    return texts.groupBy(_lang()).agg(F.sum(F.length("content")).alias("n_chars"))


def _roots(spark: SparkSession, sf: str) -> list[str]:
    path = _tree(spark, sf)
    return [f" {path}/lang=de ", "", f"{path}/lang=none", f"{path}/lang=en", f"{path}/lang=es"]


@check(
    "multi_root_scan",
    "select case lang when 'de' then 1 when 'en' then 4 else 5 end as project_index, lang, "
    "cast(sum(length(text) + 1) as bigint) as n_chars from documents "
    "where lang in ('de', 'en', 'es') group by lang",
)
def _(spark, sf):
    texts = files.scan_roots(spark, _roots(spark, sf), extensions=[".txt"])
    return texts.groupBy("project_index", _lang()).agg(F.sum(F.length("content")).alias("n_chars"))


@check(
    "root_report",
    "select p as project_index, count(d.lang) > 0 as found, count(d.lang) > 0 as has_files "
    "from (values (1, 'de'), (3, 'none'), (4, 'en'), (5, 'es')) v(p, l) "
    "left join documents d on d.lang = v.l group by p",
)
def _(spark, sf):
    roots = _roots(spark, sf)
    texts = files.scan_roots(spark, roots, extensions=[".txt"])
    report = files.root_report(spark, roots, texts)
    return report.select("project_index", "found", (F.col("n_files") > 0).alias("has_files"))


@check(
    "text_read",
    "select doc_id, text || chr(10) || 'x' || chr(10) as content, "
    "case when doc_id % 2 = 0 then 'invalid UTF-8' end as error from documents",
)
def _(spark, sf):
    bad = F.when(F.col("doc_id") % 2 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    raw = table(spark, sf, "documents").select(
        "doc_id",
        F.concat(
            F.encode("text", "UTF-8"), bad, F.lit("\r\nx\r").cast("binary")
        ).alias("content"),
    )
    strict = files.read_text(raw, strict=True).select("doc_id", "error")
    return files.read_text(raw).drop("error").join(strict, "doc_id")


CODE_COLUMNS = ["id", "file_path", "file_name", "file_type", "chunk_index", "total_chunks"]


@check(
    "code_store_roundtrip",
    f"with {sq.DOC_SRC}, {sq.chunk_records()} select {', '.join(CODE_COLUMNS)}, "
    "length(document)::int as n_chars, md5(document) as document_md5 from crec "
    r"where regexp_matches(document, '[\p{L}\p{N}_]')",
)
def _(spark, sf):
    store = st.Store(spark, new_path(spark, "store"))
    ingest.ingest(store, text_sources(spark, sf), hash_embed)
    return store.code().select(
        *CODE_COLUMNS, F.length("document").alias("n_chars"), F.md5("document").alias("document_md5")
    )


@check(
    "chunk_store",
    f"with {sq.DOC_SRC}, {sq.chunk_records()}, "
    f"{sq.sparse('crec', 'id', 'document', 'w')} "
    "select w.id, c.file_path, w.b as bucket, w.n::int as n_words from w join crec c on c.id = w.id "
    "where c.chunk_index is not null",
)
def _(spark, sf):
    store = st.Store(spark, new_path(spark, "store"))
    store.add_code(chunking.code_records(text_sources(spark, sf)), hash_embed)
    chunks = store.code().where(F.col("chunk_index").isNotNull())
    return _words(chunks.select("id", "file_path", "embedding"))


def _words(df: DataFrame) -> DataFrame:
    """Vectors of counts as one row per non-zero bucket."""
    keep = [c for c in df.columns if c != "embedding"]
    return (
        df.select(*keep, F.posexplode("embedding").alias("bucket", "n"))
        .where("n > 0")
        .select(*keep, "bucket", F.col("n").cast("int").alias("n_words"))
    )


MAPPING_COLUMNS = [
    "id", "file_path", "mapping_type", "source_type", "target_type", "interface", "method",
    "document",
]


@check(
    "mapping_store",
    f"with {sq.MAPPING_RECORDS} select id, file_path, 'kept' as mapping_type, source_type, "
    "target_type, interface, method, document, 'r1' as release from mrec",
)
def _(spark, sf):
    store = st.Store(spark, new_path(spark, "store"))
    extra = F.create_map(F.lit("release"), F.lit("r1"), F.lit("mapping_type"), F.lit("kept"))
    store.add_mappings(st.mapping_records(_entries(spark, sf), extra=extra), hash_embed)
    return store.mappings().select(*MAPPING_COLUMNS, F.col("extra")["release"].alias("release"))


@check(
    "mapping_store_batch",
    f"with {sq.MAPPING_RECORDS}, twice as (select * from mrec union all select * from mrec), "
    "n as (select *, row_number() over (partition by id) - 1 as i from twice) "
    "select case when i = 0 then id else id || '_' || i end as id, "
    f"{', '.join(MAPPING_COLUMNS[1:])} from n",
)
def _(spark, sf):
    store = st.Store(spark, new_path(spark, "store"))
    entries = hold(_entries(spark, sf))
    again = entries.withColumn("pos", F.col("pos") + 100000)
    batch = st.batch_records(entries.unionByName(again))
    store.add_mappings(batch, hash_embed)
    store.add_mappings(batch, hash_embed)
    return store.mappings().select(*MAPPING_COLUMNS)


@check(
    "list_limit",
    f"with {sq.DOC_SRC}, {sq.chunk_records()} select id, file_path from crec order by id limit 10",
)
def _(spark, sf):
    records = chunking.code_records(text_sources(spark, sf))
    return st.listing(records.select("id", "file_path"), 10)


@check(
    "store_reset",
    "select 0::bigint as total_code_files, 0::bigint as total_code_chunks, "
    "0::bigint as total_mappings from (select count(*) from documents)",
)
def _(spark, sf):
    store = st.Store(spark, new_path(spark, "store"))
    ingest.ingest(store, text_sources(spark, sf), hash_embed)
    store.reset()
    return progress.store_stats(store.code(), store.mappings())


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """Ingest log of documents of which those with U+0041 as first letter could not be read."""
    sources = text_sources(spark, sf).withColumn(
        "error", F.when(F.col("content").startswith("A"), "invalid UTF-8")
    )
    stored = chunking.code_records(sources.where("error is null"))
    return ingest.ingest_log(sources, stored)


_LOG_SQL = (
    f"with {sq.DOC_SRC}, log as (select file_path as file, content not like 'A%' as code_stored "
    "from src)"
)


@check(
    "report_json",
    _LOG_SQL + """ select file, case when code_stored
      then '{"file":"' || file || '","status":"stored","summary":{"code_stored":true}}'
      else '{"error":"invalid UTF-8","file":"' || file || '"}' end as json from log
    union all select 'totals', '{"files_processed":' || count(*) || ',"files_stored":'
      || count_if(code_stored) || ',"summary":{"code_files_stored":' || count_if(code_stored)
      || '}}' from log""",
)
def _(spark, sf):
    log = _log(spark, sf)
    totals = reports.totals_json(log).withColumn("file", F.lit("totals"))
    return reports.result_json(log).unionByName(totals)


_REPORT_SQL = f"""with {sq.ENTRIES},
num as (select *, row_number() over (partition by file_path order by pos) as i from ent),
body as (
  select file_path, string_agg({sq.lines(
      "'Mapping ' || i || ': ' || upper(type)", "'  Source Type: ' || source_type",
      "'  Target Type: ' || target_type", "'  Interface: ' || nullif(interface, '')",
      "'  Method: ' || nullif(method, '')",
      "case when len(fields) > 0 then '  Field Mappings:' || chr(10) || "
      + sq.field_lines("    ", "      ", flags=True) + " end",
      "case when len(fields) = 0 and implicit then '  Implicit mapping (field names match)' end",
      "''")}, chr(10) order by i) as body,
    count(*) as n, count_if(type = 'mapstruct') as m, count_if(type = 'pojo') as p
  from num group by file_path)
select s.file_path, {sq.lines("'File: ' || s.file_path", "'Total Mappings: ' || coalesce(n, 0)",
  "'  - MapStruct: ' || coalesce(m, 0)", "'  - POJO: ' || coalesce(p, 0)", "''", "body")} as report
from src s left join body b on b.file_path = s.file_path"""


@check("report_text", _REPORT_SQL)
def _(spark, sf):
    return en.text_report(java_sources(spark, sf), _entries(spark, sf))


# === projections and filters ===================================================================


@check(
    "path_exclude",
    "select page_id, url from pages where not (url like '%/en/%' or url like '%.html' "
    "or url like '%spam-farm%' or regexp_matches(url, '^https?://blog\\.[^/]*\\.net/.*$'))",
)
def _(spark, sf):
    globs = ["**/en/**", "**/*.html", "spam-farm", "http*://blog.*.net/**"]
    return table(spark, sf, "pages").select("page_id", "url").where(~tx.excluded("url", globs))


@check("ext_filter", "select page_id, url from pages where url like '%.html' or url like '%.net'")
def _(spark, sf):
    return files.with_extension(
        table(spark, sf, "pages").select("page_id", "url"), "url", [".html", ".net"]
    )


@check(
    "blank_filter",
    "select doc_id from documents where regexp_matches(text, '\\S') and regexp_matches("
    "regexp_replace(text, '[a-zA-Z]', '', 'g'), '\\S')",
)
def _(spark, sf):
    letters = F.regexp_replace("text", "[a-zA-Z]", "")
    return (
        table(spark, sf, "documents")
        .where(tx.not_blank("text") & tx.not_blank(letters))
        .select("doc_id")
    )


@check(
    "embed_ok",
    "select doc_id, lang from documents where regexp_matches(text, '[\\p{L}\\p{N}_]')",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return embedding.embedded_only(hash_embed(docs, "text")).select("doc_id", "lang")


@check(
    "ann_require_target",
    f"with {sq.ANNOTATIONS} select file_path, pos, target from ann where target is not null",
)
def _(spark, sf):
    found = lineage.annotations(_scoped(spark, sf))
    return found.where(F.col("target").isNotNull()).select("file_path", "pos", "target")


@check(
    "mapping_keep",
    f"with {sq.FM} select file_path, pos, source_field, target_field, implicit from fm "
    "where (source_field <> '' and target_field <> '') or implicit",
)
def _(spark, sf):
    return en.complete(_mappings(spark, sf)).select(
        "file_path", "pos", "source_field", "target_field", "implicit"
    )


@check(
    "pojo_nonempty",
    f"with {sq.FM} select distinct s.file_path, s.method, s.method_pos from st s "
    "where s.kind = 'body' and exists (select 1 from fm f where f.type = 'pojo' "
    "and f.file_path = s.file_path and f.method_pos = s.method_pos)",
)
def _(spark, sf):
    statements = _statements(spark, sf)
    found = lineage.pojo_field_mappings(statements)
    methods = lineage.pojo_methods(statements).select("file_path", "method", "method_pos")
    return methods.join(found, ["file_path", "method_pos"], "left_semi")


@check(
    "path_parts",
    "select page_id, regexp_extract(url, '[^/]*$') as name, "
    "regexp_extract(regexp_extract(url, '[^/]*$'), '[^.](\\.[^.]+)$', 1) as suffix from pages",
)
def _(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", tx.basename("url").alias("name"), tx.suffix("url").alias("suffix")
    )


@check(
    "preview",
    "select doc_id, left(text, 200) as p200, left(text, 500) as p500, left(text, 1000) as p1000 "
    "from documents",
)
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", *[tx.preview("text", n).alias(f"p{n}") for n in (200, 500, 1000)]
    )


@check(
    "embed_truncate",
    "select doc_id, case when length(text) > 2000 then left(text, 2000) || chr(10) || "
    "'[... truncated for embedding ...]' else text end as prompt from documents",
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.embed_input("text").alias("prompt"))


@check(
    "embed_retry_truncate",
    "select doc_id, case when length(text) > 1000 then left(text, 1000) || chr(10) || "
    "'[... truncated ...]' else text end as prompt from documents",
)
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", tx.embed_retry_input("text").alias("prompt")
    )


@check(
    "normalise_fields",
    f"with {sq.FM} select file_path, pos, target_path, coalesce(nullif(case when type = 'pojo' then source_field end, ''), source_field, '') as source_field, "
    "coalesce(target_field, '') as target_field from fm",
)
def _(spark, sf):
    pojo = F.col("type") == "pojo"
    mixed = _mappings(spark, sf).select(
        "file_path",
        "pos",
        "target_path",
        F.when(pojo, F.col("source_field")).otherwise("").alias("source_field"),
        F.when(pojo, F.col("target_field")).alias("target_field"),
        F.when(~pojo, F.col("source_field")).alias("source"),
        F.when(~pojo, F.col("target_field")).alias("target"),
    )
    return en.normalised_fields(mixed).drop("source", "target")


# === chunks ====================================================================================


@check(
    "chunk_fixed",
    "select doc_id, i::int as chunk_index, total::int as total_chunks, "
    "substr(text, i * 2000 + 1, 2000) as document from (select doc_id, text, "
    "ceil(length(text) / 2000.0)::bigint as total, "
    "unnest(range(0, ceil(length(text) / 2000.0)::bigint)) as i from documents)",
)
def _(spark, sf):
    return chunking.chunk_texts(table(spark, sf, "documents").select("doc_id", "text"), "text")


@check(
    "chunk_or_whole",
    f"with {sq.DOC_SRC}, {sq.chunk_records()} select * from crec",
)
def _(spark, sf):
    return chunking.code_records(text_sources(spark, sf))


@check("chunks_rejoined", f"with {sq.DOC_SRC} select file_path, content from src where content <> ''")
def _(spark, sf):
    return chunking.join_chunks(chunking.code_records(text_sources(spark, sf), size=700))


@check(
    "chunk_vector_join",
    f"with {sq.DOC_SRC}, {sq.chunk_records()} select file_path, chunk_index, document, "
    "chunk_index + 0.5::float as v from crec where chunk_index % 3 <> 1",
)
def _(spark, sf):
    records = chunking.code_records(text_sources(spark, sf)).where("chunk_index is not null")
    index = F.col("chunk_index")
    # Vectors of two in three chunks, and of one chunk past the end of each file.
    vectors = records.where(index % 3 != 1).select("file_path", "chunk_index").unionByName(
        records.groupBy("file_path").agg(F.max("total_chunks").alias("chunk_index"))
    )
    vectors = vectors.withColumn("embedding", F.array((index + 0.5).cast("float")))
    return chunking.attach_vectors(records, vectors).select(
        "file_path", "chunk_index", "document", F.col("embedding")[0].alias("v")
    )


# === model calls ===============================================================================


def _stub_embed():
    """A batch function that fails for texts without the letter e."""
    return lambda texts: [[float(len(t)), 1.0] if "e" in t else None for t in texts]


@check(
    "embed_documents",
    "select doc_id, case when text like '%e%' then length(text)::float end as n from documents",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = embedding.embed_with(docs, _stub_embed, "text", wait=0.0)
    return out.select("doc_id", F.get("embedding", F.lit(0)).alias("n"))


def _faulty(one):
    """A batch function that raises if any of its items is bad: those whose length is a multiple of 7."""

    def call(items):
        if any(len(_text(item)) % 7 == 0 for item in items):
            raise RuntimeError("bad item")
        return [one(_text(item)) for item in items]

    return lambda: call


def _text(item) -> str:
    return item if isinstance(item, str) else item[0]


@check(
    "embed_faults",
    "select doc_id, case when length(text) % 7 <> 0 then length(text)::float "
    "when length(text) > 1000 and 1020 % 7 <> 0 then 1020::float end as n from documents",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = embedding.embed_with(docs, _faulty(lambda t: [float(len(t))]), "text", wait=0.0)
    return out.select("doc_id", F.get("embedding", F.lit(0)).alias("n"))


@check(
    "generate_faults",
    "select doc_id, case when length(text) % 7 <> 0 then length(text) || ' characters' end as answer, "
    "case when length(text) % 7 = 0 then 'RuntimeError: bad item' end as error from documents",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    call = _faulty(lambda t: f"{len(t)} characters")
    return generation.generate(docs, call, error_col="error", wait=0.0).drop("prompt")


@check(
    "hash_embed",
    f"with {sq.sparse('documents', 'doc_id', 'text', 'w')} "
    "select doc_id, b as bucket, n::int as n_words from w",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return _words(hash_embed(docs, "text").drop("text"))


_CONTEXT_SQL = (
    "'Mapping from ' || source_type || ' to ' || target_type || case when len(fields) > 0 "
    "then ' with ' || len(fields) || ' field mappings' else '' end"
)


@check(
    "mapping_context",
    f"with {sq.ENTRIES} select file_path, pos, {_CONTEXT_SQL} as embedding_context, "
    "true as has_embedding from ent",
)
def _(spark, sf):
    return embedding.embed_mappings(_entries(spark, sf), hash_embed).select(
        "file_path", "pos", "embedding_context", "has_embedding"
    )


def _stub_generate():
    """A batch function that answers with the length of the prompt, and not at all to some."""
    return lambda pairs: [None if len(p) % 5 == 0 else f"{len(p)} characters" for p, _ in pairs]


@check(
    "generate_batch",
    "select doc_id, case when length(text) % 5 <> 0 then length(text) || ' characters' end as answer "
    "from documents",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    return generation.generate(docs, _stub_generate).drop("prompt")


@check(
    "describe_prompt",
    f"""with {sq.ENTRIES} select e.file_path, e.pos, '{fixed.DESCRIBE_HEAD}' || s.content
      || '{fixed.DESCRIBE_MIDDLE}' || to_json({{'type': type, 'source_type': source_type,
      'target_type': target_type, 'field_mappings': fields}})::varchar || '{fixed.DESCRIBE_TAIL}'
      as prompt from ent e join src s on s.file_path = e.file_path""",
)
def _(spark, sf):
    mapping = F.struct("type", "source_type", "target_type", "field_mappings")
    return (
        _entries(spark, sf)
        .join(java_sources(spark, sf), "file_path")
        .select("file_path", "pos", generation.describe_prompt("content", mapping).alias("prompt"))
    )


@check(
    "extraction_prompt",
    f"with {sq.SRC} select file_path, '{fixed.EXTRACT_HEAD}' || content || "
    f"'{fixed.EXTRACT_TAIL}' as prompt from src",
)
def _(spark, sf):
    return java_sources(spark, sf).select(
        "file_path", generation.extraction_prompt("content").alias("prompt")
    )


@check(
    "json_or_fallback",
    "select event_id, case when event_id % 3 = 1 then -1 else (props->>'k')::bigint end as k, "
    "case when event_id % 3 = 2 then 2 else 1 end as n_items from events",
)
def _(spark, sf):
    broken = F.regexp_replace("props", "}$", "")
    many = F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]"))
    kind = F.col("event_id") % 3
    answer = F.when(kind == 1, broken).when(kind == 2, many).otherwise(F.col("props"))
    fallback = F.array(F.struct(F.lit(-1).cast("bigint").alias("k")))
    parsed = generation.parse_or_fallback(answer, "array<struct<k:bigint>>", fallback)
    return (
        table(spark, sf, "events")
        .select("event_id", parsed.alias("items"))
        .select("event_id", F.col("items")[0]["k"].alias("k"), F.size("items").alias("n_items"))
    )


@check(
    "model_mappings",
    "select event_id, case event_id % 4 when 0 then 1 when 1 then 2 when 2 then 1 else 1 end "
    "as total_mappings, case event_id % 4 when 0 then 1 when 1 then 1 else 0 end "
    "as mapstruct_mappings, case event_id % 4 when 0 then 0 when 1 then 1 when 2 then 1 "
    "else 0 end as pojo_mappings from events",
)
def _(spark, sf):
    def one(kind: str):
        return F.to_json(F.struct(F.lit(kind).alias("mapping_type"), F.col("event_type").alias("source_type")))

    pair = F.concat(F.lit("["), one("mapstruct"), F.lit(", "), one("pojo"), F.lit("]"))
    kind = F.col("event_id") % 4
    answer = (
        F.when(kind == 0, one("mapstruct")).when(kind == 1, pair).when(kind == 2, one("pojo"))
        .otherwise("no JSON here")
    )
    rule = F.from_json(F.lit('[{"mapping_type": "rule"}]'), generation.MODEL_MAPPINGS)
    events = table(spark, sf, "events").select("event_id", answer.alias("answer"))
    return generation.model_mappings(events, "answer", rule).drop("answer", "mappings")


# === joins, dedup, deletes =====================================================================


@check(
    "insert_if_absent",
    "select md5(text) as id, min(doc_id) as doc_id from documents group by md5(text) "
    "having max(case when lang = 'en' then 1 else 0 end) = 0",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.md5("text").alias("id"), "doc_id", "lang")
    new = docs.groupBy("id").agg(F.min("doc_id").alias("doc_id"))
    return dedup.insert_if_absent(new, docs.where("lang = 'en'"))


@check(
    "dup_suffix",
    "select doc_id, id || case when n = 0 then '' else '_' || n end as id from (select doc_id, "
    "md5(text) as id, row_number() over (partition by md5(text) order by doc_id) - 1 as n "
    "from documents)",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("id"))
    return dedup.unique_ids(docs, order="doc_id", slice_rows=64)


@check(
    "union_branches",
    "select 'document' as kind, doc_id as id, null::varchar as url, lang from documents "
    "union all select 'page', page_id, url, null from pages",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "lang"
    )
    pages = table(spark, sf, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), "url"
    )
    return dedup.union_all([docs, pages])


@check(
    "delete_by_id",
    f"with {sq.DOC_SRC}, {sq.chunk_records()} select id, file_path from crec "
    r"where regexp_matches(document, '[\p{L}\p{N}_]') and chunk_index is null",
)
def _(spark, sf):
    store = st.Store(spark, new_path(spark, "store"))
    ingest.ingest(store, text_sources(spark, sf), hash_embed)
    store.delete_ids(st.CODE, store.code().where("chunk_index is not null"))
    return store.code().select("id", "file_path")


@check(
    "delete_by_file",
    f"with {sq.DOC_SRC}, {sq.chunk_records()} select id, file_path, "
    "case when file_path like '%/src2/%' then 2 else 1 end::bigint as batch_id from crec "
    r"where regexp_matches(document, '[\p{L}\p{N}_]') and file_path not like '%/src1/%'",
)
def _(spark, sf):
    store = st.Store(spark, new_path(spark, "store"))
    sources = text_sources(spark, sf)
    ingest.ingest(store, sources, hash_embed)
    paths = sources.select("file_path").where(F.col("file_path").rlike("/src[12]/"))
    store.delete_files(st.CODE, paths)
    # Files that come again are live again.
    ingest.ingest(store, sources.where(F.col("file_path").contains("/src2/")), hash_embed)
    return store.code().select("id", "file_path", "batch_id")


@check(
    "replace_files",
    f"with {sq.DOC_SRC}, new as (select file_path, content || ' changed' as content from src "
    f"where file_path like '%/en/%'), {sq.chunk_records('src', 'old_rec')}, "
    f"{sq.chunk_records('new', 'new_rec')} "
    "select id, file_path, md5(document) as document_md5, 1::bigint as batch_id from old_rec "
    r"where file_path not like '%/en/%' and regexp_matches(document, '[\p{L}\p{N}_]') "
    "union all select id, file_path, md5(document), 2 from new_rec "
    r"where regexp_matches(document, '[\p{L}\p{N}_]')",
)
def _(spark, sf):
    store = st.Store(spark, new_path(spark, "store"))
    sources = text_sources(spark, sf)
    ingest.ingest(store, sources, hash_embed)
    changed = sources.where(F.col("file_path").contains("/en/")).withColumn(
        "content", F.concat("content", F.lit(" changed"))
    )
    ingest.ingest(store, changed, hash_embed, mode="replace")
    return store.code().select("id", "file_path", F.md5("document").alias("document_md5"), "batch_id")


NEST_COLUMNS = ["file_path", "method", "source_field", "target_field", "target_path", "value", "pos"]


@check("nested_lineage", f"with {sq.NESTED} select {', '.join(NEST_COLUMNS)} from nest")
def _(spark, sf):
    return lineage.nested_assignments(_statements(spark, sf)).select(*NEST_COLUMNS)


@check(
    "mapping_dedup",
    f"with {sq.FM} select file_path, method, source_field, target_field, target_path, type, "
    "min(pos) as pos from fm group by all",
)
def _(spark, sf):
    # Every mapping twice, the second time further on; a union would extract them twice.
    pos = F.col("pos")
    twice = _mappings(spark, sf).withColumn("pos", F.explode(F.array(pos, pos + 1000)))
    return dedup.distinct_mappings(twice).select(
        "file_path", "method", "source_field", "target_field", "target_path", "type", "pos"
    )


# === neighbours ================================================================================

HIT = "query_id, id, distance, rank"


def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", "distance", "rank")


@check(
    "knn_single",
    f"with {sq.VECTORS}, one as (select 0::int as query_id, list(x order by p) as v from (select p, "
    "avg(x) as x from (select unnest(v) as x, generate_subscripts(v, 1) as p from vec) group by p)), "
    f"{sq.dense_nearest('vec', 'one', 'hit', 5)} select {HIT} from hit",
)
def _(spark, sf):
    rows = _vectors(spark, sf)
    means = (
        rows.select(F.posexplode("embedding").alias("p", "x"))
        .groupBy("p")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    one = means.agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("all")).select(
        F.lit(0).alias("query_id"), F.transform("all", lambda p: p["x"]).alias("embedding")
    )
    return _hits(knn.nearest(rows, one, 5))


@check(
    "knn_batch",
    f"with {sq.VECTORS}, {sq.dense_nearest('vec', 'cen', 'hit', 5)} select {HIT} from hit",
)
def _(spark, sf):
    return _hits(knn.nearest(_vectors(spark, sf), label_questions(spark, sf), 5))


@check(
    "knn_l2sq",
    f"with {sq.VECTORS} select {HIT} from (select *, row_number() over (partition by query_id "
    "order by distance, id)::int as rank from (select c.query_id, r.vec_id as id, "
    "round(list_sum(list_transform(range(1, len(c.v) + 1), lambda i: "
    "(c.v[i] - r.v[i]) * (c.v[i] - r.v[i]))), 6) as distance from cen c, vec r)) where rank <= 5",
)
def _(spark, sf):
    return _hits(knn.nearest(_vectors(spark, sf), label_questions(spark, sf), 5, metric="l2sq"))


@check(
    "knn_filtered",
    f"with {sq.VECTORS}, few as (select * from vec where label = 3), "
    f"{sq.dense_nearest('few', 'cen', 'hit', 5)} select {HIT} from hit",
)
def _(spark, sf):
    hits = knn.nearest(_vectors(spark, sf), label_questions(spark, sf), 5, where={"label": 3})
    return _hits(hits)


@check(
    "knn_grid",
    f"with {sq.VECTORS}, {sq.dense_nearest('vec', 'cen', 'hit', 20)} select {HIT} from hit",
)
def _(spark, sf):
    rows = _vectors(spark, sf).select("id", "embedding")
    return _hits(knn.grid_join(rows, label_questions(spark, sf), 20, slice_rows=128))


@check(
    "similarity",
    f"with {sq.VECTORS}, {sq.dense_nearest('vec', 'cen', 'hit', 5)} "
    "select query_id, id, round(1 - distance, 6) as similarity from hit",
)
def _(spark, sf):
    hits = knn.nearest(_vectors(spark, sf), label_questions(spark, sf), 5)
    return hits.select("query_id", "id", F.round(knn.similarity(), 6).alias("similarity"))


_BENCH = "bench as (select item_id as query_id, text from benchmark)"
_CODE_VECTORS = (
    f"{sq.chunk_records()}, {_BENCH}, {sq.sparse('crec', 'id', 'document', 'cw')}, "
    f"{sq.sparse('bench', 'query_id', 'text', 'qw')}"
)


def _bench_questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )


def _bench_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _bench_questions(spark, sf).withColumnRenamed("question", "text")


def _text_vectors(spark: SparkSession, sf: str) -> DataFrame:
    records = chunking.code_records(text_sources(spark, sf))
    return hash_embed(records.select("id", "document"), "document").select("id", "embedding")


@check(
    "knn_text",
    f"with {sq.DOC_SRC}, {_CODE_VECTORS}, "
    f"{sq.sparse_nearest('cw', 'id', 'qw', 'query_id', 'hit', 5)} select {HIT} from hit",
)
def _(spark, sf):
    records = hash_embed(chunking.code_records(text_sources(spark, sf)), "document")
    return _hits(search.search(records, _bench_texts(spark, sf), hash_embed, 5))


@check(
    "knn_code",
    f"with {sq.DOC_SRC}, {_CODE_VECTORS}, "
    f"{sq.sparse_nearest('cw', 'id', 'qw', 'query_id', 'hit', 10)} "
    "select h.query_id, h.id, h.rank, c.file_path, c.chunk_index, "
    "left(c.document, 200) as preview from hit h join crec c on c.id = h.id",
)
def _(spark, sf):
    records = hash_embed(chunking.code_records(text_sources(spark, sf)), "document")
    found = search.search(records, _bench_texts(spark, sf), hash_embed, 10)
    return found.select("query_id", "id", "rank", "file_path", "chunk_index", "preview")


def _index(spark: SparkSession, sf: str, parts: int = 2) -> index.Index:
    """An index over all rows, put in by several appends."""
    rows = _vectors(spark, sf)
    made = index.train(rows, new_path(spark, "index"))
    for part in range(parts):
        made.add(rows.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part))
    return made


_EVERY_50TH = "asked as (select vec_id as query_id, v from vec where vec_id % 50 = 0)"


@check(
    "knn_index",
    f"with {sq.VECTORS}, {_EVERY_50TH}, {sq.dense_nearest('vec', 'asked', 'hit', 10)} select {HIT} from hit",
)
def _(spark, sf):
    asked = _vectors(spark, sf).where("id % 50 = 0").withColumnRenamed("id", "query_id")
    return _hits(_index(spark, sf).search(asked, 10))


@check(
    "knn_recall",
    f"with {sq.VECTORS}, {_EVERY_50TH}, {sq.dense_nearest('vec', 'asked', 'hit', 10)} "
    "select count(*) as n_exact, true as recall_reached, true as few_vectors_read from hit",
)
def _(spark, sf):
    """How many exact neighbours every fiftieth row has; whether the index finds nine in ten of them, and
    reads less than half of the vectors for it."""
    rows = _vectors(spark, sf)
    asked = rows.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    made = _index(spark, sf)
    found = knn.recall(made.search(asked, 10), knn.nearest(rows, asked, 10))
    slices = [wanted.select("q") for _, wanted in made.candidates(asked, 10)]
    read = dedup.union_all(slices).agg(F.count("*").alias("n_read"))
    pairs = rows.agg((F.count("*") * F.count_if(F.col("id") % 50 == 0)).alias("n_pairs"))
    return (
        found.join(read, F.lit(True)).join(pairs, F.lit(True))
        .select("n_exact", (F.col("recall") >= 0.9).alias("recall_reached"), (F.col("n_read") * 2 < F.col("n_pairs")).alias("few_vectors_read"))
    )


@check(
    "dual_retrieval",
    f"with {sq.VECTORS}, low as (select * from vec where label < 5), "
    "high as (select * from vec where label >= 5), "
    f"{sq.dense_nearest('low', 'cen', 'a', 5)}, {sq.dense_nearest('high', 'cen', 'b', 5)} "
    f"select {HIT}, 'mapping' as kind from a union all select {HIT}, 'code' from b",
)
def _(spark, sf):
    rows = _vectors(spark, sf)
    hits = knn.dual_nearest(
        rows.where("label < 5"), rows.where("label >= 5"), label_questions(spark, sf), 5
    )
    return hits.select("query_id", "id", "distance", "rank", "kind")


LSH_BITS = 5
_LSH_SQL = f"""with {sq.VECTORS},
planes as (select p, list_transform(range(0, 64), lambda j:
    case when bit_count(p & j) % 2 = 0 then 1.0 else -1.0 end)::double[] as w
  from range(1, {LSH_BITS + 1}) t(p)),
cell as (
  select vec_id, v, sum(case when round(list_dot_product(v, w), 6) > 0
                             then 1 << (p - 1) else 0 end)::int as c
  from vec, planes group by all),
pairs as (
  select q.vec_id as query_id, r.vec_id as id,
    {sq.COSINE.format(a="q.v", b="r.v")} as distance
  from cell q join cell r on bit_count(xor(q.c, r.c)) <= 1),
hit as (select *, row_number() over (partition by query_id order by distance, id)::int as rank
        from pairs)
select {HIT} from hit where rank <= 5"""


@check("knn_lsh", _LSH_SQL)
def _(spark, sf):
    rows = _vectors(spark, sf)
    asked = rows.withColumnRenamed("id", "query_id")
    return _hits(knn.nearest_approx(rows, asked, 5, bits=LSH_BITS, slice_rows=256))


# === aggregations and progress =================================================================


@check(
    "store_stats",
    f"with {sq.MAPPING_RECORDS}, {sq.chunk_records()} select "
    "(select count(distinct file_path) from crec) as total_code_files, (select count(*) from crec "
    r"where regexp_matches(document, '[\p{L}\p{N}_]')) as total_code_chunks, "
    "(select count(*) from mrec) as total_mappings",
)
def _(spark, sf):
    store = st.Store(spark, new_path(spark, "store"))
    ingest.ingest(store, java_sources(spark, sf), hash_embed, with_mappings=True)
    return progress.store_stats(store.code(), store.mappings())


@check(
    "mapping_types",
    f"with {sq.ENTRIES} select type as mapping_type, count(*) as n_mappings from ent "
    "group by rollup (type)",
)
def _(spark, sf):
    entries = _entries(spark, sf).withColumnRenamed("type", "mapping_type")
    return progress.mapping_types(entries)


@check(
    "ingest_totals",
    _LOG_SQL + " select count(*) as files_processed, count_if(code_stored)::bigint as files_stored from log",
)
def _(spark, sf):
    return progress.ingest_totals(_log(spark, sf))


_SUMMARY_SQL = f"""with {sq.ENTRIES}, summ as (select s.file_path, count(e.type) as total_mappings,
  count_if(e.type = 'mapstruct')::bigint as mapstruct_mappings,
  count_if(e.type = 'pojo')::bigint as pojo_mappings
  from src s left join ent e on e.file_path = s.file_path group by s.file_path)"""


@check("mapping_summary", _SUMMARY_SQL + " select * from summ")
def _(spark, sf):
    return en.summary(java_sources(spark, sf), _entries(spark, sf))


@check(
    "sample_diagnostic",
    _SUMMARY_SQL + " select count(*) as n_files, count_if(total_mappings > 0)::bigint as "
    "files_with_mappings, sum(total_mappings)::bigint as total_mappings from "
    "(select * from summ order by file_path limit 5)",
)
def _(spark, sf):
    return en.sample_diagnostic(
        java_sources(spark, sf), lambda texts: en.entries(lineage.field_mappings(texts))
    )


@check(
    "extraction_errors",
    _SUMMARY_SQL + " select m.file_path, case when d.doc_id % 5 = 0 then 'invalid UTF-8' end as error, "
    "case when d.doc_id % 5 = 0 then 0 else total_mappings end as total_mappings, "
    "case when d.doc_id % 5 = 0 then 0 else mapstruct_mappings end as mapstruct_mappings, "
    "case when d.doc_id % 5 = 0 then 0 else pojo_mappings end as pojo_mappings "
    f"from summ m join (select doc_id, {JAVA_PATH} as file_path from documents) d "
    "on d.file_path = m.file_path",
)
def _(spark, sf):
    """Files that could not be read: an error row with zero counts each."""
    bad = F.substring_index(F.substring_index("file_path", "/F", -1), ".", 1).cast("long") % 5 == 0
    texts = java_sources(spark, sf).withColumn("error", F.when(bad, "invalid UTF-8"))
    texts = hold(texts.withColumn("content", F.when(~bad, F.col("content"))))
    return en.summary(texts, en.entries(lineage.field_mappings(texts)))


@check(
    "extract_with_model",
    _SUMMARY_SQL + f", asked as (select file_path, length('{fixed.EXTRACT_HEAD}') + length(content) "
    f"+ length('{fixed.EXTRACT_TAIL}') as n from src) "
    "select a.file_path, case when n % 3 = 0 then 1 else total_mappings end as total_mappings, "
    "case when n % 3 = 0 then 1 else pojo_mappings end as pojo_mappings, "
    "case when n % 3 = 1 then 'RuntimeError: bad item' end as error "
    "from asked a join summ m on m.file_path = a.file_path",
)
def _(spark, sf):
    """A model that answers one file in three, fails on one, and talks about the rest."""

    def make():
        def call(items):
            if any(len(p) % 3 == 1 for p, _ in items):
                raise RuntimeError("bad item")
            return ['{"mapping_type": "pojo"}' if len(p) % 3 == 0 else "I cannot say" for p, _ in items]

        return call

    found = extraction.extract(java_sources(spark, sf), "model", make, wait=0.0)
    return found.select(
        "file_path", F.col("total_mappings").cast("long").alias("total_mappings"),
        F.col("pojo_mappings").cast("long").alias("pojo_mappings"), "error",
    )


@check(
    "fields_per_mapping",
    f"with {sq.ENTRIES} select file_path, type, method, pos, len(fields)::int as n_fields from ent",
)
def _(spark, sf):
    return en.fields_per_mapping(_entries(spark, sf))


@check(
    "batch_progress",
    f"with {sq.DOC_SRC}, p as (select row_number() over (order by md5(file_path), file_path) - 1 "
    "as i from src) select batch, n_files, processed, round(processed / t * 100, 1) as percent, "
    "processed % 300 = 0 as checkpoint from (select i // 100 as batch, count(*) as n_files, "
    "sum(count(*)) over (order by i // 100)::bigint as processed, "
    "(select count(*) from src)::double as t from p group by i // 100)",
)
def _(spark, sf):
    return progress.batch_progress(
        text_sources(spark, sf), batch_size=100, checkpoint_every=300
    )


@check(
    "chunks_stored",
    f"with {sq.DOC_SRC}, {sq.chunk_records()} select file_path, "
    "count_if(coalesce(chunk_index, 0) % 4 <> 3)::bigint as n_stored, "
    "max(coalesce(total_chunks, 1)) as n_total from crec group by file_path",
)
def _(spark, sf):
    records = chunking.code_records(text_sources(spark, sf))
    lost = F.coalesce("chunk_index", F.lit(0)) % 4 == 3
    return chunking.chunks_stored(
        records.withColumn("embedding", F.when(~lost, F.array(F.lit(1.0))))
    )


@check(
    "mapping_grouped",
    f"with {sq.FM} select file_path, interface, method, source_type, target_type, "
    "case when bool_or(implicit) then '' else string_agg(coalesce(source_field, '') || '->' || "
    "target_field, ',' order by pos) end as fields, "
    "count_if(not implicit)::int as n_fields from fm where type = 'mapstruct' "
    "group by file_path, interface, method, source_type, target_type, method_pos",
)
def _(spark, sf):
    text = F.array_join(
        F.transform("fields", lambda f: F.concat_ws("->", f["source"], f["target"])), ","
    )
    return en.grouped(_mappings(spark, sf)).select(
        "file_path", "interface", "method", "source_type", "target_type",
        F.when(F.col("implicit"), "").otherwise(text).alias("fields"), "n_fields",
    )


# === field lineage =============================================================================


@check(
    "mapper_scope",
    f"with {sq.SCOPES} select a.file_path, a.pos, a.kind, d.decl, coalesce(d.in_mapper, false) "
    "as in_mapper from pst a left join decl d on d.file_path = a.file_path "
    "and d.decl_pos = a.decl_pos",
)
def _(spark, sf):
    return _scoped(spark, sf).select("file_path", "pos", "kind", "decl", "in_mapper")


@check(
    "mapper_methods",
    f"with {sq.SCOPES} select file_path, decl as interface, method, return_type, "
    "type1 as source_type, annotated, method_pos from mth "
    "where method_kind = 'declared' and in_mapper",
)
def _(spark, sf):
    return lineage.mapper_methods(_scoped(spark, sf))


@check(
    "param_type",
    f"with {sq.SCOPES} select file_path, method_pos, params, type1 as first_type, "
    "n_params::int as n_params from mth",
)
def _(spark, sf):
    methods = _scoped(spark, sf).where(F.col("kind").isin(tk.METHODS))
    return methods.select(
        "file_path",
        "method_pos",
        "params",
        tk.first_parameter_type().alias("first_type"),
        F.size("args").alias("n_params"),
    )


@check(
    "annotation_attach",
    f"with {sq.ANNOTATIONS} select file_path, pos, interface, method, method_pos from ann",
)
def _(spark, sf):
    return lineage.annotations(_scoped(spark, sf)).select(
        "file_path", "pos", "interface", "method", "method_pos"
    )


@check(
    "annotation_attrs",
    f"with {sq.ANNOTATIONS} select file_path, pos, source, target, expression, ignore from ann",
)
def _(spark, sf):
    return lineage.annotations(_scoped(spark, sf)).select(
        "file_path", "pos", "source", "target", "expression", "ignore"
    )


@check(
    "annotation_container",
    f"with {sq.SRC} select file_path, (1 + case when doc_id % 3 < 2 then 1 else 0 end)::bigint "
    "as n_annotations from src",
)
def _(spark, sf):
    inside = lineage.annotations(_scoped(spark, sf)).where("method = 'toT'")
    return inside.groupBy("file_path").agg(F.count("*").alias("n_annotations"))


@check(
    "implicit_mapping",
    f"with {sq.FM} select file_path, interface, method, source_type, target_type, implicit from fm "
    "where implicit",
)
def _(spark, sf):
    return lineage.implicit_mappings(_scoped(spark, sf)).select(
        "file_path", "interface", "method", "source_type", "target_type", "implicit"
    )


@check(
    "pojo_methods",
    f"with {sq.STATEMENTS} select file_path, method_pos, method, return_type, source_type, "
    "source_var, target_type, target_var from st where kind = 'body'",
)
def _(spark, sf):
    return lineage.pojo_methods(_statements(spark, sf))


ASSIGNED = ["file_path", "method", "source_field", "target_field", "target_path", "pos"]


@check("setter_assign", f"with {sq.SETTERS} select {', '.join(ASSIGNED)} from set_map")
def _(spark, sf):
    return lineage.setter_assignments(_statements(spark, sf)).select(*ASSIGNED)


@check("direct_assign", f"with {sq.DIRECTS} select {', '.join(ASSIGNED)} from dir_map")
def _(spark, sf):
    return lineage.direct_assignments(_statements(spark, sf)).select(*ASSIGNED)


@check("var_source", f"with {sq.STATEMENTS} select file_path, method_pos, var, path from last_vars")
def _(spark, sf):
    return lineage.last_sources(lineage.variable_sources(_statements(spark, sf)))


@check(
    "list_members",
    f"with {sq.NESTED} select file_path, method_pos, list_var, item_var from adds",
)
def _(spark, sf):
    return lineage.list_members(_statements(spark, sf))


@check("var_to_target", f"with {sq.VAR_TARGETS} select {', '.join(ASSIGNED)} from var_map")
def _(spark, sf):
    return lineage.variable_to_target(_statements(spark, sf)).select(*ASSIGNED)


@check(
    "value_class",
    f"with {sq.STATEMENTS} select file_path, pos, value, {sq.VALUE_SOURCE} as source_field from ksets",
)
def _(spark, sf):
    known = lineage.with_sources(_statements(spark, sf)).where("kind = 'setter'")
    return known.select("file_path", "pos", "value", lineage.value_source().alias("source_field"))


@check(
    "declarations",
    f"with {sq.TOKENS} select file_path, kind, regexp_extract(token, '^\\w+\\s+(\\w+)', 1) as name, "
    "pos from tk where kind in ('class', 'interface')",
)
def _(spark, sf):
    return tk.declarations(tk.tokens(java_sources(spark, sf)))


@check("field_mappings", f"with {sq.FM} select * from fm")
def _(spark, sf):
    return _mappings(spark, sf)


@check(
    "mapping_entries",
    f"with {sq.ENTRIES} select file_path, type, interface, method, source_type, target_type, "
    "to_json(fields)::varchar as fields, implicit, pos from ent",
)
def _(spark, sf):
    json = F.to_json("field_mappings", {"ignoreNullFields": "false"})
    return _entries(spark, sf).withColumn("field_mappings", json).withColumnRenamed(
        "field_mappings", "fields"
    )


def _java_code(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.code_records(java_sources(spark, sf))


def _code_hits(spark: SparkSession, sf: str, k: int) -> DataFrame:
    vectors = hash_embed(_java_code(spark, sf).select("id", "document"), "document")
    asked = hash_embed(_bench_questions(spark, sf), "question")
    return hold(knn.nearest(vectors, asked, k))


_JAVA_HITS = (
    f"{sq.ENTRIES}, {_CODE_VECTORS}, {sq.sparse_nearest('cw', 'id', 'qw', 'query_id', 'hit', 5)}, "
    "hfile as (select h.query_id, c.file_path, min(h.rank) as rank from hit h "
    "join crec c on c.id = h.id group by all)"
)


@check(
    "extract_on_hits",
    f"with {_JAVA_HITS} select h.query_id, h.rank, e.file_path, e.type, e.method, e.source_type, "
    "e.target_type, len(e.fields)::int as n_fields, e.pos from hfile h "
    "join ent e on e.file_path = h.file_path",
)
def _(spark, sf):
    found = rag.extract_on_hits(_code_hits(spark, sf, 5), _java_code(spark, sf))
    return found.select(
        "query_id", "rank", "file_path", "type", "method", "source_type", "target_type",
        F.size("field_mappings").alias("n_fields"), "pos",
    )


# === scalar functions ==========================================================================


@check(
    "decapitalise",
    "select doc_id, lower(left(upper(source), 1)) || substr(upper(source), 2) as name "
    "from documents",
)
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", tx.decapitalise(F.upper("source")).alias("name")
    )


@check(
    "snake_to_camel",
    f"select event_id, {sq.camel('upper(event_type)')} as word, "
    + sq.camel("upper(event_type) || '_TYPE_' || user_id").replace("lambda w, i", "lambda w, i")
    + " as name from events",
)
def _(spark, sf):
    name = F.concat(F.upper("event_type"), F.lit("_TYPE_"), F.col("user_id").cast("string"))
    return table(spark, sf, "events").select(
        "event_id",
        tx.snake_to_camel(F.upper("event_type")).alias("word"),
        tx.snake_to_camel(name).alias("name"),
    )


@check(
    "md5_ids",
    "select page_id, md5(url) as file_id, md5(url) || '_chunk_' || page_id as chunk_id from pages",
)
def _(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", tx.file_id("url").alias("file_id"), tx.chunk_id("url", "page_id").alias("chunk_id")
    )


@check("mapping_id", f"with {sq.IDS} select file_path, pos, key_json, md5(key_json) as id from ided")
def _(spark, sf):
    return en.with_id(_entries(spark, sf)).select(
        "file_path", "pos", en.canonical_json().alias("key_json"), "id"
    )


@check(
    "percent_text",
    "select doc_id, printf('%.2f%%', round((doc_id % 997) / 997.0::double * 100, 2)) as share, "
    "printf('%.1f%%', round((quality + 2 * toxic) / 3.0::double * 100, 1)) as flags from labels",
)
def _(spark, sf):
    return table(spark, sf, "labels").select(
        "doc_id",
        tx.percent_text((F.col("doc_id") % 997) / 997).alias("share"),
        tx.percent_text((F.col("quality") + 2 * F.col("toxic")) / 3, 1).alias("flags"),
    )


# === context, prompt, answer ===================================================================


@check(
    "mapping_document",
    f"with {sq.MAPPING_RECORDS} select m.id, m.file_path, m.pos, m.document || chr(10) || chr(10) "
    "|| 'Code:' || chr(10) || s.content as document from mrec m "
    "join src s on s.file_path = m.file_path",
)
def _(spark, sf):
    records = st.mapping_records(_entries(spark, sf), java_sources(spark, sf))
    return records.select("id", "file_path", "pos", "document")


_SIMILAR = "printf('%.2f%%', round((1 - h.distance) * 100, 2))"
_CODE_TEXT = sq.lines(
    f"chr(10) || '--- Code File ' || h.rank || ' (Similarity: ' || {_SIMILAR} || ') ---'",
    "'File: ' || c.file_path",
    "'Chunk: ' || (c.chunk_index + 1) || '/' || c.total_chunks",
    "chr(10) || 'Full Code:' || chr(10) || c.document",
    "''",
)
_EXTRACTED_TEXT = sq.lines(
    "chr(10) || '--- Mapping ' || i || ' ---'",
    "'Type: ' || type",
    "'Source: ' || source_type || ' -> Target: ' || target_type",
    "'Method: ' || nullif(method, '')",
    "case when len(fields) > 0 then 'Field Mappings:' || chr(10) || "
    + sq.field_lines("  ", "", expression=False) + " end",
    "''",
)
_STORED_TEXT = sq.lines(
    f"chr(10) || '--- Mapping ' || h.rank || ' (Similarity: ' || {_SIMILAR} || ') ---'",
    "'File: ' || m.file_path",
    "'Type: ' || m.mapping_type",
    "'Source: ' || m.source_type || ' -> Target: ' || m.target_type",
    "'Interface: ' || nullif(m.interface, '')",
    "'Method: ' || nullif(m.method, '')",
    "chr(10) || 'Details:' || chr(10) || m.document",
    "''",
)
_CONTEXT = f"""{sq.MAPPING_RECORDS}, {_CODE_VECTORS},
{sq.sparse('mrec', 'id', 'document', 'mw')},
{sq.sparse_nearest('cw', 'id', 'qw', 'query_id', 'hit', 5)},
{sq.sparse_nearest('mw', 'id', 'qw', 'query_id', 'mhit', 5)},
hfile as (select h.query_id, c.file_path, min(h.rank) as rank from hit h
  join crec c on c.id = h.id group by all),
exn as (select h.query_id, e.*, row_number() over (partition by h.query_id
  order by h.rank, e.file_path, e.pos) as i from hfile h join ent e on e.file_path = h.file_path),
c1 as (select h.query_id, '=== Relevant Code Files (Full Source Code) ===' || chr(10) || chr(10)
  || string_agg({_CODE_TEXT}, chr(10) order by h.rank) as t
  from hit h join crec c on c.id = h.id group by h.query_id),
c2 as (select query_id, '=== Extracted Mappings (On-Demand) ===' || chr(10) || chr(10)
  || string_agg({_EXTRACTED_TEXT}, chr(10) order by i) as t from exn group by query_id),
c3 as (select h.query_id, '=== Pre-Extracted Mappings (Summary) ===' || chr(10) || chr(10)
  || string_agg({_STORED_TEXT}, chr(10) order by h.rank) as t
  from mhit h join mrec m on m.id = h.id group by h.query_id),
ctx as (select b.query_id, b.text as question, concat_ws(chr(10), c1.t, c2.t, c3.t) as context
  from bench b left join c1 using (query_id) left join c2 using (query_id)
  left join c3 using (query_id))"""


def _context(spark: SparkSession, sf: str) -> DataFrame:
    code = _java_code(spark, sf)
    mappings = hold(st.mapping_records(_entries(spark, sf)))
    asked = _bench_questions(spark, sf)
    vectors = hash_embed(mappings.select("id", "document"), "document")
    mapping_hits = hold(knn.nearest(vectors, hash_embed(asked, "question"), 5))
    return rag.build_context(asked, _code_hits(spark, sf, 5), code, mapping_hits, mappings)


@check("rag_context", f"with {_CONTEXT} select query_id, question, context from ctx")
def _(spark, sf):
    return _context(spark, sf)


@check(
    "rag_prompt",
    f"with {_CONTEXT} select query_id, md5('{fixed.PROMPT_HEAD}' || question || chr(10) || chr(10) "
    f"|| context || '{fixed.PROMPT_TAIL}') as prompt_md5, length('{fixed.SYSTEM_PROMPT}')::int "
    "as n_system from ctx",
)
def _(spark, sf):
    return rag.with_prompt(_context(spark, sf)).select(
        "query_id", F.md5("prompt").alias("prompt_md5"), F.length("system").alias("n_system")
    )


@check(
    "rag_answer",
    f"with {_CONTEXT} select query_id, question, md5(context) as context_md5, "
    "5 as n_retrievals, 5 as n_code_retrievals, "
    f"case when n % 5 = 0 then '' else n || ' characters' end as answer, "
    f"case when n % 5 = 0 then '{fixed.NO_ANSWER_ERROR}' end as error from (select *, "
    f"length('{fixed.PROMPT_HEAD}' || question || context || '{fixed.PROMPT_TAIL}') + 2 as n "
    "from ctx)",
)
def _(spark, sf):
    store = st.Store(spark, new_path(spark, "store"))
    ingest.ingest(store, java_sources(spark, sf), hash_embed)
    store.add_mappings(st.mapping_records(_entries(spark, sf)), hash_embed)
    out = rag.answer_questions(
        _bench_questions(spark, sf), store.code(), store.mappings(), hash_embed, _stub_generate
    )
    return out.select(
        "query_id", "question", F.md5("context").alias("context_md5"),
        F.size("retrievals").alias("n_retrievals"),
        F.size("code_retrievals").alias("n_code_retrievals"), "answer", "error",
    )


# === streams ===================================================================================


@check(
    "stream_ingest",
    f"with {sq.DOC_SRC}, {sq.chunk_records()} select id, file_path, chunk_index, "
    "md5(document) as document_md5 from crec where regexp_matches(document, '[\\p{L}\\p{N}_]')",
)
def _(spark, sf):
    inbox = new_path(spark, "inbox")
    text_sources(spark, sf).repartition(6).write.parquet(inbox)
    files_in = (
        spark.readStream.schema("file_path string, content string")
        .option("maxFilesPerTrigger", 2)
        .parquet(inbox)
    )
    store = st.Store(spark, new_path(spark, "store"))
    checkpoint = new_path(spark, "checkpoint")
    for _ in range(2):  # The second run finds nothing new.
        stream.ingest_stream(files_in, store, hash_embed, checkpoint).awaitTermination()
    return store.code().select(
        "id", "file_path", "chunk_index", F.md5("document").alias("document_md5")
    )


_VERSIONS = (
    f"src as (select doc_id, {DOC_PATH} as file_path, case when doc_id % 3 = 0 then 'second ' || text else text end "
    "as content from documents where doc_id % 5 <> 0)"
)


@check(
    "stream_changes",
    f"with {_VERSIONS}, {sq.chunk_records()} select id, file_path, chunk_index, "
    "md5(document) as document_md5 from crec where regexp_matches(document, '[\\p{L}\\p{N}_]')",
)
def _(spark, sf):
    """All files, then changed and unchanged ones again, then deletes; by state, over two runs."""
    inbox, checkpoint = new_path(spark, "inbox"), new_path(spark, "checkpoint")
    texts, n = text_sources(spark, sf), F.regexp_extract("file_path", "(\\d+)\\.txt$", 1).cast("long")
    second = texts.where(n % 3 < 2).withColumn(
        "content", F.when(n % 3 == 0, F.concat(F.lit("second "), "content")).otherwise(F.col("content"))
    )
    gone = texts.where(n % 5 == 0).withColumn("content", F.lit(None).cast("string"))
    store = st.Store(spark, new_path(spark, "store"))
    for version, files_in in enumerate([texts, second, gone]):
        files_in.withColumn("version", F.lit(version)).repartition(3).write.mode("append").parquet(inbox)
        if version > 0:  # The first two versions come in one run.
            arriving = (
                spark.readStream.schema("file_path string, content string, version int")
                .option("maxFilesPerTrigger", 2)
                .parquet(inbox)
            )
            changes.ingest_changes(arriving, store, hash_embed, checkpoint, version_col="version").awaitTermination()
    return store.code().select("id", "file_path", "chunk_index", F.md5("document").alias("document_md5"))


_LINES_SQL = """lin as (
  select conv_id as question_id, turn as seq,
    case when (conv_id + turn) % 7 = 2 then null else text end as chunk,
    role = 'assistant' and (conv_id + turn) % 7 > 0 as done
  from conversations),
dec as (select * from lin where chunk is not null and (regexp_matches(chunk, '\\S')
  or (question_id + seq) % 7 > 0))"""


@check("ndjson_decode", f"with {_LINES_SQL} select question_id, seq, chunk, done from dec")
def _(spark, sf):
    return answers.decode_lines(answer_lines(spark, sf)).drop("line")


_UNTIL_DONE = f"""with {_LINES_SQL},
cut as (select d.*, min(case when done then seq end) over (partition by question_id) as last_seq
        from dec d)
select question_id, string_agg(chunk, '' order by seq) as answer, count(*) as n_chunks,
  bool_or(done) as complete from cut where last_seq is null or seq <= last_seq group by question_id"""


@check("answer_log", f"with {_LINES_SQL} select question_id, seq, chunk, done from dec")
def _(spark, sf):
    """Two runs of one stream: the second reads the logs that came after the first, and no line again."""
    logs, out, checkpoint = (new_path(spark, n) for n in ("logs", "pieces", "checkpoint"))
    for late in (False, True):
        lines = answer_lines(spark, sf).where((F.col("seq") > 2) == F.lit(late))
        log = lines.select(F.to_json(F.struct("question_id", "seq", "line")))
        log.repartition(3).write.mode("append").text(logs)
        query = (
            answers.decode_lines(answer_log.pieces(answer_log.log_lines(spark, logs, split_bytes=1 << 20)))
            .drop("line")
            .writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return spark.read.parquet(out)


@check("concat_until_done", _UNTIL_DONE)
def _(spark, sf):
    return answers.concat_until_done(answers.decode_lines(answer_lines(spark, sf)), slice_rows=3)


@check(
    "answer_chunks",
    "with p as (select doc_id as query_id, text, length(text) as n from documents), "
    "pieces as (select query_id, unnest(range(0, n, 100)) as place, text from p where n % 7 <> 0) "
    "select query_id, (place / 100)::bigint as seq, substr(text, place + 1, 100) as chunk, false as done, "
    "null::varchar as error from pieces union all select query_id, "
    "case when n % 7 = 0 then 0 else ceil(n / 100.0)::bigint end, null, true, "
    "case when n % 7 = 0 then 'ValueError: no answer' end from p",
)
def _(spark, sf):
    def make():
        def stream(prompt, system):
            if len(prompt) % 7 == 0:
                raise ValueError("no answer")
            for at in range(0, len(prompt), 100):
                yield prompt[at : at + 100]

        return stream

    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("prompt"))
    return answers.answer_chunks(docs, make)


@check("answers_stream", f"select * from ({_UNTIL_DONE}) where complete")
def _(spark, sf):
    inbox, out = new_path(spark, "inbox"), new_path(spark, "answers")
    # In bands of the numbers, so that most answers span micro-batches.
    for band in (F.col("seq") < 2, F.col("seq").between(2, 3), F.col("seq") > 3):
        answer_lines(spark, sf).where(band).coalesce(1).write.mode("append").parquet(inbox)
    lines = (
        spark.readStream.schema("question_id bigint, seq bigint, line string")
        .option("maxFilesPerTrigger", 1)
        .parquet(inbox)
    )
    query = (
        answers.answers_stream(answers.decode_lines(lines), timeout_seconds=None)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", new_path(spark, "checkpoint"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(out)


@check(
    "answers_by_number",
    f"""with {_LINES_SQL}, lost as (select * from lin where (question_id * 8 + seq) % 13 <> 5),
kept as (select * from lost semi join dec using (question_id, seq)),
ends as (select question_id, min(seq) as last_seq from kept where done group by all),
whole as (select question_id from lost join ends using (question_id) where seq <= last_seq
  group by question_id, last_seq having count(*) = last_seq + 1)
select question_id, coalesce(string_agg(chunk, '' order by seq), '') as answer, count(*) as n_chunks, true as complete
from kept join ends using (question_id) semi join whole using (question_id) where seq <= last_seq group by question_id""",
)
def _(spark, sf):
    """The last numbers first, over several partitions, with a line of some answers lost on the way."""
    inbox, out = new_path(spark, "inbox"), new_path(spark, "answers")
    lines = answer_lines(spark, sf).where((F.col("question_id") * 8 + F.col("seq")) % 13 != 5)
    bands = [F.col("seq") > 4, F.col("seq").between(2, 4), F.col("seq") < 2]
    for number, band in enumerate(bands):
        lines.where(band).repartition(3).write.parquet(f"{inbox}/band={number}")
    arriving = (
        spark.readStream.schema("question_id bigint, seq bigint, line string, band int")
        .option("maxFilesPerTrigger", 3)
        .parquet(inbox)
    )
    chunks = answers.decode_lines(arriving, keep_blank=True)
    with gathering.keyed_state(spark):
        query = (
            gathering.answers_by_number(chunks)
            .writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", new_path(spark, "checkpoint"))
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return spark.read.parquet(out)


# === lineage questions =========================================================================


@check(
    "lineage_by_types",
    f"with {sq.FM} select file_path, pos, method, source_field, target_field from fm "
    "where source_type = 'S1' and target_type = 'T2'",
)
def _(spark, sf):
    return questions.by_types(_mappings(spark, sf), "S1", "T2").select(
        "file_path", "pos", "method", "source_field", "target_field"
    )


@check(
    "lineage_fields",
    f"with {sq.FM} select distinct source_field, target_field from fm "
    "where source_type = 'Order' and target_type = 'Target' and source_field is not null",
)
def _(spark, sf):
    return questions.fields_between(_mappings(spark, sf), "Order", "Target")


@check(
    "field_usage",
    f"with {sq.FM}, named as (select file_path, count(*) as n from fm where "
    "regexp_matches(lower(coalesce(source_field, '')), '(^|[.\\]])src7($|[.\\[])') or "
    "regexp_matches(lower(coalesce(target_field, '')), '(^|[.\\]])src7($|[.\\[])') "
    "group by file_path) select s.file_path, coalesce(n, 0) as n_mappings from src s "
    "left join named m on m.file_path = s.file_path "
    "where regexp_matches(s.content, '(?i)\\bsrc7\\b')",
)
def _(spark, sf):
    return questions.field_usage(_mappings(spark, sf), java_sources(spark, sf), "SRC7")


@check(
    "field_transformed",
    f"with {sq.FM} select file_path, pos, method, source_field, target_field, expression from fm "
    "where expression is not null or source_field <> target_field",
)
def _(spark, sf):
    return questions.transformed(_mappings(spark, sf)).select(
        "file_path", "pos", "method", "source_field", "target_field", "expression"
    )


# === nested scopes =============================================================================


@check("scope_forms", SCOPE_ROWS)
def _(spark, sf):
    """Nested types, anonymous classes, lambdas, text blocks and deep calls; rows from the template."""
    docs = table(spark, sf, "documents")
    texts = docs.select(F.expr(JAVA_PATH).alias("file_path"), F.expr(SCOPE_TEXT).alias("content"))
    return lineage.field_mappings(texts).select(
        "file_path", "type", "interface", "method", "source_type", "target_type", "source_field",
        "target_field", "implicit",
    )


@check("fields_reached", CHAIN_SQL)
def _(spark, sf):
    """All fields that the fields of three types arrive in, over mappers and methods of all files."""
    docs = table(spark, sf, "documents")
    texts = docs.select(F.expr(JAVA_PATH).alias("file_path"), F.expr(CHAIN_TEXT).alias("content"))
    starts = docs.where("doc_id % 40 < 3").selectExpr("concat('N', doc_id % 40) as type", "concat('f', doc_id % 7) as field")
    return reach.reached(lineage.field_mappings(texts), starts)


@check("flow_forms", FLOW_ROWS)
def _(spark, sf):
    """Variables by the assignment they hold where they are used, and computed values; rows from the template."""
    docs = table(spark, sf, "documents")
    texts = docs.select(F.expr(JAVA_PATH).alias("file_path"), F.expr(FLOW_TEXT).alias("content"))
    return lineage.field_mappings(texts).select("file_path", "target_field", "source_field", "expression")


@check(
    "inline_source",
    f"select doc_id, {JAVA_PATH} as file_path, length(text) as n_chars from documents "
    "where doc_id = (select min(doc_id) from documents)",
)
def _(spark, sf):
    """A text given as a string; the first document's, whole."""
    docs = table(spark, sf, "documents")
    row = docs.orderBy("doc_id").select("doc_id", F.expr(JAVA_PATH).alias("path"), "text").first()
    source = files.inline_source(spark, row.text, row.path)
    return source.select(
        F.lit(row.doc_id).cast("bigint").alias("doc_id"), "file_path", F.length("content").cast("bigint").alias("n_chars")
    )
