"""Queries of the engine's own operators, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..engine import Engine
from ..functions import chunkers, embed, text
from ..operators import images as im
from ..operators import merkle, payloads, store, sync
from ..session import materialize, shared_dir, table
from ..sources import discover, loaders, symbols
from ..streaming import streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Unicode blanks in the notation of the SQL engine's regular expressions
BL = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class _Sql(str):
    """SQL text with one gap."""

    def format(self, x: str) -> str:
        return self.replace("@@", x)


STRIP = _Sql(f"regexp_replace(regexp_replace(@@, '^{BL}+', ''), '{BL}+$', '')")
IDSQL = _Sql("(concat('0x', substr(sha256(@@), 1, 16))::UBIGINT & 9223372036854775807::UBIGINT)::BIGINT")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


# -- discovery and predicates ------------------------------------------------------------------------
@query("SELECT source, resolved, rel_path FROM (SELECT *, row_number() OVER (PARTITION BY resolved ORDER BY source) AS rn FROM source_files) WHERE rn = 1")
def scan_first_per_resolved(spark, d):
    files = table(spark, d, "source_files").select("source", "resolved", "rel_path", F.lit(0).alias("k"))
    return discover.first_per_resolved(files).drop("k")


_PATTERNS = ("*.phtml", "notes/**", "tests", "*_a.py", "lib/*/pack_*.??", "[a-c]*_[!a-m].rs")
_EXCL = " OR ".join(
    [f"regexp_full_match(rel_path, '{r}') OR len(list_filter(string_split(rel_path, '/'), lambda x: regexp_full_match(x, '{r}'))) > 0" for r in (r"(?s).*\.phtml", "(?s)notes/.*", "(?s)tests", r"(?s).*_a\.py", r"(?s)lib/.*/pack_.*\...", r"(?s)[a-c].*_[^a-m]\.rs")]
    + ["len(list_filter(list_slice(string_split(rel_path, '/'), 1, len(string_split(rel_path, '/')) - 1), lambda x: x = 'notes')) > 0"]
)


@query(f"SELECT file_id, rel_path, ({_EXCL}) AS excluded FROM source_files")
def filter_excluded(spark, d):
    return discover.mark_excluded(table(spark, d, "source_files"), _PATTERNS, use_defaults=False).select("file_id", "rel_path", "excluded")


@query(f"SELECT ({_EXCL}) AS excluded, count(*) AS files, sum(size)::BIGINT AS bytes FROM source_files GROUP BY 1")
def filter_partition(spark, d):
    inside, outside = discover.filter_files(table(spark, d, "source_files"), _PATTERNS, use_defaults=False)
    one = lambda df, x: df.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")).select(F.lit(x).alias("excluded"), "files", "bytes")
    return one(inside, False).unionByName(one(outside, True)).where("files > 0")


@query("""
    SELECT CASE WHEN e = '.md' THEN 'markdown' WHEN e = '.pdf' THEN 'semantic' WHEN e IN ('.html', '.htm') THEN 'html'
        WHEN e IN ('.py', '.pyi', '.php', '.php3', '.php4', '.php5', '.phtml', '.rs') THEN 'code' ELSE 'recursive' END AS strategy, count(*) AS files
    FROM (SELECT lower(extension) AS e FROM documents UNION ALL SELECT lower(extension) FROM source_files) GROUP BY 1
""")
def dispatch_strategy(spark, d):
    both = table(spark, d, "documents").select("extension").unionByName(table(spark, d, "source_files").select("extension"))
    return both.select(chunkers.preferred_strategy(F.coalesce("extension", F.lit(""))).alias("strategy")).groupBy("strategy").agg(F.count(F.lit(1)).alias("files"))


@query("SELECT source, length(t) AS chars, sha256(t) AS hash, content_hash FROM (SELECT source, sha256(content) AS content_hash, regexp_replace(decode(content), '\\r\\n?', chr(10), 'g') AS t FROM source_files)")
def load_text_files(spark, d):
    """Texts as the loaders give them, and the hash of the bytes that the sync compares."""
    files = table(spark, d, "source_files")
    docs = loaders.load(files).where("error IS NULL").select("source", F.length("content").cast("long").alias("chars"), F.sha2("content", 256).alias("hash"))
    return docs.join(files.select("source", sync.file_hash(F.col("content")).alias("content_hash")), "source")


@query("SELECT source, filename, extension, size, round(mtime, 3) AS modified, true AS is_code, CASE lower(extension) WHEN '.rs' THEN 'rust' WHEN '.py' THEN 'python' WHEN '.pyi' THEN 'python' ELSE 'php' END AS code_language FROM source_files")
def load_code_files(spark, d):
    docs = loaders.load(table(spark, d, "source_files")).where("symbols IS NOT NULL AND error IS NULL")
    m = F.col("metadata")
    return docs.select("source", m["filename"].alias("filename"), m["extension"].alias("extension"), m["size"].alias("size"), F.round(m["modified_time"], 3).alias("modified"), m["is_code"].alias("is_code"), symbols.language_of(m["extension"]).alias("code_language"))


_RST = f"""
    SELECT doc_id, {STRIP.format("l[i]")} AS title FROM (
        SELECT doc_id, l, list_min(list_filter(range(1, len(l)), lambda j: length(l[j + 1]) > 0 AND regexp_full_match({STRIP.format("l[j + 1]")}, '[=~`-]*'))) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
"""


@query(_RST)
def load_rst_titles(spark, d):
    return table(spark, d, "documents").select("doc_id", text.rst_title(F.col("text")).alias("title"))


def _listed(spark, d):
    """Symbols of the source files that parse, without functions nested in functions and kinds that the table does not list."""
    files = table(spark, d, "source_files")
    body = text.universal_newlines(F.decode("content", "UTF-8"))
    body = F.when(symbols.language_of(F.col("extension")) == "php", body).otherwise(F.regexp_replace(body, "^\ufeff", ""))
    found = files.select("file_id", F.explode(symbols.extract_symbols(body, F.col("extension"), recover=False)).alias("s")).select("file_id", "s.*")
    found = found.where(F.col("symbol_type").isin("function", "method", "class", "struct"))
    spans = found.where(F.col("symbol_type").isin("function", "method")).select("file_id", F.col("line_start").alias("a"), F.col("line_end").alias("b"))
    nested = found.where("symbol_type = 'function'").join(spans, "file_id").where("line_start > a AND line_end <= b").select("file_id", "line_start").distinct()
    return found.join(nested, ["file_id", "line_start"], "left_anti")


@query(f"SELECT DISTINCT file_id, name, qualified_name, symbol_type, language, parent, visibility, line_start, line_end, {STRIP.format('content')} AS content FROM symbols")
def symbols_listed(spark, d):
    return _listed(spark, d).select("file_id", "name", "qualified_name", "symbol_type", "language", "parent", "visibility", "line_start", "line_end", text.strip(F.col("content")).alias("content")).distinct()


@query("SELECT DISTINCT file_id, qualified_name, signature FROM symbols WHERE signature IS NOT NULL")
def symbols_signatures(spark, d):
    """Signatures of the symbols whose row in the table kept one."""
    kept = table(spark, d, "symbols").where("signature IS NOT NULL").select("file_id", "qualified_name").distinct()
    return _listed(spark, d).join(kept, ["file_id", "qualified_name"], "left_semi").select("file_id", "qualified_name", F.coalesce("signature", F.lit("")).alias("signature")).distinct()


@query()
def symbols_all(spark, d):
    files = table(spark, d, "source_files")
    body = text.universal_newlines(F.decode("content", "UTF-8"))
    return files.select("file_id", F.explode(symbols.extract_symbols(body, F.col("extension"))).alias("s")).select("file_id", "s.name", "s.qualified_name", "s.symbol_type", "s.signature", "s.docstring", "s.visibility", "s.parent")


# -- scalar functions ----------------------------------------------------------------------------------
@query(f"SELECT doc_id, i AS chunk_index, {IDSQL.format("source_path || '-' || i")} AS id FROM documents, (SELECT unnest(range(3))::INT AS i)")
def fn_point_id(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("chunk_index"), "source_path").select("doc_id", "chunk_index", text.point_id(F.col("source_path"), F.col("chunk_index")).alias("id"))


@query(f"SELECT image_id, {IDSQL.format("'image:' || source || '-' || ord")} AS id FROM images")
def fn_image_point_id(spark, d):
    return table(spark, d, "images").select("image_id", text.image_point_id(F.col("source"), F.col("ord")).alias("id"))


@query("SELECT DISTINCT 'maker/' || upper(vector_name) AS model, 'fast-' || lower(vector_name) AS text_name, 'clip-' || lower(vector_name) AS image_name FROM points WHERE vector_name IS NOT NULL")
def fn_vector_names(spark, d):
    model = F.concat(F.lit("maker/"), F.upper("vector_name"))
    return table(spark, d, "points").where("vector_name IS NOT NULL").select(model.alias("model"), text.vector_name(model).alias("text_name"), text.clip_vector_name(model).alias("image_name")).distinct()


@query("SELECT o_orderkey, CASE WHEN length(s) >= 8 THEN substr(s, 1, 4) || '-' || substr(s, 5, 2) || '-' || substr(s, 7, 2) END AS day FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y%m') ELSE strftime(o_orderdate, '%Y%m%d') END AS s FROM orders)")
def fn_pdf_date(spark, d):
    s = F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.lit("D:")).otherwise(F.lit("")), F.when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "yyyyMM")).otherwise(F.date_format("o_orderdate", "yyyyMMdd")))
    return table(spark, d, "orders").select("o_orderkey", text.pdf_date(s).alias("day"))


_DOI_TEXT = "CASE doc_id % 4 WHEN 0 THEN text || ' doi: 10.1234/a' || doc_id || '.,' WHEN 1 THEN text || ' DOI:10.99/x see https://doi.org/10.5555/b' || doc_id || '; end' WHEN 2 THEN text || ' dx.doi.org/10.12/no' ELSE text END"


@query(f"SELECT doc_id, regexp_replace(coalesce(nullif(regexp_extract(t, '{text.DOI_URL}', 1), ''), nullif(regexp_extract(t, '{text.DOI_MARK}', 1), '')), '[.,;:]+$', '') AS doi FROM (SELECT doc_id, {_DOI_TEXT} AS t FROM documents)")
def fn_doi(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.expr(_DOI_TEXT.replace("|| doc_id", "|| cast(doc_id as string)")).alias("t"))
    return docs.select("doc_id", text.doi(F.col("t")).alias("doi"))


@query(f"SELECT doc_id, CASE WHEN text IS NULL OR {STRIP.format('text')} = '' THEN false ELSE (length(text) - length(replace(text, chr(65533), '')))::DOUBLE / length(text) > 0.3 END AS garbled FROM documents")
def fn_garbled(spark, d):
    return table(spark, d, "documents").select("doc_id", text.is_garbled(F.col("text")).alias("garbled"))


@query("SELECT doc_id, CASE WHEN length(title) > 20 THEN substr(title, 1, 20) || '...' ELSE title END AS short, CASE WHEN length(title) > 50 THEN substr(title, 1, 47) || '...' ELSE title END AS described FROM documents")
def fn_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncate(F.col("title"), 20).alias("short"), text.describe_model(F.col("title")).alias("described"))


@query(f"SELECT symbol_id, concat_ws(chr(10), concat_ws(' ', nullif(visibility, ''), symbol_type || ': ' || qualified_name), nullif(signature, ''), nullif(docstring, '')) AS context FROM symbols")
def fn_symbol_context(spark, d):
    s = table(spark, d, "symbols")
    return s.select("symbol_id", text.symbol_context(F.struct(*s.columns)).alias("context"))


# -- chunking --------------------------------------------------------------------------------------------
def _windows(t: str, size: int, step: int) -> str:
    n = f"least(ceil(length({t}) / {step}.0), greatest(ceil((length({t}) - {size}) / {step}.0), 0) + 1)::BIGINT"
    return f"CASE WHEN length({t}) <= {size} THEN [{t}] ELSE list_transform(range({n}), lambda i: substr({t}, (i * {step} + 1)::BIGINT, {size})) END"


@query(f"SELECT doc_id, unnest(CASE WHEN text IS NULL OR {STRIP.format('text')} = '' THEN [] ELSE {_windows('text', 300, 250)} END) AS chunk FROM documents")
def chunk_fixed(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(text.fixed_chunks(F.col("text"), 300, 50)).alias("chunk"))


@query(f"SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> '')) AS paragraph FROM documents")
def chunk_paragraphs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(text.paragraphs(F.col("text"))).alias("paragraph"))


@query(f"SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0b\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {STRIP.format('x')}), lambda x: x <> '')) AS sentence FROM documents")
def chunk_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(text.sentences(F.col("text"))).alias("sentence"))


_HEAD = "symbol_type || ': ' || qualified_name || coalesce(chr(10) || nullif(signature, ''), '') || coalesce(chr(10) || chr(10) || 'Documentation:' || chr(10) || nullif(docstring, ''), '')"


@query(f"""
    SELECT symbol_id, unnest(CASE WHEN length(prefix || body) <= 400 THEN [prefix || body]
        WHEN length(prefix) < 400 THEN list_concat([prefix || substr(body, 1, 400 - length(prefix))], CASE WHEN rest = '' THEN [] ELSE {_windows('rest', 400, 350)} END)
        ELSE list_concat({_windows('head', 400, 350)}, CASE WHEN body = '' THEN [] ELSE {_windows('body', 400, 350)} END) END) AS chunk
    FROM (SELECT *, substr(body, 401 - length(prefix)) AS rest FROM (SELECT symbol_id, head, head || chr(10) || chr(10) || 'Source:' || chr(10) AS prefix, body FROM (SELECT symbol_id, {_HEAD} AS head, coalesce(content, '') AS body FROM symbols)))
""")
def chunk_code(spark, d):
    s = table(spark, d, "symbols")
    return s.select("symbol_id", F.explode(text.code_chunks(F.struct(*s.columns), 400, 50)).alias("chunk"))


def _recursive_sql(size: int, overlap: int) -> str:
    """The recursive splitter as nested SQL folds over the parts at each separator."""

    def level(x: str, separators: list[str]) -> str:
        if not separators:
            return f"list_transform(range((length({x}) + {size - 1}) // {size}), lambda k: substr({x}, (k * {size} + 1)::BIGINT, {size}))"
        n = len(separators)
        a, p = f"a{n}", f"p{n}"
        longer = f"CASE WHEN {a}.held <> '' THEN {a}.held || {separators[0]} || {p}.held ELSE {p}.held END"
        flushed = f"CASE WHEN {a}.held <> '' THEN list_append({a}.done, {a}.held) ELSE {a}.done END"
        step = (
            f"CASE WHEN length({longer}) <= {size} THEN {{'done': {a}.done, 'held': {longer}}}"
            f" WHEN length({p}.held) > {size} THEN {{'done': list_concat({flushed}, {level(p + '.held', separators[1:])}), 'held': ''}}"
            f" ELSE {{'done': {flushed}, 'held': {p}.held}} END"
        )
        parts = f"list_prepend({{'done': []::VARCHAR[], 'held': ''}}, list_transform(string_split({x}, {separators[0]}), lambda s{n}: {{'done': []::VARCHAR[], 'held': s{n}}}))"
        end = f"list_reduce({parts}, lambda {a}, {p}: {step})"
        return f"list_transform([{end}], lambda e{n}: CASE WHEN e{n}.held <> '' THEN list_append(e{n}.done, e{n}.held) ELSE e{n}.done END)[1]"

    body = level("text", ["chr(10) || chr(10)", "chr(10)", "'. '", "' '"])
    lag = f"CASE WHEN i = 1 THEN c[i] ELSE substr(right(c[i - 1], {overlap}) || c[i], 1, {size}) END" if overlap else "c[i]"
    return f"""
        SELECT doc_id, (i - 1)::INT AS i, {lag} AS chunk FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM (
            SELECT doc_id, CASE WHEN text IS NULL OR {STRIP.format('text')} = '' THEN [] WHEN length(text) <= {size} THEN [text] ELSE {body} END AS c FROM documents))
    """


@query(_recursive_sql(512, 50))
def chunk_recursive(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunkers.chunk(F.col("text"), "recursive", chunk_size=512, overlap=50)).alias("i", "chunk"))


@query(_recursive_sql(512, 50))
def chunk_recursive_native(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.recursive_chunks(F.col("text"), 512, 50)).alias("i", "chunk"))


@query()
def chunk_markdown(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunkers.chunk(F.col("text"), "markdown")).alias("i", "chunk"))


#: what no splitter may lose: everything but blanks and full stops, which stand at the cuts
_SOLID = r"regexp_replace({0}, '[\s\x0b\x1c-\x1f\x85\p{Z}.]+', '', 'g')"


def _solid(c):
    return F.regexp_replace(c, r"[\s\x0b\x1c-\x1f\x85\p{Z}.]+", "")


@query(f"SELECT doc_id, {_SOLID.replace('{0}', 'text')} AS body FROM documents WHERE text IS NOT NULL AND {STRIP.format('text')} <> ''")
def chunk_markdown_text(spark, d):
    """The chunks of a text, without the context lines of split sections, hold the text in order."""
    chunks = F.transform(chunkers.chunk(F.col("text"), "markdown", chunk_size=700, overlap=0), lambda c: F.regexp_replace(c, r"(?s)\A\[Context: [^\n]*\]\n\n", ""))
    return table(spark, d, "documents").withColumn("c", chunks).where(F.size("c") > 0).select("doc_id", _solid(F.array_join("c", " ")).alias("body"))


@query(f"SELECT doc_id, {_SOLID.replace('{0}', 'text')} AS body FROM documents WHERE text IS NOT NULL AND {STRIP.format('text')} <> ''")
def chunk_semantic_text(spark, d):
    """The chunks of a text hold the text in order."""
    chunks = chunkers.chunk(F.col("text"), "semantic", chunk_size=400)
    return table(spark, d, "documents").withColumn("c", chunks).where(F.size("c") > 0).select("doc_id", _solid(F.array_join("c", " ")).alias("body"))


@query()
def chunk_html(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunkers.chunk(F.col("text"), "html")).alias("i", "chunk"))


@query()
def chunk_semantic(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunkers.chunk(F.col("text"), "semantic", chunk_size=400)).alias("i", "chunk"))


@query()
def chunk_auto(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(chunkers.chunk(F.col("text"), chunkers.preferred_strategy(F.coalesce("extension", F.lit(""))), chunk_size=1536, overlap=200)).alias("i", "chunk"))


@query(f"SELECT symbol_id, symbol_type || ': ' || qualified_name || chr(10) || coalesce(nullif(signature, '') || chr(10), '') || coalesce(chr(10) || nullif(docstring, ''), '') AS chunk FROM symbols")
def chunk_symbol_text(spark, d):
    s = table(spark, d, "symbols")
    return s.select("symbol_id", text.symbol_text(F.struct(*s.columns)).alias("chunk"))


# -- payloads ----------------------------------------------------------------------------------------------
_CHUNKS = f"SELECT doc_id, source_path, title, extension, c, generate_subscripts(c, 1) - 1 AS i FROM (SELECT *, CASE WHEN text IS NULL OR {STRIP.format('text')} = '' THEN [] ELSE {_windows('text', 1536, 1486)} END AS c FROM documents) WHERE len(c) > 0"


@query(f"SELECT {IDSQL.format("source_path || '-' || i")} AS id, c[i + 1] AS document, coalesce(CASE WHEN doc_id % 7 = 0 THEN 'front' END, source_path) AS source, i::VARCHAR AS chunk_index, len(c)::VARCHAR AS total_chunks, title FROM ({_CHUNKS})")
def payload_text(spark, d):
    docs = table(spark, d, "documents").withColumn("chunks", text.fixed_chunks(F.col("text"), 1536, 50))
    rows = payloads.with_point_ids(payloads.explode_chunks(docs.select("doc_id", "source_path", "title", "extension", "chunks")), "source_path")
    own = F.map_concat(F.create_map(F.lit("title"), F.col("title"), F.lit("symbols"), F.lit("x")), F.when(F.col("doc_id") % 7 == 0, F.create_map(F.lit("source"), F.lit("front"))).otherwise(F.create_map().cast("map<string,string>")))
    meta = payloads.base_metadata(F.col("source_path"), F.lit("2024-01-01T00:00:00"), own, F.col("chunk_index"), F.col("total_chunks"))
    return rows.select("id", payloads.text_payload(F.col("chunk"), meta).alias("p")).select("id", "p.document", *[F.col("p.metadata")[k].alias(k) for k in ("source", "chunk_index", "total_chunks", "title")])


@query("SELECT symbol_id, content AS document, name AS symbol_name, coalesce(signature, '') AS signature, coalesce(docstring, '') AS docstring, line_start::VARCHAR AS line_start, coalesce(parent, '') AS parent_class, coalesce(visibility, '') AS visibility FROM symbols")
def payload_code(spark, d):
    s = table(spark, d, "symbols")
    meta = payloads.base_metadata(F.col("source"), F.lit("now"), F.create_map().cast("map<string,string>"), F.lit(0), F.lit(1))
    p = s.select("symbol_id", payloads.code_payload(F.col("content"), meta, F.struct(*s.columns)).alias("p"))
    return p.select("symbol_id", "p.document", *[F.col("p.metadata")[k].alias(k) for k in ("symbol_name", "signature", "docstring", "line_start", "parent_class", "visibility")])


@query("SELECT image_id, concat_ws(' ', nullif(caption, ''), nullif(surrounding_text, '')) AS document, 'image' AS content_type, page_number::VARCHAR AS page_number, width::VARCHAR AS width, coalesce(caption, '') AS caption, coalesce(image_hash, '') AS image_hash FROM images")
def payload_image(spark, d):
    i = table(spark, d, "images")
    meta = payloads.base_metadata(F.col("source"), F.lit("now"), F.create_map().cast("map<string,string>"))
    p = i.select("image_id", payloads.image_payload(F.struct(*[c for c in i.columns if c != "image_data"]), meta, F.col("ord"), F.lit(1)).alias("p"))
    return p.select("image_id", "p.document", *[F.col("p.metadata")[k].alias(k) for k in ("content_type", "page_number", "width", "caption", "image_hash")])


# -- images ------------------------------------------------------------------------------------------------
@query("SELECT image_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source, h ORDER BY page_number, ord, image_id) AS rn FROM (SELECT *, coalesce(nullif(image_hash, ''), md5(image_data)) AS h FROM images WHERE width >= 100 AND height >= 100) WHERE h IS NOT NULL) WHERE rn = 1")
def images_scan(spark, d):
    return im.scan_images(table(spark, d, "images")).select("image_id", "source")


@query(r"SELECT image_id, regexp_full_match(" + STRIP.format("caption") + r", '(?is)(Figure|Fig\.?|Table|Plate|Image|Photo|Diagram|Chart|Graph|Illustration)\s*(\d+(?:\.\d+)?)\s*[:.\-—–]?\s*.*') AS is_caption FROM images")
def images_captions(spark, d):
    return table(spark, d, "images").select("image_id", im.is_caption(F.col("caption")).alias("is_caption"))


_BOX = "struct_extract(bbox, '{0}')"


@query("""
    WITH b AS (
        SELECT source, page_number AS page, 2 * ord AS block, bbox.x0 AS x0, bbox.y1 + 4 AS y0, bbox.x1 AS x1, bbox.y1 + 20 AS y1, caption AS t FROM images
        UNION ALL SELECT source, page_number, 2 * ord + 1, bbox.x0, bbox.y0 - 30, bbox.x1, bbox.y0 - 2, surrounding_text FROM images
    ), n AS (
        SELECT i.image_id, b.block, {strip} AS t,
            (b.x0 < least(612.0, i.bbox.x1 + 50) AND b.x1 > greatest(0.0, i.bbox.x0 - 50) AND b.y0 < least(792.0, i.bbox.y1 + 50) AND b.y1 > greatest(0.0, i.bbox.y0 - 50)) AS near,
            (b.x0 < least(612.0, i.bbox.x1 + 20) AND b.x1 > greatest(0.0, i.bbox.x0 - 20) AND b.y0 < least(792.0, i.bbox.y1 + 50) AND b.y1 > i.bbox.y1
                AND regexp_full_match({strip}, '(?is)(Figure|Fig\\.?|Table|Plate|Image|Photo|Diagram|Chart|Graph|Illustration)\\s*(\\d+(?:\\.\\d+)?)\\s*[:.\\-—–]?\\s*.*')) AS cap
        FROM images i JOIN b ON i.source = b.source AND i.page_number = b.page WHERE {strip} <> ''
    ), g AS (SELECT image_id, string_agg(CASE WHEN near THEN t END, ' ' ORDER BY block, t) AS s, min_by(t, block) FILTER (WHERE cap) AS c FROM n GROUP BY image_id)
    SELECT i.image_id, CASE WHEN length(s) > 500 THEN substr(s, 1, 500) || '...' ELSE s END AS surrounding_text, CASE WHEN length(c) > 300 THEN substr(c, 1, 300) || '...' ELSE c END AS caption
    FROM images i LEFT JOIN g ON i.image_id = g.image_id
""".replace("{strip}", STRIP.format("b.t")))
def images_context(spark, d):
    i = table(spark, d, "images")
    box = lambda y0, y1: F.struct(F.col("bbox.x0").alias("x0"), y0.alias("y0"), F.col("bbox.x1").alias("x1"), y1.alias("y1"))
    page = (F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"))
    below = i.select("source", F.col("page_number").alias("page"), (2 * F.col("ord")).alias("block"), box(F.col("bbox.y1") + 4, F.col("bbox.y1") + 20).alias("bbox"), F.col("caption").alias("text"), *page)
    above = i.select("source", F.col("page_number").alias("page"), (2 * F.col("ord") + 1).alias("block"), box(F.col("bbox.y0") - 30, F.col("bbox.y0") - 2).alias("bbox"), F.col("surrounding_text").alias("text"), *page)
    return im.text_context(i, below.unionByName(above))


# -- sync --------------------------------------------------------------------------------------------------
_CURRENT = "SELECT source_path AS path, modified_time AS mtime, content_hash AS hash FROM (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY modified_time DESC NULLS LAST, received_at DESC NULLS LAST, obs_id DESC) AS rn FROM scan_log WHERE content_hash IS NOT NULL AND source_path IS NOT NULL) WHERE rn = 1"
_STATE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY run_id DESC, mtime DESC NULLS LAST, content_hash DESC NULLS LAST) AS rn FROM file_state) WHERE rn = 1"
_CLASSES = f"""
    SELECT coalesce(f.path, s.path) AS path, f.hash, s.content_hash AS old_hash, list_concat(coalesce(s.chunk_ids, []), coalesce(s.image_ids, [])) AS old_ids, f.mtime, f.path IS NOT NULL AND s.path IS NOT NULL AND (s.mtime IS NULL OR s.mtime <> f.mtime) AS moved,
        CASE WHEN f.path IS NULL THEN 'deleted' WHEN s.path IS NULL THEN 'new' WHEN (s.mtime IS NULL OR s.mtime <> f.mtime) AND f.hash IS DISTINCT FROM s.content_hash THEN 'modified' ELSE 'unchanged' END AS status
    FROM ({_CURRENT}) f FULL JOIN ({_STATE}) s ON f.path = s.path
"""


def _classified(spark, d):
    rank = F.struct("modified_time", "received_at", "obs_id")
    files = table(spark, d, "scan_log").where("content_hash IS NOT NULL AND source_path IS NOT NULL").groupBy(F.col("source_path").alias("path")).agg(F.max_by("modified_time", rank).alias("mtime"), F.max_by("content_hash", rank).alias("hash"))
    return sync.classify(files, sync.latest_state(table(spark, d, "file_state")))


@query(f"SELECT path, status, coalesce(status = 'unchanged' AND moved, false) AS touched FROM ({_CLASSES})")
def sync_classify(spark, d):
    return _classified(spark, d).select("path", "status", F.coalesce("touched", F.lit(False)).alias("touched"))


@query(f"""
    SELECT count(*) FILTER (WHERE status = 'new' AND NOT bad) AS added, count(*) FILTER (WHERE status = 'modified' AND NOT bad) AS updated, count(*) FILTER (WHERE status = 'deleted') AS deleted,
        count(*) FILTER (WHERE status = 'unchanged') AS unchanged, coalesce(list(path ORDER BY path) FILTER (WHERE bad), []) AS failed
    FROM (SELECT path, status, path IN (SELECT source_path FROM documents WHERE error IS NOT NULL) AS bad FROM ({_CLASSES}))
""")
def sync_counts(spark, d):
    failed = table(spark, d, "documents").where("error IS NOT NULL").select(F.col("source_path").alias("path"))
    return sync.sync_summary(_classified(spark, d), failed)


@query(f"SELECT status, count(*) AS files FROM ({_CLASSES}) GROUP BY status")
def sync_status(spark, d):
    return sync.status_report(_classified(spark, d))


@query(f"SELECT path, status FROM ({_CLASSES}) WHERE status IN ('new', 'modified') ORDER BY path LIMIT 5")
def sync_pending(spark, d):
    return sync.pending(_classified(spark, d))


@query(f"SELECT DISTINCT unnest(old_ids) AS id FROM ({_CLASSES}) WHERE status IN ('modified', 'deleted')")
def sync_stale_points(spark, d):
    return sync.stale_points(_classified(spark, d))


@query("SELECT max(indexed_at) AS last_indexed, count(*) AS tracked, sum(chunk_count)::BIGINT AS chunks FROM file_state")
def sync_last_indexed(spark, d):
    return sync.last_indexed(table(spark, d, "file_state"))


@query("SELECT count(*) AS entries, sum(len(chunk_ids) + coalesce(len(image_ids), 0))::BIGINT AS points FROM file_state")
def sync_clean_counts(spark, d):
    return sync.clean_counts(table(spark, d, "file_state"))


@query(f"SELECT path, status FROM (SELECT path, 'tracked only' AS status FROM ({_STATE}) WHERE path NOT IN (SELECT path FROM ({_CURRENT})))")
def sync_tracked_only(spark, d):
    state, now = sync.latest_state(table(spark, d, "file_state")), merkle.current_records(table(spark, d, "scan_log"))
    return state.join(now.select(F.col("key").alias("path")), "path", "left_anti").select("path", F.lit("tracked only").alias("status"))


@query(f"SELECT count(DISTINCT source_path) AS total_files, count(*) AS total_chunks, coalesce((SELECT list(DISTINCT source_path ORDER BY source_path) FROM documents WHERE error IS NOT NULL), []) AS failed_files, 7 AS skipped_files FROM ({_CHUNKS})")
def index_totals(spark, d):
    docs = table(spark, d, "documents").select(F.col("source_path").alias("source"), text.fixed_chunks(F.col("text"), 1536, 50).alias("chunks"))
    failed = table(spark, d, "documents").where("error IS NOT NULL").select(F.col("source_path").alias("source"))
    return sync.index_summary(payloads.explode_chunks(docs), failed, 7)


@query(f"SELECT source_path AS source, list({IDSQL.format("source_path || '-' || i")} ORDER BY i) AS chunk_ids FROM ({_CHUNKS}) GROUP BY source_path")
def index_chunk_ids(spark, d):
    docs = table(spark, d, "documents").select(F.col("source_path").alias("source"), text.fixed_chunks(F.col("text"), 1536, 50).alias("chunks"))
    rows = payloads.with_point_ids(payloads.explode_chunks(docs))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "id"))), lambda x: x["id"])
    return rows.groupBy("source").agg(ids.alias("chunk_ids"))


@query()
def index_code(spark, d):
    """All source files loaded, chunked by symbol, embedded and put into a fresh collection; its points."""
    engine = Engine(spark, f"{shared_dir(spark)}/kelpline/{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}", "code")
    engine.store.ensure("code", {engine.vector: engine.size})
    engine.store.upsert("code", materialize(engine.points(engine.chunks(loaders.load(table(spark, d, "source_files"))), "2024-01-01T00:00:00"), "points"))
    points = engine.store.read("code")
    return points.select("id", "document", F.col("metadata")["source"].alias("source"), F.size(F.col("vectors")[engine.vector]).alias("size"))


# -- collections -------------------------------------------------------------------------------------------
@query("SELECT id, document, vector_name FROM (SELECT id, min(document) AS document, min(vector_name) AS vector_name FROM points WHERE id % 3 <> 0 GROUP BY id) UNION ALL SELECT id, 'new' AS document, max(vector_name) AS vector_name FROM points WHERE id % 3 = 0 GROUP BY id")
def store_upsert(spark, d):
    p = table(spark, d, "points").groupBy("id").agg(F.min("document").alias("document"), F.min("vector_name").alias("vector_name"))
    fresh = table(spark, d, "points").where("id % 3 = 0").select("id", F.lit("new").alias("document"), "vector_name")
    return store.upsert(p, fresh)


@query("SELECT id, document FROM points WHERE id % 5 <> 0")
def store_delete_ids(spark, d):
    p = table(spark, d, "points")
    return store.delete_by_ids(p, p.where("id % 5 = 0").select("id")).select("id", "document")


@query("SELECT id, metadata.source AS source FROM points WHERE metadata.source IS DISTINCT FROM (SELECT min(metadata.source) FROM points)")
def store_delete_source(spark, d):
    p = table(spark, d, "points").select("id", "metadata")
    first = p.agg(F.min("metadata.source")).first()[0]
    return store.delete_by_source(p, first).select("id", F.col("metadata.source").alias("source"))


@query("SELECT vector_name AS name, count(*) AS points_count FROM points GROUP BY vector_name")
def store_counts(spark, d):
    return table(spark, d, "points").groupBy(F.col("vector_name").alias("name")).agg(F.count(F.lit(1)).alias("points_count"))


_COS = "list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[])"


@query(f"SELECT e.vec_id AS id, round({_COS.format('e.embedding', 'q.embedding')}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY {_COS.format('e.embedding', 'q.embedding')} DESC, e.vec_id LIMIT 5")
def search_top_k(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return store.top_k(e, list(e.orderBy("id").first()["vector"]), 5).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round({_COS.format('embedding', 'nxt')}, 6) AS similarity FROM (SELECT vec_id, embedding, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings)")
def window_adjacent_similarity(spark, d):
    w = Window.partitionBy("label").orderBy("vec_id")
    e = table(spark, d, "embeddings").withColumn("nxt", F.lead("embedding").over(w))
    return e.select("vec_id", F.round(text.cosine(F.col("embedding"), F.col("nxt")), 6).alias("similarity"))


@query("SELECT event_id, user_id, (sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut FROM events)")
def window_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL 30 MINUTES")
    e = table(spark, d, "events").withColumn("cut", F.when(gap, 1).otherwise(0))
    return e.select("event_id", "user_id", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("session"))


@query("SELECT DISTINCT path FROM (SELECT source_path AS path FROM documents UNION SELECT source AS path FROM source_files UNION SELECT path FROM file_state)")
def set_union_paths(spark, d):
    a, b, c = table(spark, d, "documents").select(F.col("source_path").alias("path")), table(spark, d, "source_files").select(F.col("source").alias("path")), table(spark, d, "file_state").select("path")
    return a.unionByName(b).unionByName(c).distinct()


# -- streaming ---------------------------------------------------------------------------------------------
@query(f"SELECT path, hash FROM ({_CURRENT})")
def stream_current_files(spark, d):
    return streams.current_files(spark, d)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_hourly_events(spark, d):
    return streams.hourly_events(spark, d)


# -- embedding ---------------------------------------------------------------------------------------------
@query("SELECT doc_id, text IS NOT NULL AS has_vector, CASE WHEN text IS NOT NULL THEN 64 END AS size FROM documents")
def embed_documents(spark, d):
    e = table(spark, d, "documents").select("doc_id", embed.embed(F.col("text")).alias("v"))
    return e.select("doc_id", F.col("v").isNotNull().alias("has_vector"), F.when(F.col("v").isNotNull(), F.size("v")).alias("size"))
