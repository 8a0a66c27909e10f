"""Text and chunk queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking
from ..sources import files, web
from ..sources.tables import table


def text_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """Collapsed, search and extraction forms."""
    x = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.md5(T.collapse_space(x)).alias("collapsed"), F.md5(T.search_form(x)).alias("search"), F.md5(T.extract_space(x)).alias("extracted"))


def text_nfc_clean(spark: SparkSession, sf: str) -> DataFrame:
    """NFC of decomposed texts equals the composed ones, then cleaned of page markers."""
    x = F.concat(F.lit("--- Trang 7 ---\n"), F.coalesce("text", F.lit("")), F.lit("\n--- [batch 2] ---\né"))
    return table(spark, sf, "documents").select("doc_id", F.md5(T.clean(x)).alias("cleaned"))


def text_tokens(spark: SparkSession, sf: str) -> DataFrame:
    x = F.coalesce("text", F.lit(""))
    t = T.tokens(x)
    return table(spark, sf, "documents").select(
        "doc_id", F.size(t).cast("long").alias("n_terms"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), T.count_tokens(x).cast("long").alias("n_tokens"), T.estimate_tokens(x).alias("n_estimated"),
        F.array_join(T.numbers(x), " ").alias("numbers"), T.preview(x, 40).alias("preview"),
    )


def page_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches of a scanned document: page numbers become absolute."""
    x = F.concat(F.lit("--- [batch trang 1-15/30] ---\n--- Trang 1 ---\nA\n--- [batch trang 16-30/30] ---\n--- Trang 1 ---\nB\n--- Trang 2 ---\n"), F.coalesce("text", F.lit("")))
    tagged = T.tag_pages(x)
    return table(spark, sf, "documents").select("doc_id", T.page_range(tagged)["page_start"].alias("page_start"), T.page_range(tagged)["page_end"].alias("page_end"), F.md5(T.strip_page_tags(tagged)).alias("text_md5"))


def text_sentences(spark: SparkSession, sf: str) -> DataFrame:
    s = T.sentences(F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.array_max(F.transform(s, lambda x: F.length(x))).cast("long").alias("longest"))


def chunks_fixed(spark: SparkSession, sf: str) -> DataFrame:
    c = chunking.chunk(table(spark, sf, "documents"), "doc_id", "fixed")
    return c.select("doc_id", "chunk_index", F.md5("text").alias("text_md5"), F.col("token_count").cast("long").alias("token_count"))


def chunks_structure(spark: SparkSession, sf: str) -> DataFrame:
    c = chunking.chunk(table(spark, sf, "documents"), "doc_id", "structure_aware")
    return c.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("token_count").alias("largest"), F.sum("token_count").alias("tokens"))


def chunks_recursive(spark: SparkSession, sf: str) -> DataFrame:
    c = chunking.chunk(table(spark, sf, "documents"), "doc_id", "recursive")
    return c.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("token_count").alias("largest"), F.sum("token_count").alias("tokens"))


def chunks_parent_child(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as the first clause of an article; another article follows."""
    t = F.coalesce("text", F.lit(""))
    body = F.concat(F.lit("Chương I\nChung\nĐiều 1. Một\n1. "), t, F.lit("\n2. b c\nĐiều 2. Hai\n1. d\n"))
    c = chunking.chunk(table(spark, sf, "documents").select("doc_id", body.alias("text")), "doc_id", "parent_child")
    return c.select("doc_id", "chunk_index", "section", "heading", "parent_index", F.md5("text").alias("text_md5"), F.col("token_count").cast("long").alias("token_count"))


def chunk_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """Pages carried forward over fixed chunks: the first chunk of every document has a page tag."""
    c = chunking.chunk(table(spark, sf, "documents"), "doc_id", "fixed")
    tagged = c.withColumn("text", F.when(F.col("chunk_index") == 0, F.concat(F.lit("[PG:3] x [PG:4] "), F.col("text"))).otherwise(F.col("text")))
    return chunking.assemble(tagged, "doc_id", "fixed").select("chunk_id", "parent_chunk_id", "page_start", "page_end", F.col("token_count").cast("long").alias("token_count"))


def page_text(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", web.html_text(F.col("html")).alias("x"))
    return p.select("page_id", "x.title", F.length("x.text").alias("n_chars"))


def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles by pattern, a cheaper form for pages that are well formed."""
    title = F.trim(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>([^<]*)</title>", 1))
    return table(spark, sf, "pages").select("page_id", title.alias("title"))


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links to files; each page gets two of its own so that there are some."""
    more = F.concat(F.coalesce("html", F.lit("")), F.lit('<a href="/qd-12/quy-che.PDF">a</a><a href=\'files/mau-12.docx\'>b</a>'))
    return web.file_links(table(spark, sf, "pages").withColumn("html", more))


def link_slugs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


def page_urls(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    link = lambda x: web.absolute(x, u)
    return table(spark, sf, "pages").select(
        "page_id", link(F.lit("a/b.pdf")).alias("relative"), link(F.lit("/c.doc")).alias("root"), link(u).alias("whole"), web.file_kind(u).alias("kind"),
        web.extension(F.lit("application/pdf"), u).alias("extension"), web.extension(F.lit("application/msword"), u).alias("by_url"),
    )


def point_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", files.point_id(F.format_string("chunk_%d", "doc_id")).cast("string").alias("point_id"))


def ocr_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Page batches of documents at 200 characters a page, and which need OCR."""
    pages = F.ceil(F.col("n_chars") / 200).cast("int")
    d = table(spark, sf, "documents").select("doc_id", files.needs_ocr(F.col("n_chars") / pages).alias("needs_ocr"), F.explode(files.ocr_batches(F.greatest(pages, F.lit(1)))).alias("b"))
    return d.select("doc_id", "needs_ocr", "b.first", "b.last")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\s]+')"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_COLLAPSE = _STRIP.format(r"regexp_replace(regexp_replace(regexp_replace({}, '[ \t\x{{00A0}}]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")
_EXTRACTED = r"regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
_FIXED = f"SELECT doc_id, i AS chunk_index, ws[i * 250 + 1:i * 250 + 300] AS own FROM (SELECT doc_id, ws, unnest(range(CASE WHEN len(ws) > 300 THEN ((len(ws) - 300 + 249) // 250)::BIGINT ELSE 0 END + 1))::INT AS i FROM (SELECT doc_id, {_WORDS} AS ws FROM documents) WHERE len(ws) > 0)"
_KIND = "CASE WHEN regexp_matches(lower({0}), 'quyet-dinh|qd-|quy-che|quy-dinh|thong-tu|nghi-dinh') THEN 'decision' WHEN regexp_matches(lower({0}), 'don-|mau-|bieu-mau|-don|mau12|mau-12') THEN 'form' ELSE 'unknown' END"
QUERIES = {f.__name__: f for f in (
    text_normalise, text_nfc_clean, text_tokens, page_tags, text_sentences, chunks_fixed, chunks_structure, chunks_recursive, chunks_parent_child, chunk_assembly,
    page_text, page_titles, page_links, link_slugs, page_urls, point_ids, ocr_plan,
)}
SQL = {
    "text_normalise": f"SELECT doc_id, md5({_COLLAPSE.format('coalesce(text, $$$$)')}) AS collapsed, md5({_COLLAPSE.format('lower(nfc_normalize(coalesce(text, $$$$)))')}) AS search, md5({_STRIP.format(_EXTRACTED)}) AS extracted FROM documents",
    "text_nfc_clean": f"SELECT doc_id, md5({_COLLAPSE.format('chr(10) || nfc_normalize(coalesce(text, $$$$)) || chr(10) || chr(10) || chr(233)')}) AS cleaned FROM documents",
    "text_tokens": rf"""SELECT doc_id, len(t) AS n_terms, len(list_distinct(t)) AS n_distinct, len({_WORDS}) AS n_tokens, length(coalesce(text, '')) // 4 AS n_estimated,
coalesce((SELECT string_agg(x, ' ' ORDER BY p) FROM (SELECT x, min(p) AS p FROM (SELECT unnest(nums) AS x, unnest(range(len(nums))) AS p) GROUP BY x)), '') AS numbers, substr(coalesce(text, ''), 1, 40) AS preview
FROM (SELECT *, regexp_extract_all(lower(nfc_normalize(coalesce(text, ''))), '[\p{{L}}\p{{N}}_]+') AS t, list_transform(regexp_extract_all(coalesce(text, ''), '[0-9][0-9.,]*[0-9]|[0-9]'), lambda n: trim(n, '.,')) AS nums FROM documents)""",
    "page_tags": "SELECT doc_id, 1::INT AS page_start, 17::INT AS page_end, md5(concat(chr(10), chr(10), 'A', chr(10), chr(10), chr(10), 'B', chr(10), chr(10), coalesce(text, ''))) AS text_md5 FROM documents",
    "chunks_fixed": f"SELECT doc_id, chunk_index, md5(array_to_string(own, ' ')) AS text_md5, len(own) AS token_count FROM ({_FIXED})",
    "chunk_assembly": f"SELECT format('chunk_{{}}_fixed_{{:04d}}', doc_id, chunk_index) AS chunk_id, NULL::VARCHAR AS parent_chunk_id, CASE WHEN chunk_index = 0 THEN 3 ELSE 4 END::INT AS page_start, 4::INT AS page_end, len(own) + CASE WHEN chunk_index = 0 THEN 1 ELSE 0 END AS token_count FROM ({_FIXED})",
    "page_titles": r"SELECT page_id, trim(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>([^<]*)</title>', 1)) AS title FROM pages",
    "page_links": rf"""WITH l AS (SELECT page_id, array_to_string(string_split(url, '/')[1:3], '/') AS origin, unnest(list_distinct(regexp_extract_all(coalesce(html, '') || '<a href="/qd-12/quy-che.PDF">a</a><a href=''files/mau-12.docx''>b</a>', '(?i)href=["'']([^"'']+\.(?:pdf|docx?|xlsx?))["'']', 1))) AS link FROM pages),
u AS (SELECT page_id, link, CASE WHEN starts_with(link, 'http') THEN link WHEN starts_with(link, '/') THEN origin || link ELSE origin || '/' || link END AS url FROM l)
SELECT page_id, link, url, {_KIND.format('link')} AS kind, lower(regexp_extract(url, '\.([A-Za-z]+)$', 1)) AS extension FROM u""",
    "page_urls": rf"""SELECT page_id, origin || '/a/b.pdf' AS relative, origin || '/c.doc' AS root, url AS whole, {_KIND.format('url')} AS kind, 'pdf' AS extension,
CASE WHEN ends_with(lower(url), '.pdf') THEN 'pdf' WHEN ends_with(lower(url), '.docx') THEN 'docx' WHEN ends_with(lower(url), '.doc') THEN 'doc' WHEN ends_with(lower(url), '.xlsx') THEN 'xlsx' WHEN ends_with(lower(url), '.xls') THEN 'xls' ELSE 'html' END AS by_url
FROM (SELECT *, array_to_string(string_split(url, '/')[1:3], '/') AS origin FROM pages)""",
    "text_sentences": rf"""WITH s AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?;])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS p FROM documents)
SELECT doc_id, greatest(len(p), 1)::BIGINT AS n_sentences, CASE WHEN len(p) = 0 THEN length(t) ELSE list_max(list_transform(p, lambda x: length(x))) END::BIGINT AS longest FROM s""",
    "link_slugs": r"SELECT page_id, coalesce(nullif(substr(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80), ''), 'file') AS slug FROM pages WHERE url IS NULL OR NOT regexp_matches(url, '[^\x00-\x7F]') UNION ALL SELECT page_id, NULL FROM pages WHERE FALSE",
    "point_ids": "SELECT doc_id, (('0x' || substr(sha256('chunk_' || doc_id), 1, 16))::UBIGINT)::VARCHAR AS point_id FROM documents",
    "ocr_plan": "WITH p AS (SELECT doc_id, n_chars, ceil(n_chars / 200)::INT AS n FROM documents) SELECT doc_id, n_chars / n < 40 AS needs_ocr, s::INT AS first, least(s + 14, greatest(n, 1))::INT AS last FROM (SELECT *, unnest(range(1, greatest(n, 1) + 1, 15)) AS s FROM p)",
}
