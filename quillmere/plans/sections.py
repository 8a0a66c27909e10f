"""Chunk and section queries whose greedy packing SQL expresses by recursion over numbered pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sections
from ..operators.policy import MAX_CHARS
from ..sources.tables import table


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as regulations: every seventh sentence heads an article, the others are its clauses, and every third article begins a chapter."""
    line = lambda s, i: (
        F.when(i % 21 == 7, F.concat(F.lit("Chương X"), F.repeat(F.lit("I"), (i / 21).cast("int")), F.lit("\n\n  Phần "), i.cast("string"), F.lit("\nĐiều "), i.cast("string"), F.lit(". "), s))
        .when(i % 7 == 0, F.concat(F.lit("Điều "), i.cast("string"), F.lit(". "), s)).otherwise(F.concat((i % 7).cast("string"), F.lit(". "), s))
    )
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), r"\. "), line), "\n").alias("text"))


def sections_parent_child(spark: SparkSession, sf: str) -> DataFrame:
    c = sections.parent_child(_numbered(spark, sf), "doc_id")
    return c.select("doc_id", "chunk_index", "section", "heading", "parent_index", F.md5("text").alias("text_md5"), F.col("token_count").cast("long").alias("token_count"))


def sections_structure(spark: SparkSession, sf: str) -> DataFrame:
    """Articles over 60 tokens are cut into runs of clauses."""
    c = sections.structure_aware(_numbered(spark, sf), "doc_id", most=60)
    return c.select("doc_id", "chunk_index", "section", "heading", F.md5("text").alias("text_md5"), F.col("token_count").cast("long").alias("token_count"))


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_N = r"len(regexp_extract_all({}, '\S+'))"
#: Articles with heading, and clauses, of texts b (doc_id, t).
_SECTIONS = rf"""p0 AS (SELECT doc_id, string_split(regexp_replace(t, '(?m)^Điều\s+(\d+)\.\s*(.*)$', chr(1) || '\0', 'g'), chr(1)) AS ps FROM b),
p AS (SELECT doc_id, unnest(range(len(ps))) AS i, unnest(ps) AS x FROM p0),
pc AS (SELECT *, string_split(regexp_replace(x, '(?m)^Chương\s+([IVXLCDM]+)\s*$', chr(2) || '\0', 'g'), chr(2)) AS cs FROM p),
pt AS (SELECT doc_id, i, x, CASE WHEN len(cs) > 1 THEN 'Chương ' || regexp_extract(cs[-1], '^Chương\s+([IVXLCDM]+)', 1) END AS name, {_STRIP.format(r"regexp_extract(cs[-1], '^Chương\s+[IVXLCDM]+\s*([^\n]*)', 1)")} AS title FROM pc),
pn AS (SELECT doc_id, i, x, CASE WHEN title = '' OR starts_with(title, 'Điều') OR starts_with(title, 'Chương') THEN name ELSE name || ': ' || title END AS ch FROM pt),
pl AS (SELECT *, last_value(ch IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS chapter FROM pn),
ar AS (SELECT doc_id, i, regexp_extract(x, '(?m)^Điều\s+(\d+)\.\s*(.*)$', 1)::INT AS number, array_to_string(list_filter([coalesce(chapter, ''), {_STRIP.format(r"regexp_extract(x, '(?m)^Điều\s+(\d+)\.\s*(.*)$', 2)")}], lambda z: z <> ''), ' - ') AS heading, {_STRIP.format('x')} AS body FROM pl WHERE i > 0),
ac AS (SELECT *, substr(body, 1, strpos(body, chr(10))) AS head, string_split(regexp_replace(CASE WHEN strpos(body, chr(10)) > 0 THEN substr(body, strpos(body, chr(10)) + 1) ELSE '' END, '(?m)^(\d{{1,2}})\.\s+', chr(1) || '\0', 'g'), chr(1)) AS cut FROM ar),
cl AS (SELECT doc_id, i, number, heading, k, regexp_extract(c, '^(\d{{1,2}})\.', 1) AS no, {_STRIP.format("CASE WHEN k = 1 THEN head || first || c ELSE c END")} AS t FROM (SELECT doc_id, i, number, heading, head, cut[1] AS first, unnest(range(len(cut))) AS k, unnest(cut) AS c FROM ac) WHERE k > 0)"""
_PARENT_CHILD = f"""rw AS (SELECT doc_id, i, 0 AS k, body AS t, 'Điều ' || number AS section, heading FROM ar UNION ALL SELECT doc_id, i, k, t, 'Điều ' || number || ', Khoản ' || no, heading FROM cl),
ix AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1)::INT AS chunk_index FROM rw)
SELECT doc_id, chunk_index, section, heading, CASE WHEN k > 0 THEN (chunk_index - k)::INT END AS parent_index, md5(t) AS text_md5, {_N.format('t')} AS token_count FROM ix"""
_NUMBERED = """b AS (SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), '. '), lambda s, j: CASE
  WHEN (j - 1) % 21 = 7 THEN 'Chương X' || repeat('I', ((j - 1) // 21)::BIGINT) || chr(10) || chr(10) || '  Phần ' || (j - 1) || chr(10) || 'Điều ' || (j - 1) || '. ' || s
  WHEN (j - 1) % 7 = 0 THEN 'Điều ' || (j - 1) || '. ' || s ELSE ((j - 1) % 7) || '. ' || s END), chr(10)) AS t FROM documents)"""


def _packed(carry: int, most: int) -> str:
    """Greedy packing of the token counts ns (doc_id, ns): chunks w (doc_id, i, chunk, cnt), a row for each piece."""
    return f"""w(doc_id, i, chunk, cnt) AS (SELECT doc_id, 1, 0, ns[1] FROM pieces WHERE len(ns) > 0 UNION ALL
SELECT w.doc_id, i + 1, CASE WHEN cnt + ns[i + 1] > {most} THEN chunk + 1 ELSE chunk END, CASE WHEN cnt + ns[i + 1] > {most} THEN least({carry}, cnt) ELSE cnt END + ns[i + 1] FROM w JOIN pieces USING (doc_id) WHERE i < len(ns))"""


def _split(source: str, most: int, separators: list[str]) -> str:
    """Pieces of a list of texts: those over most tokens are cut at each separator in turn, blank ones dropped."""
    for sep in separators:
        source = rf"list_filter(flatten(list_transform({source}, lambda z: CASE WHEN {_N.format('z')} <= {most} THEN [z] ELSE string_split(z, {sep}) END)), lambda z: regexp_matches(z, '\S'))"
    return source


_SEPARATORS = ["chr(10) || chr(10)", "chr(10)", "'. '", "' '"]
_COUNTED = "SELECT doc_id, count(*) AS n, max(c) AS largest, sum(c)::BIGINT AS tokens FROM (SELECT doc_id, chunk, max(cnt) AS c FROM w GROUP BY doc_id, chunk) GROUP BY doc_id"
_PARAGRAPHS = rf"list_filter(list_transform(string_split_regex(coalesce(text, ''), '\n\s*\n'), lambda y: {_STRIP.format('y')}), lambda y: y <> '')"
CHUNK_SQL = {
    "chunks_recursive": f"WITH RECURSIVE pieces AS MATERIALIZED (SELECT doc_id, list_transform({_split("[coalesce(text, '')]", 400, _SEPARATORS)}, lambda z: {_N.format('z')}) AS ns FROM documents), {_packed(60, 400)} {_COUNTED}",
    "chunks_structure": f"WITH RECURSIVE pieces AS MATERIALIZED (SELECT doc_id, list_transform({_split(_PARAGRAPHS, 600, _SEPARATORS[1:])}, lambda z: {_N.format('z')}) AS ns FROM documents), {_packed(0, 600)} {_COUNTED}",
    "chunks_parent_child": f"WITH b AS (SELECT doc_id, 'Chương I' || chr(10) || 'Chung' || chr(10) || 'Điều 1. Một' || chr(10) || '1. ' || coalesce(text, '') || chr(10) || '2. b c' || chr(10) || 'Điều 2. Hai' || chr(10) || '1. d' || chr(10) AS t FROM documents), {_SECTIONS}, {_PARENT_CHILD}",
    "compressed_chunks": rf"""WITH s AS (SELECT doc_id, length(text) AS size, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?;])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS p FROM documents WHERE length(text) > {MAX_CHARS}),
u AS (SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS x FROM s),
k AS (SELECT doc_id, pos, length(x) AS n, len(list_intersect(list_distinct(regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}_]+')), ['the', 'of', 'and', 'en', 'la'])) AS shared FROM u),
r AS (SELECT doc_id, n, row_number() OVER o AS rn, sum(n) OVER o AS total FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY shared DESC, pos)),
c AS (SELECT doc_id, (sum(n) + count(*) - 1)::BIGINT AS n_chars FROM r WHERE rn = 1 OR total <= {MAX_CHARS} GROUP BY doc_id)
SELECT doc_id, n_chars, n_chars <= {MAX_CHARS} AS fits FROM (SELECT doc_id, CASE WHEN length(text) <= {MAX_CHARS} THEN length(text) ELSE coalesce(c.n_chars, CASE WHEN text IS NOT NULL THEN length(text) END) END AS n_chars FROM documents LEFT JOIN c USING (doc_id))""",
}
QUERIES = {f.__name__: f for f in (sections_parent_child, sections_structure)}
SQL = {
    "sections_parent_child": f"WITH {_NUMBERED}, {_SECTIONS}, {_PARENT_CHILD}",
    "sections_structure": f"""WITH RECURSIVE {_NUMBERED}, {_SECTIONS},
sz AS (SELECT doc_id, i, {_N.format('body')} AS n, coalesce((SELECT max(k) FROM cl WHERE cl.doc_id = ar.doc_id AND cl.i = ar.i), 0) AS kn FROM ar),
cn AS MATERIALIZED (SELECT doc_id, i, k, no, t, {_N.format('t')} AS n FROM cl WHERE (doc_id, i) IN (SELECT (doc_id, i) FROM sz WHERE n > 60 AND kn > 0)),
w(doc_id, i, k, run, cnt) AS (SELECT doc_id, i, k, 0, n FROM cn WHERE k = 1 UNION ALL SELECT c.doc_id, c.i, c.k, CASE WHEN cnt + c.n > 60 THEN run + 1 ELSE run END, CASE WHEN cnt + c.n > 60 THEN c.n ELSE cnt + c.n END FROM w JOIN cn c ON c.doc_id = w.doc_id AND c.i = w.i AND c.k = w.k + 1),
m AS (SELECT doc_id, i, run, string_agg(t, chr(10) ORDER BY k) AS t, min(k) AS a, max(k) AS z, arg_min(no, k) AS first, arg_max(no, k) AS last FROM w JOIN cn USING (doc_id, i, k) GROUP BY doc_id, i, run),
rw AS (SELECT doc_id, i, 0 AS run, body AS t, 'Điều ' || number AS section, heading FROM ar JOIN sz USING (doc_id, i) WHERE n <= 60 OR kn = 0
UNION ALL SELECT doc_id, i, run, t, 'Điều ' || number || ', Khoản ' || CASE WHEN a = z THEN first ELSE first || '-' || last END, heading FROM m JOIN ar USING (doc_id, i))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, run) - 1)::INT AS chunk_index, section, heading, md5(t) AS text_md5, {_N.format('t')} AS token_count FROM rw""",
}
