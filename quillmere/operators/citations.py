"""Citations: sections parsed, matched to chunks, and model answers checked against what was retrieved."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.places import words
from ..functions.text import QUOTE_CHARS, preview
from ..sources.stored import spread, stored
from . import scan
from .index import terms_of, token_table

# How sections are written, and the least lexical overlap.
CITED_ARTICLES = r"Điều\s+(\d+(?:\s*,\s*\d+)*)"
CITED_CLAUSE = r"Khoản\s+(\d+)"
CHUNK_SECTION = r"^Điều\s+(\d+)(?:,\s*Khoản\s+(\d+)(?:-(\d+))?)?$"
LEXICAL_LEAST = 0.45
DEFAULT_REFUSAL = "Tôi không tìm thấy thông tin trong tài liệu được cung cấp."
_PAIR = "array<struct<dieu:int,khoan:int>>"


def cited_sections(section: Column) -> Column:
    """Array of (dieu, khoan): one article with clauses gives a pair for each clause, else each article alone."""
    listed = F.regexp_extract(F.coalesce(section, F.lit("")), CITED_ARTICLES, 1)
    articles = F.transform(F.regexp_extract_all(listed, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    clauses = F.transform(F.regexp_extract_all(F.coalesce(section, F.lit("")), F.lit(CITED_CLAUSE), F.lit(1)), lambda x: x.cast("int"))
    pair = lambda d, k: F.struct(d.alias("dieu"), k.cast("int").alias("khoan"))
    both = F.transform(clauses, lambda k: pair(F.get(articles, 0), k))
    alone = F.transform(articles, lambda d: pair(d, F.lit(None)))
    return F.when((F.size(articles) == 1) & (F.size(clauses) > 0), both.cast(_PAIR)).otherwise(alone.cast(_PAIR))


def chunk_section(section: Column) -> Column:
    """(dieu, lo, hi) of a chunk's section, nulls if it has another form; one clause is the range from it to it."""
    part = lambda k: F.nullif(F.regexp_extract(F.coalesce(section, F.lit("")), CHUNK_SECTION, k), F.lit("")).cast("int")
    return F.struct(part(1).alias("dieu"), part(2).alias("lo"), F.coalesce(part(3), part(2)).alias("hi"))


def _scanned_overlap(terms: DataFrame, chunks: DataFrame, key: list[str]) -> DataFrame:
    """(document_id, key..., seq, chunk_id, score): of each task the chunk of the document with the largest share of the n terms of each key."""
    rows = terms.select(*key, "document_id", "n", "term").toArrow()
    coded = rows["term"].combine_chunks().dictionary_encode()
    place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    of: dict[str, list[int]] = {}
    for i, d in enumerate(rows["document_id"].to_pylist()):
        of.setdefault(d, []).append(i)
    sets = {}
    for d, i in of.items():
        own = rows.take(pa.array(i))
        ids, number, _, _ = scan.numbered(own, key)
        n = np.zeros(len(ids))
        n[number] = own["n"].to_numpy()
        sets[(d,)] = (scan.Asked(number, place[i], np.ones(len(i))), ids, n)
    table = scan.counted(chunks, ["document_id", "seq", "chunk_id"], coded.dictionary)
    return scan.scanned(table, ["document_id"], ["seq", "chunk_id"], sets, 1, None, [terms.schema[c] for c in key])


def best_overlap(asked: DataFrame, chunks: DataFrame, key: list[str], least: float) -> DataFrame:
    """asked (key..., document_id, ground_truth), chunks (document_id, chunk_id, seq, text) -> (key..., chunk_id, score) of the chunk of
    the document that holds the largest share of the distinct ground-truth tokens, first in order on a tie, if the share is least
    (over 0) or more.

    Up to scan.LIMIT tokens go to the chunks, and the best of each task are ranked. More of them take a prefix index: of n tokens, c must be in a chunk, so it holds one of the n - c + 1 that are rarest in the document. Those
    alone meet the chunks' tokens; the others can add one each, which bounds a chunk's count, and only chunks
    whose bound reaches both c and the best count so far meet the rest. Jobs run when this is called; chunks are tokenised once, and
    only those of documents that are asked for."""
    if least <= 0:
        raise ValueError("least must be over 0")
    terms = asked.select(*key, "document_id", F.array_distinct(words(F.col("ground_truth"))).alias("_t"))
    terms = terms.select(*key, "document_id", F.size("_t").alias("n"), F.explode_outer("_t").alias("term")).where("term is not null")
    terms = stored(terms.withColumn("c", F.greatest(F.lit(1), F.ceil(F.col("n") * least - 1e-9))), "ground-truth")
    mine = spread(chunks.select("document_id", "seq", "chunk_id", "text")).join(terms.select("document_id").distinct(), "document_id", "left_semi")
    if terms.count() <= scan.LIMIT:
        found = stored(_scanned_overlap(terms, mine, key), "overlaps")
        best = found.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "seq")))
        return best.where((F.col("_n") == 1) & (F.col("score") >= least)).select(*key, "chunk_id", "score")
    have = terms_of(token_table(mine, "chunk_id", by=("document_id", "seq"), wanted=terms.select("term").distinct()))
    have = stored(have.select("document_id", "seq", "chunk_id", "term"), "chunk-tokens")
    often = have.groupBy("document_id", "term").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.coalesce("often", F.lit(0)), "term"))
    terms = terms.join(often, ["document_id", "term"], "left").withColumn("early", place <= F.col("n") - F.col("c") + 1)
    terms = stored(terms.withColumn("late", F.sum(F.when(~F.col("early") & F.col("often").isNotNull(), 1).otherwise(0)).over(Window.partitionBy(*key))), "ground-truth")
    found = terms.where("early").join(have, ["document_id", "term"]).groupBy(*key, "document_id", "seq", "chunk_id", "n", "c", "late").agg(F.count("*").alias("found"))
    near = found.withColumn("most", F.max("found").over(Window.partitionBy(*key))).where(F.col("found") + F.col("late") >= F.greatest("c", "most"))
    near = stored(near.drop("most"), "overlaps")
    more = near.select(*key, "document_id", "seq", "chunk_id").join(terms.where("not early and often is not null").select(*key, "term"), key).join(have, ["document_id", "seq", "chunk_id", "term"])
    more = more.groupBy(*key, "seq", "chunk_id").agg(F.count("*").alias("more"))
    scored = near.join(more, [*key, "seq", "chunk_id"], "left").withColumn("score", (F.col("found") + F.coalesce("more", F.lit(0))) / F.col("n"))
    best = scored.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "seq")))
    return best.where((F.col("_n") == 1) & (F.col("score") >= least)).select(*key, "chunk_id", "score")


def match_citations(citations: DataFrame, chunks: DataFrame, least: float = LEXICAL_LEAST) -> DataFrame:
    """citations (question_id, group_no, document_id, section, ground_truth, requires_refusal), chunks
    (document_id, chunk_id, seq, section, text) -> (question_id, group_no, chunk_id, method).

    Structural: an equi-join on document and article with the clause range as residual. What it leaves
    goes to the best chunk of the document by share of ground-truth tokens, first in order on a tie.
    Groups without either have one row with method none and no chunk. Refusals have no groups."""
    key = ["question_id", "group_no"]
    cites = citations.where(~F.coalesce("requires_refusal", F.lit(False)))
    wanted = cites.select(*key, "document_id", F.explode(cited_sections(F.col("section"))).alias("c")).select(*key, "document_id", "c.*")
    have = chunks.select("document_id", "chunk_id", "seq", chunk_section(F.col("section")).alias("s")).select("document_id", "chunk_id", "seq", F.col("s.dieu").alias("dieu"), "s.lo", "s.hi")
    covers = F.col("lo").isNull() | F.col("khoan").isNull() | F.col("khoan").between(F.col("lo"), F.col("hi"))
    hits = wanted.join(have, ["document_id", "dieu"]).where(covers).select(*key, "chunk_id").distinct().withColumn("method", F.lit("structural"))
    hits = stored(hits, "structural")
    rest = cites.join(hits, key, "left_anti")
    lexical = best_overlap(rest, chunks, key, least).select(*key, "chunk_id", F.lit("lexical").alias("method"))
    none = rest.join(lexical, key, "left_anti").select(*key, F.lit(None).cast("string").alias("chunk_id"), F.lit("none").alias("method"))
    return hits.unionByName(lexical).unionByName(none)


def link_relevant(matches: DataFrame) -> DataFrame:
    """(question_id, relevant_chunks, n_structural, n_lexical, n_none): ordered union of the groups' chunks."""
    row = F.struct("group_no", "chunk_id")
    ids = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("chunk_id").isNotNull(), row))), lambda x: x["chunk_id"]))
    count = lambda m: F.count_distinct(F.when(F.col("method") == m, F.col("group_no")))
    return matches.groupBy("question_id").agg(ids.alias("relevant_chunks"), *(count(m).alias(f"n_{m}") for m in ("structural", "lexical", "none")))


def extract_json(answer: Column) -> Column:
    """The JSON text of an answer: code fences off, else from the first to the last brace; null if it is none."""
    bare = F.regexp_replace(F.trim(F.coalesce(answer, F.lit(""))), r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    braced = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    is_object = lambda x: F.coalesce(F.try_parse_json(x).isNotNull() & F.startswith(F.trim(x), F.lit("{")), F.lit(False))
    return F.when(is_object(bare), bare).when(is_object(braced), braced)


def resolve_id(raw: Column, retrieved: Column) -> Column:
    """A retrieved id: equal to raw, or the only one that ends with raw (three characters at least)."""
    ends = F.filter(retrieved, lambda x: F.endswith(x, raw))
    return F.when(F.array_contains(retrieved, raw), raw).when((F.length(raw) >= 3) & (F.size(ends) == 1), F.get(ends, 0))


def parse_answers(answers: DataFrame, require_citation: bool = True) -> DataFrame:
    """answers (id, raw, retrieved array<string>) plus answer, refusal, citations, invalid, error.

    An answer without valid citation becomes a refusal where one is required; text that holds no JSON
    object is a refusal with error unparseable_model_output."""
    schema = "struct<answer:string,refusal:boolean,citations:array<string>>"
    parsed = answers.withColumn("_j", extract_json(F.col("raw"))).withColumn("_p", F.from_json("_j", schema))
    raw = F.array_distinct(F.filter(F.coalesce("_p.citations", F.array().cast("array<string>")), lambda x: x.isNotNull()))
    pairs = F.transform(raw, lambda x: F.struct(x.alias("raw"), resolve_id(x, F.col("retrieved")).alias("id")))
    parsed = parsed.withColumn("_c", pairs)
    good = F.array_distinct(F.transform(F.filter("_c", lambda x: x["id"].isNotNull()), lambda x: x["id"]))
    bad = F.transform(F.filter("_c", lambda x: x["id"].isNull()), lambda x: x["raw"])
    parsed = parsed.withColumns({"citations": good, "invalid": bad})
    broken = F.col("_j").isNull() | F.col("_p.answer").isNull()
    bare = ~F.coalesce("_p.refusal", F.lit(False)) & (F.size("citations") == 0) & F.lit(require_citation)
    parsed = parsed.withColumn("error", F.when(broken, "unparseable_model_output").when(bare, "answer_without_valid_citation"))
    refusal = F.coalesce("_p.refusal", F.lit(False)) | F.col("error").isNotNull()
    text = F.when(F.col("error").isNotNull() | F.coalesce(F.trim("_p.answer") == "", F.lit(True)), DEFAULT_REFUSAL).otherwise(F.col("_p.answer"))
    return parsed.withColumns({"refusal": refusal, "answer": text}).drop("_j", "_p", "_c")


def quotes(cited: DataFrame, chunks: DataFrame) -> DataFrame:
    """(.., chunk_id) plus the quote of each cited chunk, its first characters."""
    return cited.join(chunks.select("chunk_id", preview(F.col("text"), QUOTE_CHARS).alias("quote")), "chunk_id", "left")
