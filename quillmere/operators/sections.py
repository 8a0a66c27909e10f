"""Sections of structured texts: articles, chapters and clauses found by built-in functions alone.

A heading pattern marks its matches, left to right without overlap, and a split at the marks gives the
pieces of a text. The chapter of an article is the last one begun in an earlier piece. Clauses are the pieces
of an article's body, and runs of clauses are a fold over their token counts. All of it is a chain of
transforms over the arrays of one text, where each step is evaluated once; chunks become rows at the end, so that
no text is exchanged. The rows equal those of the map in `chunking`; here nothing leaves the JVM.

Texts may not hold the control characters U+0001 and U+0002, which are the marks; they are taken out.
Null and empty texts have no rows here. Each row of docs is a text of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunking import STRUCTURE

# The headings, in the dialect of built-in functions (only a line feed ends a line).
CHAPTER = r"(?dmU)^Chương\s+([IVXLCDM]+)\s*$"
ARTICLE = r"(?dmU)^Điều\s+(\d+)\.\s*(.*)$"
CLAUSE = r"(?dmU)^(\d{1,2})\.\s+"
_MARK, _CHAPTER_MARK = "\x01", "\x02"
#: White space, as \s has it in the patterns.
_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def tokens_of(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)))


def pieces(text: Column, pattern: str, mark: str = _MARK) -> Column:
    """What is before the first match, then a piece from each match to the next."""
    return F.split(F.regexp_replace(text, pattern, f"{mark}$0"), mark, -1)


def _stripped(x: Column) -> Column:
    """strip_space of functions.text, looking at the ends only."""
    return F.btrim(x, F.lit(_SPACE))


def _with_chapters(found: Column) -> Column:
    """An array of pieces as structs (piece, chapter): the last chapter that begins in it, with the next line that is not blank as its title; null without one."""
    x = F.transform(found, lambda p: F.struct(p.alias("piece"), F.when(F.contains(p, F.lit("Chương")), pieces(p, CHAPTER, _CHAPTER_MARK)).alias("parts")))
    x = F.transform(x, lambda p: F.struct(p["piece"].alias("piece"), F.when(F.size(p["parts"]) > 1, F.element_at(p["parts"], -1)).alias("last")))
    name = lambda last: F.concat(F.lit("Chương "), F.regexp_extract(last, r"(?U)^Chương\s+([IVXLCDM]+)", 1))
    title = lambda last: _stripped(F.regexp_extract(last, r"(?dU)^Chương\s+[IVXLCDM]+\s*([^\n]*)", 1))
    x = F.transform(x, lambda p: F.struct(p["piece"].alias("piece"), name(p["last"]).alias("name"), title(p["last"]).alias("title")))
    plain = lambda t: (t == "") | F.startswith(t, F.lit("Điều")) | F.startswith(t, F.lit("Chương"))
    chapter = lambda p: F.when(plain(p["title"]), p["name"]).otherwise(F.concat(p["name"], F.lit(": "), p["title"]))
    return F.transform(x, lambda p: F.struct(p["piece"].alias("piece"), chapter(p).alias("chapter")))


def articles(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, articles): the articles of each text in order, as structs of number, heading, body and clauses; null without articles.

    Clauses are structs of number and text, the heading line with the first; an empty array without clauses.
    Columns that a lambda refers to are used more than once, so that Spark keeps them as columns and does not evaluate them in the lambda."""
    d = docs.select(key, F.translate(F.coalesce(F.col(text), F.lit("")), _MARK + _CHAPTER_MARK, "").alias("_t"))
    d = d.select(key, _with_chapters(pieces(F.col("_t"), ARTICLE)).alias("_p"))
    # The places of chapters bound the runs of pieces after them; the first piece, before any article, counts as one.
    last = F.size("_p") - 1
    inner = F.filter(F.sequence(F.lit(0), last - 1), lambda i: (i > 0) & F.get("_p", i)["chapter"].isNotNull())
    d = d.select(key, "_p", F.when(last > 0, F.concat(F.array(F.lit(0)), inner, F.array(last))).alias("_b"))
    after = lambda k: F.transform(F.sequence(F.get("_b", k) + 1, F.get("_b", k + 1)), lambda i: F.struct(F.get("_p", i)["piece"].alias("piece"), F.get("_p", F.get("_b", k))["chapter"].alias("chapter")))
    x = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_b") - 2), after))
    heading = lambda p: F.array_join(F.filter(F.array(F.coalesce(p["chapter"], F.lit("")), _stripped(F.regexp_extract(p["piece"], ARTICLE, 2))), lambda t: t != ""), " - ")
    number = lambda p: F.regexp_extract(p["piece"], ARTICLE, 1).cast("int")
    x = F.transform(x, lambda p: F.struct(number(p).alias("number"), heading(p).alias("heading"), _stripped(p["piece"]).alias("body")))
    # A body begins with its heading line, so no clause begins in that.
    x = F.transform(x, lambda a: a.withField("cut", pieces(a["body"], CLAUSE)))
    clause = lambda a: lambda c, i: F.struct(F.regexp_extract(c, r"^(\d{1,2})\.", 1).alias("number"), _stripped(F.when(i == 0, F.concat(F.get(a["cut"], 0), c)).otherwise(c)).alias("text"))
    own = lambda a: F.transform(F.slice(a["cut"], 2, F.size(a["cut"]) - 1), clause(a))
    x = F.transform(x, lambda a: F.struct(a["number"].alias("number"), a["heading"].alias("heading"), a["body"].alias("body"), own(a).alias("clauses")))
    return d.select(key, F.when(F.col("_b").isNotNull(), x).alias("articles"))


def _rows(found: DataFrame, key: str, chunks: Column) -> DataFrame:
    """A row (key, chunk_index, fields) for each of an array of structs. As an outer explode with a filter behind it, for an inner one makes Spark evaluate the array twice."""
    return found.select(key, F.posexplode_outer(chunks).alias("chunk_index", "_x")).where("_x is not null").select(key, "chunk_index", "_x.*")


def _name(a: Column) -> Column:
    return F.concat(F.lit("Điều "), a["number"].cast("string"))


def parent_child(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, chunk_index, text, section, heading, parent_index, token_count): articles, each followed by its clauses, which name it as parent."""
    row = lambda a, x, section, k: F.struct(x.alias("text"), section.alias("section"), a["heading"].alias("heading"), k.alias("_k"))
    children = lambda a: F.transform(a["clauses"], lambda c, i: row(a, c["text"], F.concat(_name(a), F.lit(", Khoản "), c["number"]), i + 1))
    own = F.transform("articles", lambda a: F.concat(F.array(row(a, a["body"], _name(a), F.lit(0))), children(a)))
    rows = _rows(articles(docs, key, text), key, F.flatten(own))
    return rows.select(key, "chunk_index", "text", "section", "heading", F.when(F.col("_k") > 0, F.col("chunk_index") - F.col("_k")).alias("parent_index"), tokens_of(F.col("text")).alias("token_count"))


def run_starts(counts: Column, most: int) -> Column:
    """Where runs begin in an array of token counts, packed in order up to most; one that is too large is alone. A fold."""
    zero = F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, n: Column) -> Column:
        new = (acc["k"] == 0) | (acc["n"] + n > most)
        starts = F.when(new, F.concat(acc["starts"], F.array(acc["k"]))).otherwise(acc["starts"])
        return F.struct((acc["k"] + 1).alias("k"), F.when(new, n).otherwise(acc["n"] + n).alias("n"), starts.alias("starts"))

    return F.aggregate(counts, zero, step, lambda acc: acc["starts"])


def structure_aware(docs: DataFrame, key: str, text: str = "text", most: int = STRUCTURE) -> DataFrame:
    """(key, chunk_index, text, section, heading, token_count): an article a chunk, a longer one in runs of its clauses.

    Tokens are counted once: clauses begin at lines, so the counts of an article and of a run are sums over clauses."""
    row = lambda a, x, section, n: F.struct(x.alias("text"), section.alias("section"), a["heading"].alias("heading"), n.alias("token_count"))
    counted = lambda a: F.when(F.size(a["clauses"]) == 0, F.array(tokens_of(a["body"]))).otherwise(F.transform(a["clauses"], lambda c: tokens_of(c["text"])))
    total = lambda ns: F.aggregate(ns, F.lit(0), lambda s, n: s + n)
    whole = lambda a: (F.size(a["clauses"]) == 0) | (total(a["counts"]) <= most)
    x = F.transform("articles", lambda a: a.withField("counts", counted(a)))
    x = F.transform(x, lambda a: a.withField("starts", F.when(~whole(a), run_starts(a["counts"], most))))

    def run(a: Column, first: Column, last: Column) -> Column:
        take = lambda f: F.transform(F.sequence(first, last), f)
        number = lambda i: F.get(a["clauses"], i)["number"]
        label = F.when(first == last, number(first)).otherwise(F.concat(number(first), F.lit("-"), number(last)))
        joined = F.array_join(take(lambda i: F.get(a["clauses"], i)["text"]), "\n")
        return row(a, joined, F.concat(_name(a), F.lit(", Khoản "), label), total(take(lambda i: F.get(a["counts"], i))))

    last = lambda a, k: F.coalesce(F.get(a["starts"], k + 1), F.size(a["clauses"])) - 1
    many = lambda a: F.transform(a["starts"], lambda first, k: run(a, first, last(a, k)))
    x = F.transform(x, lambda a: F.when(a["starts"].isNull(), F.array(row(a, a["body"], _name(a), total(a["counts"])))).otherwise(many(a)))
    return _rows(articles(docs, key, text), key, F.flatten(x)).select(key, "chunk_index", "text", "section", "heading", "token_count")
