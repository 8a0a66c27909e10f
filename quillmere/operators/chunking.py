"""Chunkers: texts to rows of chunks.

Fixed windows are expressions over a token array. The others pack pieces greedily in order, which no
built-in operator expresses; they run as one map over Arrow batches, a document at a time.
Chunks come as rows (key, chunk_index, text, section, heading, parent_index, token_count).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import count_tokens, page_range, strip_page_tags

# Sizes of chunks, and headings.
FIXED, RECURSIVE, STRUCTURE, PARENT_CHILD = (300, 50), (400, 60), 600, 250
CHAPTER = re.compile(r"^Chương\s+([IVXLCDM]+)\s*$", re.MULTILINE)
ARTICLE = re.compile(r"^Điều\s+(\d+)\.\s*(.*)$", re.MULTILINE)
CLAUSE = re.compile(r"^(\d{1,2})\.\s+", re.MULTILINE)
PARAGRAPH = re.compile(r"\n\s*\n")
SEPARATORS = ("\n\n", "\n", ". ", " ")
_ROW = "chunk_index int, text string, section string, heading string, parent_index int, token_count int"
Chunk = tuple[str, str | None, str | None, int | None]


def words(text: str) -> int:
    return len(text.split())


def _fixed(name: str, size: int, overlap: int) -> Column:
    """The windows of the token array _t as structs. They are cut token by token, as slice copies the whole array each time."""
    step = max(size - overlap, 1)
    last = F.when(F.size("_t") > size, F.ceil((F.size("_t") - size) / step)).otherwise(0).cast("int")
    count = lambda i: F.least(F.lit(size), F.size("_t") - i * step)
    text = lambda i: F.array_join(F.transform(F.sequence(i * step, i * step + count(i) - 1), lambda j: F.get("_t", j)), " ")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.lit(name).alias("strategy"), i.alias("chunk_index"), text(i).alias("text"), count(i).alias("token_count")))


def chunk_fixed_all(docs: DataFrame, key: str, sizes: dict[str, tuple[int, int]]) -> DataFrame:
    """(strategy, key, chunk_index, text, token_count) of several sizes {strategy: (size, overlap)}: a text is cut into tokens once for all.

    Windows are cut before they become rows, so that no row carries the tokens of the whole text; explode_outer, as an inner
    explode, or a filter on the tokens, makes Spark tokenise again."""
    d = docs.select(key, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\s]+"), F.lit(0)).alias("_t"))
    own = F.concat(*(_fixed(name, *x) for name, x in sizes.items()))
    d = d.select(key, F.explode_outer(F.when(F.size("_t") > 0, own)).alias("_w")).where("_w is not null")
    return d.select("_w.strategy", key, "_w.chunk_index", "_w.text", "_w.token_count")


def chunk_fixed(docs: DataFrame, key: str, size: int = FIXED[0], overlap: int = FIXED[1]) -> DataFrame:
    """Windows of size tokens, overlap tokens in common; the window that reaches the end is the last."""
    return chunk_fixed_all(docs, key, {"fixed": (size, overlap)}).drop("strategy")


def split_recursive(text: str, most: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most most tokens where a separator allows; blank ones are dropped."""
    if not text.strip():
        return []
    if words(text) <= most:
        return [text]
    for k, sep in enumerate(separators):
        parts = text.split(sep)
        if len(parts) > 1:
            return [x for p in parts for x in split_recursive(p, most, separators[k:] if len(p) < len(text) else separators[k + 1 :])]
    return [text]


def pack(pieces: list[str], most: int, joint: str, carry: int = 0) -> list[str]:
    """Joins pieces in order up to most tokens; each new chunk begins with the last carry tokens of the
    one before. joint is white space, so the tokens of the parts add up."""
    out: list[str] = []
    now: list[str] = []
    count = 0
    for piece in pieces:
        n = words(piece)
        if now and count + n > most:
            out.append(joint.join(now))
            tail = out[-1].split()[-carry:] if carry else []
            now, count = ([" ".join(tail)] if tail else []) + [piece], len(tail) + n
        elif now or piece:
            now.append(piece)
            count += n
    return [*out, joint.join(now)] if now else out


def recursive(text: str, size: int = RECURSIVE[0], overlap: int = RECURSIVE[1]) -> list[Chunk]:
    return [(t.strip(), None, None, None) for t in pack(split_recursive(text, size), size, " ", overlap)]


def paragraphs(text: str, most: int) -> list[str]:
    pieces = [x for p in PARAGRAPH.split(text) if p.strip() for x in ([p.strip()] if words(p) <= most else split_recursive(p, most, SEPARATORS[1:]))]
    return [t.strip() for t in pack(pieces, most, "\n")]


def articles(text: str) -> list[tuple[int, str, str]] | None:
    """(number, heading, body) of each article, body with its heading line; None without articles.

    The heading names the chapter at or before the article, with the line after the chapter as its title."""
    found = list(ARTICLE.finditer(text))
    if not found:
        return None
    chapters = []
    for m in CHAPTER.finditer(text):
        title = text[m.end() :].lstrip("\n").split("\n", 1)[0].strip()
        chapters.append((m.start(), f"Chương {m[1]}" + (f": {title}" if title and not title.startswith(("Điều", "Chương")) else "")))
    out = []
    for m, end in zip(found, [*(m.start() for m in found[1:]), len(text)], strict=True):
        chapter = next((c for at, c in reversed(chapters) if at <= m.start()), "")
        out.append((int(m[1]), " - ".join(x for x in (chapter, m[2].strip()) if x), text[m.start() : end].strip()))
    return out


def clauses(body: str) -> list[tuple[str, str]]:
    """(number, text) of an article's clauses, the heading line with the first; one ('', body) without clauses."""
    line_end = body.find("\n") + 1
    found = list(CLAUSE.finditer(body, line_end)) if line_end else []
    if not found:
        return [("", body)]
    starts = [0, *(m.start() for m in found[1:])]
    ends = [*(m.start() for m in found[1:]), len(body)]
    return [(m[1], body[a:b].strip()) for m, a, b in zip(found, starts, ends, strict=True)]


def structure_aware(text: str, most: int = STRUCTURE) -> list[Chunk]:
    """An article a chunk; a longer one in runs of clauses, where a clause that is too long alone stays
    whole; texts without articles by paragraphs."""
    parts = articles(text)
    if parts is None:
        return [(t, None, None, None) for t in paragraphs(text, most)]
    out: list[Chunk] = []
    for number, heading, body in parts:
        if words(body) <= most:
            out.append((body, f"Điều {number}", heading, None))
            continue
        run: list[tuple[str, str]] = []
        for clause in [*clauses(body), None]:
            if run and (clause is None or words("\n".join(t for _, t in [*run, clause])) > most):
                label = run[0][0] if len(run) == 1 else f"{run[0][0]}-{run[-1][0]}"
                section = f"Điều {number}, Khoản {label}" if run[0][0] else f"Điều {number}"
                joined = "\n".join(t for _, t in run)
                out.append((joined, section, heading, None))
                run = []
            if clause is not None:
                run.append(clause)
    return out


def parent_child(text: str, most: int = PARENT_CHILD) -> list[Chunk]:
    """Articles as parents, their clauses as children with the parent's index; flat paragraphs without articles."""
    parts = articles(text)
    if parts is None:
        return [(t, None, None, None) for t in paragraphs(text, most)]
    out: list[Chunk] = []
    for number, heading, body in parts:
        parent = len(out)
        out.append((body, f"Điều {number}", heading, None))
        own = clauses(body)
        out += [(t, f"Điều {number}, Khoản {n}", heading, parent) for n, t in own if n]
    return out


STRATEGIES: dict[str, Callable[..., list[Chunk]]] = {"recursive": recursive, "structure_aware": structure_aware, "parent_child": parent_child}


def _mapped(batches: Iterator[pa.RecordBatch], key: str, how: Callable[[str], list[Chunk]]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    names = [x.split()[0] for x in _ROW.split(", ")]
    for batch in batches:
        rows, owner = [], []
        for i, text in enumerate(batch.column("text")):
            for n, (t, section, heading, parent) in enumerate(how(text.as_py() or "")):
                rows.append((n, t, section, heading, parent, words(t)))
                owner.append(i)
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(owner, pa.int64())), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=[key, *names])


def chunk(docs: DataFrame, key: str, strategy: str = "structure_aware", **options: int) -> DataFrame:
    """Chunks of docs (key, text) by a strategy; options it does not know are an error."""
    if strategy == "fixed":
        out = chunk_fixed(docs, key, **options)
        return out.select(key, "chunk_index", "text", F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("heading"), F.lit(None).cast("int").alias("parent_index"), "token_count")
    how = partial(_mapped, key=key, how=partial(STRATEGIES[strategy], **options))
    return docs.select(key, "text").mapInArrow(how, f"{key} {dict(docs.dtypes)[key]}, {_ROW}")


def assemble(chunks: DataFrame, key: str, strategy: str) -> DataFrame:
    """Ids, parents' ids, pages and final text. A chunk without page tags has the last page seen before it."""
    c = chunks.withColumn("_p", page_range(F.col("text")))
    order = Window.partitionBy(key).orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.col("_p.page_end"), ignorenulls=True).over(order)
    name = lambda i: F.format_string(f"chunk_%s_{strategy}_%04d", F.col(key).cast("string"), i)
    text = strip_page_tags(F.col("text"))
    return c.withColumns({
        "chunk_id": name(F.col("chunk_index")), "parent_chunk_id": F.when(F.col("parent_index").isNotNull(), name(F.col("parent_index"))),
        "page_start": F.coalesce("_p.page_start", before), "page_end": F.coalesce("_p.page_end", before), "strategy": F.lit(strategy), "text": text, "token_count": count_tokens(text),
    }).drop("_p")
