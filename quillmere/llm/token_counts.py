"""Token counts by a map-side two-tier lookup.

Tier one is a table of the token counts of frequent pre-tokens: every entry of the vocabulary that
is itself one pre-token, as byte-level BPE learns merges by frequency. It has at most MAX_TABLE
entries whatever the corpus, is built once on the driver with the tokenizers library and broadcast
together with the tokenizer's own file. Tier two is a cache in each Python worker: pre-tokens that
the table lacks are encoded by the library in one batch for each chunk of rows and remembered; a
cache over MAX_CACHE entries is emptied, which changes no result. No pre-token is ever shuffled and
the plan has no exchange.

Texts are cut at special strings first, as the library does, then into pre-tokens by the public
byte-level pattern. Long texts are read in pieces cut before a space between two other characters,
where that pattern always starts a pre-token, so that memory is bounded by PIECE, not by a text.

Defined cases: a null text counts as empty: 0 bytes, 0 tokens. A special string inside a text is one
token. Rows are independent; other columns, nulls and repeated ids pass through.
"""

import json
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import prepare, table

VOCABULARY = "byte_bpe_50k.json"
MAX_TABLE, MAX_CACHE, PIECE, LIMIT = 65_536, 400_000, 1 << 20, 512
PATTERN = regex.compile(public_tokenizers.PATTERN)
_CUT = regex.compile(r"(?<=\S) (?=\S)")


@lru_cache(1)
def _byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else 256 and on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}


def frequent(tokenizer: Tokenizer) -> dict[str, int]:
    """Token counts of the vocabulary's entries that are one pre-token, at most MAX_TABLE of them."""
    to_byte, texts = _byte_of_char(), []
    for piece, _ in sorted(tokenizer.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1])[:MAX_TABLE]:
        try:
            text = bytes(to_byte[c] for c in piece).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if (m := PATTERN.fullmatch(text)) and PATTERN.match(text).end() == m.end():
            texts.append(text)
    return dict(zip(texts, (len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)), strict=True))


class Counter:
    """Counts tokens with a table of known pre-tokens and a bounded cache of the others."""

    def __init__(self, source: str, known: dict[str, int]) -> None:
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.source, self.known, self.cache = source, known, {}
        added = [x["content"] for x in json.loads(source).get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None

    def pieces(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PIECE:
            cut = _CUT.search(text, at + PIECE)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def look_up(self, pending: list[tuple[int, list[str]]], out: list[int]) -> None:
        """Adds the counts of the pending pre-tokens, encoding those that the cache lacks."""
        need = set().union(*(units for _, units in pending))
        missing = need.difference(self.cache)
        if len(self.cache) + len(missing) > MAX_CACHE:
            self.cache.clear()
            missing = need
        todo = list(missing)
        for k in range(0, len(todo), 20_000):
            part = todo[k : k + 20_000]
            self.cache.update(zip(part, (len(x.ids) for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        get = self.cache.__getitem__
        for i, units in pending:
            out[i] += sum(map(get, units))
        pending.clear()

    def count(self, texts: list[str]) -> list[int]:
        out, known = [0] * len(texts), self.known
        pending: list[tuple[int, list[str]]] = []
        waiting = 0
        for i, text in enumerate(texts):
            parts = [text]
            if self.special and (found := self.special.findall(text)):
                out[i] += len(found)
                parts = self.special.split(text)
            for part in parts:
                for piece in self.pieces(part):
                    units = PATTERN.findall(piece)
                    counts = list(map(known.get, units))
                    if None in counts:
                        rest = [u for u, c in zip(units, counts, strict=True) if c is None]
                        out[i] += sum(c for c in counts if c is not None)
                        pending.append((i, rest))
                        waiting += len(rest)
                    else:
                        out[i] += sum(counts)
                    if waiting > MAX_CACHE // 4:
                        self.look_up(pending, out)
                        waiting = 0
        self.look_up(pending, out)
        return out


_worker: list[Counter] = []


def worker_counter(source: str, known: dict[str, int]) -> Counter:
    """The counter of this Python worker, kept from task to task."""
    if not _worker or _worker[0].source != source:
        _worker[:] = [Counter(source, known)]
    return _worker[0]


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """docs plus n_bytes and n_tokens of the column text; vocabulary is the path of a byte-level BPE file."""
    spark = docs.sparkSession
    prepare(spark)
    with open(vocabulary or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        source = f.read()
    sent = spark.sparkContext.broadcast((source, frequent(Tokenizer.from_str(source))))

    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = worker_counter(*sent.value)
        for texts in batches:
            out: list[int] = []
            for k in range(0, len(texts), 256):
                out += counter.count([t or "" for t in texts.slice(k, 256).to_pylist()])
            yield pa.array(out, pa.int64())

    count = F.arrow_udf(counted, "long")
    return docs.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": count(F.col(text))})


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
