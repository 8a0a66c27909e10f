"""Outside services as small protocols with deterministic stand-ins: embedding, generation, judging, OCR."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


def hashed_vector(text: Column, width: int = 64) -> Column:
    """The stand-in embedding: token counts by hash, of length 1."""
    place = F.transform(tokens(F.coalesce(text, F.lit("")), unicode=False), lambda t: F.pmod(F.xxhash64(t), F.lit(width)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size(F.filter(place, lambda p: p == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float"))


def call(df: DataFrame, column: str, service: Generator, out: str = "answer", batch: int = 64) -> DataFrame:
    """df plus a service's answers to a text column, batch by batch. Filter before: only rows that need it should come."""

    def answered(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            texts = [t or "" for t in x.to_pylist()]
            yield pa.array([a for k in range(0, len(texts), batch) for a in service(texts[k : k + batch])], pa.string())

    return df.withColumn(out, F.arrow_udf(answered, "string")(F.col(column)))


class QuotaError(Exception):
    """A key has no quota left; wait is the delay that the service suggests, in seconds."""

    def __init__(self, told: str = "", wait: float | None = None) -> None:
        super().__init__(told)
        self.wait = wait


class Patient:
    """A service behind several keys: on a used-up quota the next key is tried at once; where the last key is used up too, or the service fails otherwise, it waits (the
    suggested delay and GRACE more, else ten seconds a round) and goes on, tries rounds in all. Batches that follow one another wait pause seconds.

    pause and waits are in each task; a limit for all tasks together is a matter of how many run, which the caller sets by coalescing."""

    GRACE = 2.0

    def __init__(self, services: list[Callable], tries: int = 4, pause: float = 0.0, sleep: Callable = time.sleep) -> None:
        self.services, self.tries, self.pause, self.sleep, self.used = services, tries, pause, sleep, False

    def __call__(self, texts: list[str]) -> list:
        if not texts:
            return []
        if self.used and self.pause:
            self.sleep(self.pause)
        self.used, last = True, None
        for turn in range(self.tries):
            for k, service in enumerate(self.services):
                try:
                    return service(texts)
                except Exception as e:  # noqa: BLE001  told when the tries are over
                    last = e
                    quota = isinstance(e, QuotaError)
                    if not quota or k + 1 == len(self.services):
                        self.sleep(e.wait + self.GRACE if quota and e.wait is not None else 10.0 * (turn + 1))
        raise RuntimeError(f"no answer after {self.tries} rounds") from last


def call_chain(df: DataFrame, column: str, hops: dict[str, Generator], out: str = "answer", batch: int = 64) -> DataFrame:
    """df plus out, a struct (text, hop, errors): the answer of the first hop, in their order, that answers, and what those before it said.

    A batch that a hop fails goes to that hop text by text, so one text that fails costs no other; only what is then without an answer goes to the next hop.
    Where none answers, text and hop are null. Null texts are sent as empty ones."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            texts = [t or "" for t in x.to_pylist()]
            answer: list[str | None] = [None] * len(texts)
            hop: list[str | None] = [None] * len(texts)
            errors: list[list[str]] = [[] for _ in texts]
            for name, service in hops.items():
                left = [i for i, h in enumerate(hop) if h is None]
                for k in range(0, len(left), batch):
                    part = left[k : k + batch]
                    for group in (part, *([i] for i in part)):
                        todo = [i for i in group if hop[i] is None]
                        if not todo or (len(group) == 1 and len(part) == 1 and group is not part):
                            continue
                        try:
                            for i, a in zip(todo, service([texts[i] for i in todo]), strict=True):
                                answer[i], hop[i] = a, name
                        except Exception as e:  # noqa: BLE001  kept with the row
                            if len(todo) == 1:
                                errors[todo[0]].append(f"{name}: {type(e).__name__}")
            kinds = [pa.string(), pa.string(), pa.list_(pa.string())]
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip((answer, hop, errors), kinds, strict=True)], ["text", "hop", "errors"])

    return df.withColumn(out, F.arrow_udf(run, "text string, hop string, errors array<string>")(F.col(column)))


def with_cache(rows: DataFrame, cache: DataFrame, key: list[str], compute: object) -> DataFrame:
    """Cached rows, and computed ones for keys that the cache lacks: compute maps a DataFrame to one like cache."""
    known = cache.join(rows.select(*key).distinct(), key, "left_semi")
    missing = rows.join(cache.select(*key), key, "left_anti")
    return known.unionByName(compute(missing))
