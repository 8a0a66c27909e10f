"""The pipeline, stage by stage, against the rules that each stage states."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.count())
        assert docs.columns == columns or k == 4
        if name == "pii":
            assert docs.where(F.col("text").rlike(r"[a-z0-9]@mail[0-9]\.example\.com")).count() == 0
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "benchmark", "pii", "mixing"]
    assert seen[0] >= seen[1] > 0.9 * seen[0] and seen[1] > seen[2] > seen[3] == seen[4] > 0 < seen[5]


PROSE = "the house of the man and that of her son are near the water, and they were there for a time with others"

OTHER = "she has been in the garden with all of their friends since the end of that long and warm summer day"


def test_edges(spark, folder):
    """Nulls, empty and repeated rows, null ids, and columns named as those of operators and results."""
    extra = ["_base", "_bin", "_left", "_last", "pii_spans", "kept_id", "lost_id", "stays", "_id", "hashes", "root", "h", "x"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} string" for x in extra)
    texts = [(1, None), (None, PROSE + " or so"), (2, ""), (3, PROSE), (3, PROSE), (4, "12 + 34"), (5, f"mail me {OTHER} a.b@c.org now"), (6, PROSE.upper() + " " + " ".join(PROSE.split()[::-1]))]
    rows = [(i, t, "en", None if k % 2 else "src1", 0, *(x + str(k) for x in extra)) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, schema)
    ids = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        given = docs.columns
        docs = stage(spark, docs, folder).cache()
        assert docs.columns[: len(given)] == given
        got = docs.select("doc_id", "text", *extra).collect()
        ids.append(sorted(str(r.doc_id) for r in got))
        assert all(r[x].startswith(x) for r in got for x in extra)
        if k == 3:
            assert [r.text for r in got if r.doc_id == 5] == [f"mail me {OTHER} [EMAIL] now"]
    assert ids[0] == ["3", "3", "5", "6", "None"]
    assert ids[1] == ids[2] == ids[3] == ["3", "3", "5", "6", "None"]  # a null id has no class with others
    assert set(ids[4]) <= set(ids[3])


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)]])
def test_nothing_left(spark, folder, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_language_stage_rejects(spark, folder):
    """Texts of a language that was not learned and of none go; texts of the table stay."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rng = random.Random(3)
    esperanto = "kaj estas la de en mi vi ne por kun iu tio hundo domo arbo akvo granda malgranda bela libro tago nokto jaro homo".split()
    noise = lambda: "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(2, 9)))
    strange = [(10**6 + k, " ".join(rng.choice(esperanto) if k % 2 else noise() for _ in range(120)), None, "src1", 0) for k in range(6)]
    strange.append((10**6 + 6, "漢字日本語文章 これは日本語の文章です。私は学生です。" * 10, None, "src1", 0))
    both = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long")).unionByName(spark.createDataFrame(strange, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {r.doc_id for r in corpus_pipeline.language(spark, both, folder).select("doc_id").collect()}
    assert not kept & {r[0] for r in strange}
    lost = docs.where(~F.col("doc_id").isin(*kept)).collect()
    assert all(not any(c.isalpha() for c in r.text or "") for r in lost)


def test_stages_against_brute_force(spark, folder):
    """What near-duplicates, benchmark and PII decide on a fixture, in plain Python."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(fold))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * (n := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - n) and n:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, folder).collect()} == {i for i in texts if find(i) == i}
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = word(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} - {()}
    sizes = {len(x) for x in windows}
    clean = {i for i, t in texts.items() if not any(tuple(w[k : k + n]) in windows for w in [word(t)] for n in sizes for k in range(len(w) - n + 1))}
    assert {r.doc_id for r in corpus_pipeline.benchmark(spark, docs, folder).collect()} == clean
    for r in corpus_pipeline.private(spark, docs, folder).collect():
        t = texts[r.doc_id]
        mails = re.findall(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", t)
        assert r.text.count("[EMAIL]") == len(mails) and not any(m in r.text for m in mails)
        if not re.search("[0-9@]", t):
            assert r.text == t


def test_mixing_meets_its_budgets(spark, folder):
    """Each leaf gives whole documents up to its budget, the budgets as allocated."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = corpus_pipeline.mixture(spark, docs, folder).collect()
    from quillmere.llm import mixing

    every = mixing.mix(docs, share=4.0, epochs=4).select(*mixing.LEVELS, "n_tokens", "epoch").where("epoch = 0")
    leaves = every.groupBy(*mixing.LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"))
    longest = {tuple(r[c] for c in mixing.LEVELS): r.longest for r in leaves.collect()}
    got = {}
    for r in rows:
        key = tuple(r[c] for c in mixing.LEVELS)
        got[key] = got.get(key, 0) + r.n_tokens
    for r in mixing.allocate(leaves.drop("longest")).collect():
        key = tuple(r[c] for c in mixing.LEVELS)
        assert r.budget - longest[key] <= got.get(key, 0) <= r.budget


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
