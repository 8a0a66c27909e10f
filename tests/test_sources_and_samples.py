"""Paged documents, versioned indexes, diverse samples, corpora in one retrieval."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from quillmere.functions import text as T
from quillmere.operators import experiments, feedback
from quillmere.sources import files, index_store, paged


def test_a_broken_range_alone_is_read_again(spark, tmp_path):
    log = tmp_path / "log"
    head = lambda n: f"name={n} log={log}\n"
    texts = {"a": [f"page {k}" for k in range(1, 41)], "b": [f"b {k}" for k in range(1, 4)], "c": [f"c {k}" for k in range(1, 20)]}
    texts["a"][19] += " BROKEN"
    texts["c"][16] += " BROKEN LOST"
    for n, pages in texts.items():
        (tmp_path / n).write_text("\f".join([head(n) + pages[0], *pages[1:]]), encoding="utf-8")
    (tmp_path / "bad").write_bytes(b"\xff\xfe name=bad")
    paths = [str(tmp_path / n) for n in ("a", "b", "c", "bad", "absent")]
    source = "tests.page_readers:"
    docs, rejects = paged.extract(spark, paths, (f"{source}logged", f"{source}patient"), tries=2, size=15)
    got = {os.path.basename(r.path): r for r in docs.collect()}
    lines = log.read_text().split("\n")
    count = lambda who, doc, pages: lines.count(f"{who} {doc} {pages}")
    assert [count("Logged", "a", p) for p in ("1-15", "16-30", "31-40")] == [1, 2, 1] and count("Patient", "a", "16-30") == 1
    assert count("Logged", "b", "1-3") == 1 and count("Patient", "b", "1-3") == 0 and count("Patient", "c", "16-19") == 2
    assert got["a"].n_pages == 40 and got["a"].n_failed == 0 and got["c"].n_pages == 15 and got["c"].n_failed == 1
    assert re.findall(r"--- \[batch trang (\d+-\d+/\d+)\] ---", got["a"].text) == ["1-15/40", "16-30/40", "31-40/40"]
    assert got["a"].text.split("---\n", 1)[1].startswith(head("a") + "page 1\npage 2\n") and "page 20 BROKEN" in got["a"].text
    left = {(os.path.basename(r.path), r.first, r.last): r.error for r in rejects.collect()}
    assert left[("c", 16, 19)] == "OSError: lost" and set(left) == {("c", 16, 19), ("bad", 1, 1), ("absent", 1, 0)}
    assert got["bad"].text == "" and got["absent"].n_pages == 0
    # Tagged pages of the joined text are absolute, as the marker of a batch says where it begins.
    joined = spark.createDataFrame([("--- [batch trang 16-30/40] ---\n--- Trang 2 ---\nx",)], "t string").select(T.tag_pages(F.col("t"))).first()[0]
    assert "[PG:17]" in joined


def test_page_ranges_are_partitions(spark, tmp_path):
    (tmp_path / "x").write_text("\f".join(f"p{k}" for k in range(100)))
    found = paged.read_pages(spark, [str(tmp_path / "x")], "quillmere.sources.paged:form_feed", 7)
    assert found.rdd.getNumPartitions() == 15 and found.count() == 100
    assert sorted(r.page for r in paged.read_pages(spark, [], "quillmere.sources.paged:form_feed", 7, [(str(tmp_path / "x"), 5, 9, 100)]).collect()) == [5, 6, 7, 8, 9]


@pytest.fixture
def points(spark):
    return spark.range(0, 1000, 1, 3).select("id", F.format_string("text %d", "id").alias("text"), F.array(F.col("id").cast("double"), F.lit(0.5)).alias("v"))


def test_index_versions_and_restore(spark, tmp_path, points):
    home, backup = str(tmp_path / "home"), str(tmp_path / "backup")
    assert index_store.current(spark, home) is None
    index_store.publish(points.where("id < 500"), home, "v1")
    index_store.publish(points, backup, "v2")
    assert index_store.current(spark, home) == "v1" and index_store.load(spark, home).count() == 500 and index_store.altered(spark, backup, "v2").count() == 0
    with pytest.raises(FileExistsError):
        index_store.publish(points, home, "v1")
    index_store.restore(spark, backup, home, "v2")
    assert index_store.current(spark, home) == "v2" and index_store.fingerprint(index_store.load(spark, home)) == index_store.fingerprint(points)
    index_store.point_to(spark, home, "v1")  # back to the one before
    assert index_store.load(spark, home).count() == 500
    index_store.restore(spark, backup, home, "v2")  # it is there already
    assert index_store.current(spark, home) == "v2"
    with pytest.raises(FileNotFoundError):
        index_store.point_to(spark, home, "v3")


@pytest.mark.parametrize("harm", ["altered", "missing", "unknown"])
def test_restore_finds_one_damaged_file(spark, tmp_path, points, harm):
    home, backup = str(tmp_path / "home"), str(tmp_path / "backup")
    index_store.publish(points.where("id < 10"), home, "v1")
    index_store.publish(points, backup, "v2")
    data = tmp_path / "backup" / "versions" / "v2" / "data"
    part = sorted(data.glob("*.parquet"))[0]
    for crc in data.glob(".*.crc"):
        crc.unlink()
    if harm == "altered":
        content = bytearray(part.read_bytes())
        content[len(content) // 2] ^= 1
        part.write_bytes(content)
    elif harm == "missing":
        part.unlink()
    else:
        (data / "part-99.parquet").write_bytes(part.read_bytes())
    assert [r.problem for r in index_store.altered(spark, backup, "v2").collect()] == [harm]
    with pytest.raises(ValueError, match="damaged"):
        index_store.restore(spark, backup, home, "v2")
    assert index_store.current(spark, home) == "v1" and index_store.load(spark, home).count() == 10


def test_manifests_are_joined_by_key(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "file string, n int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "file string, n int")
    assert sorted(map(tuple, files.keyed_union(old, new, ["file"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_samples_against_the_rule(spark):
    rng = random.Random(4)
    words = ["fee", "exam", "credit", "term", "course", "grade", "thesis", "leave"]
    rows = []
    for k in range(400):
        q = None if k % 29 == 0 else "" if k % 31 == 0 else "?!" if k % 37 == 0 else " ".join(rng.choices(words[: 2 + k % 7], k=rng.randint(1, 9)))
        rows.append((f"f{k}", f"l{k % 3}", None if k % 4 == 0 else f"c{k % 2}", q, k // 2))
    rows += [("g1", "only", None, None, 1), ("g2", "only", None, "", 2)]
    got = {(r.error_label, r.category): r.samples for r in feedback.with_samples(spark.createDataFrame(rows, "feedback_id string, error_label string, category string, question string, seq long")).collect()}
    want = {}
    for i, label, category, q, _ in sorted(rows, key=lambda r: (r[4], r[0])):
        kept = want.setdefault((label, category), [])
        t = set((q or "").split()) - {"?!"}
        if q and len(kept) < 3 and not any(t and s and len(t & s) / len(t | s) > 0.8 for s in (set(x.split()) - {"?!"} for x in kept)):
            kept.append(q)
    assert got == want


def test_samples_of_a_cluster_of_a_million(spark):
    """One cluster of 10**6 rows: its questions are aggregated where they lie."""
    rows = spark.range(0, 1_000_000, 1, 8).select(F.format_string("f%07d", "id").alias("feedback_id"), F.lit("hallucination").alias("error_label"), F.lit(None).cast("string").alias("category"), F.when(F.col("id") < 900_000, F.concat(F.lit("same question with number "), (F.col("id") % 1).cast("string"))).when(F.col("id") < 999_000, "another thing").otherwise(F.concat(F.lit("a third of kind "), F.col("id").cast("string"))).alias("question"), F.col("id").alias("seq"))
    assert [r.samples for r in feedback.with_samples(rows).collect()] == [["same question with number 0", "another thing", "a third of kind 999000"]]


def test_corpora_are_ranked_apart(spark):
    """A corpus ranked with others gives the rows it gives alone."""
    rng = random.Random(1)
    words = [f"w{k}" for k in range(50)]
    rows = [(f"c{n}", f"{d}_{k}", d, " ".join(rng.choices(words[: 10 + 20 * n], k=12))) for n in range(3) for d in range(20) for k in range(1 + n)]
    texts = spark.createDataFrame(rows, "config_id string, chunk_id string, document_id long, text string")
    questions = spark.createDataFrame([(k, " ".join(rng.sample(words, 4))) for k in range(8)], "question_id long, text string")
    groups = spark.createDataFrame([(k, 0, k) for k in range(7)] + [(3, 1, 19)], "question_id long, group_no int, chunk_id long")
    ranked, means, misses = experiments.compare_corpora(texts, questions, groups)
    whole = [sorted(map(tuple, x.collect())) for x in (ranked, means, misses)]
    for n in range(3):
        alone = [sorted(map(tuple, x.collect())) for x in experiments.compare_corpora(texts.where(F.col("config_id") == f"c{n}"), questions, groups)]
        assert alone == [[r for r in part if r[0] == f"c{n}"] for part in whole]
    assert {r[1] for r in whole[1]} == {7} and whole[2]
