"""Fill-in-the-middle, whitening and the digest index against plain Python."""

import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.llm import digest_index, fim, whitening

TEXTS = [
    (1, "one two  three\n four"), (2, None), (3, ""), (4, " \t\n "), (5, "  lead and trail  "), (6, "x" * 50_000), (7, "é ü 漢字 \U0001d11e " * 3000), (8, "has <P> inside here"), (None, "null id here and there"),
    (9, "a b c d\x0be\x0cf\x1cg"), (10, "same text twice"), (10, "same text twice"), (11, "same  text\ttwice"), (12, " same text twice"), (-5, "same text twice "), *((100 + k, f"word{k} and some others, to draw from {k}") for k in range(60)),
]
SCHEMA = "doc_id long, text string, n string, form int, fim_text long, kept string, digest string, id string, unit int, kind int, place long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "n", 1, 2, "k", "d", "i", 3, 4, 5) for i, t in TEXTS], SCHEMA).repartition(3)


def fim_by_rule(key, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    d = hashlib.sha256(f"42:{'null' if key is None else key}".encode()).hexdigest()
    h = [int(d[k : k + 8], 16) for k in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim(docs):
    made = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("fim_text"), F.col("form"))).collect()
    show = lambda rows: sorted(rows, key=str)
    assert show((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.fim_text, r.back) for r in made) == show((i, *fim_by_rule(i, t), t or "") for i, t in TEXTS)
    assert {r.form for r in made} == {"plain", "psm", "spm"} and all(r.kept == "k" and r.unit == 3 for r in made)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_fim_slices():
    """Token ends don't depend on where slices end."""
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("ab \n 漢") for _ in range(rng.randint(0, 40)))
        ends, at = [], 0
        for m in re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text):
            at = m.end()
            ends.append(at)
        for size in (1, 2, 7, 100):
            assert fim.token_ends(fim.points(text), size).tolist() == ends


@pytest.mark.parametrize("marks", [("", "b", "c"), ("a", "a", "c"), ("<<P>", "<S>", "P><"), ("aba", "x", "y"), ("<P>", "<PP", "P>")])
def test_fim_marks_that_could_meet(marks):
    with pytest.raises(ValueError):
        fim.Marks(*marks).check()


def test_fim_other_marks(spark):
    rows = spark.createDataFrame([(k, "P S M < > <P S> one two " * 4 + str(k)) for k in range(80)], "doc_id long, text string")
    marks = fim.Marks("<|pre|>", "<|suf|>", "<|mid|>")
    made = fim.fill_in_middle(rows, rate=100, spm_rate=50, marks=marks).withColumn("back", fim.restored(F.col("fim_text"), F.col("form"), marks))
    assert made.where("back <> text or form = 'plain'").count() == 0 and made.select("form").distinct().count() == 2


def exact_covariance(x):
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    t = [[n * r[k] - s[k] for k in range(d)] for r in x]
    return s, [[Fraction(sum(r[i] * r[j] for r in t), n**3) for j in range(d)] for i in range(d)], [sum(v * v for v in r) for r in t]


def test_whitening(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(700, 12)) * np.geomspace(0.001, 300, 12) + rng.normal(size=12) * 50
    base[:, 3] += 0.9 * base[:, 8]
    vectors = [list(map(float, np.float32(v))) for v in base]
    bad = [(None, 1), ([], 2), ([1.0, None] + [0.0] * 10, 3), ([float("nan")] * 12, 4), ([float("inf")] + [0.0] * 11, 5)]
    rows = [(k, v, "a", "b") for k, v in enumerate(vectors)] + [(-k, v, "a", "b") for v, k in bad] + [(None, vectors[0], "a", "b"), (7, vectors[7], "a", "b")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, vector string, id string").repartition(5)
    out, fit = whitening.whiten(table)
    x = [[int(np.floor(np.float64(c) * 1024)) + 100_000 for c in v] for v in [*vectors, vectors[0], vectors[7]]]
    s, v, deviations = exact_covariance(x)
    assert fit["n"] == 702 and fit["identity_error"] < 100 * 2.0**-52 * fit["eigenvalues"][0] / fit["eigenvalues"][-1]  # as a backward stable solver
    exact = np.array([[float(c) for c in r] for r in v])
    assert np.abs(fit["covariance"] - exact).max() <= 1e-15 * exact.max()
    assert all(abs(fit["covariance"][i, j] - exact[i, j]) <= 4e-16 * max(abs(exact[i, j]), 1e-9 * np.sqrt(exact[i, i] * exact[j, j])) for i in range(12) for j in range(12))
    values, components = np.linalg.eigh(exact)
    assert np.allclose(fit["explained"], values[::-1][:8] / np.trace(exact), rtol=1e-10)
    assert np.abs(np.abs((fit["components"] * components[:, ::-1][:, :8]).sum(axis=0)) - 1).max() < 1e-12
    got = {r.id: r for r in out.collect() if r.id is not None and r.id != 7}
    mean = [Fraction(t, 702) for t in s]
    for k in (0, 11, 699):
        centred = np.array([float(a - m) for a, m in zip(x[k], mean, strict=True)])
        assert np.allclose(got[k].vector, centred @ fit["components"] / np.sqrt(fit["eigenvalues"]), rtol=1e-9, atol=1e-12)
        assert int(got[k].deviation) == deviations[k]
    assert out.count() == 702 and out.where("id is null").count() == 1 and out.where("id = 7").count() == 2


def test_whitening_sums_are_exact():
    """Sums that lose all their digits in doubles."""
    rng = np.random.default_rng(8)
    x = rng.integers(-(2**30), 2**30, size=(5000, 3)).astype(float)
    x[:2500, 0], x[2500:, 0] = 2.0**40, -(2.0**40)
    x[17, 0] += 1
    total = whitening.Doubled(np.zeros(3))
    whitening.add_rows(total, x)
    want = [sum(map(int, c)) for c in x.T.tolist()]
    assert [int(h) + int(e) for h, e in zip(total.high, total.low, strict=True)] == want
    products = whitening.Doubled(np.zeros((3, 3)))
    for part in (x[:1111], x[1111:]):
        task = whitening.Doubled(np.zeros((3, 3)))
        whitening.add_products(task, part, np.zeros_like(part))
        products.add(task.high, task.low)
    for i in range(3):
        for j in range(3):
            want = sum(int(a) * int(b) for a, b in x[:, [i, j]].tolist())
            assert abs(int(products.high[i, j]) + int(products.low[i, j]) - want) <= 2.0**-78 * 5000 * 2**80


def test_whitening_edges(spark):
    shape = "vec_id long, embedding array<float>"
    out, fit = whitening.whiten(spark.createDataFrame([(1, None)], shape))
    assert out.count() == 0 and fit["n"] == 0
    out, fit = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], shape))
    assert [tuple(r.vector) for r in out.collect()] == [(0.0, 0.0)] * 2 and fit["identity_error"] == 1 and list(fit["explained"]) == [0, 0]
    out, fit = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 3e38]) for k in range(4)], shape))
    assert np.allclose(fit["explained"], [1, 0, 0]) and {r.id: int(r.deviation) for r in out.collect()}[0] == 16 * 5 * 1024**2 * 36 // 16
    with pytest.raises(Exception, match="widths"):
        whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], shape).repartition(2))
    wide = [[2**40 + k, -(2**39) * k] for k in range(5)]
    assert whitening.deviations(np.array(wide, float), 5, [sum(c) for c in zip(*wide, strict=True)]) == exact_covariance(wide)[2]


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 4000).astype(np.uint64)
    f = digest_index.CuckooFilter(1024)
    assert f.insert(h[:3600]) and f.contains(h[:3600]).all()  # 88 % full
    others = rng.integers(0, 2**63, 100_000).astype(np.uint64)
    assert f.contains(others).mean() < 0.001
    f.delete(h[:1800])
    assert f.contains(h[1800:3600]).all() and f.contains(h[:1800]).mean() < 0.01 and (f.cells > 0).sum() == 1800
    same = np.full(9, 12345, np.uint64)
    assert not f.insert(same)  # eight cells at most for one hash


def test_unit_overflow_and_false_hits():
    """Digests of one fingerprint and bucket: each hit is verified, and overflow resizes from the stored digests."""
    alike = [bytes([k]) * 24 + (5 << 48 | 7 | k << 20).to_bytes(8, "big") for k in range(40)]
    u = digest_index.Unit()
    u.change([(d, k, 1, k, 1) for k, d in enumerate(alike)])
    assert u.resized and u.verified == 0 and u.present(alike) == [True] * 40 and u.verified == 40
    stranger = b"\xff" * 24 + alike[3][24:]
    assert u.filter.contains(digest_index.hashes([stranger]))[0] and u.present([stranger]) == [False]
    u.change([(stranger, 99, 2, 0, 1), (alike[0], 50, 2, 1, 3)])
    assert u.content[stranger] == [99, 2, 0, 1] and u.content[alike[0]] == [0, 1, 0, 4]
    u.change([(alike[0], None, None, None, None), (alike[1], 60, 3, 3, -2)])
    assert u.present(alike[:2]) == [False, True] and u.content[alike[1]] == [60, 3, 3, 2]


def same(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def by_rule(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(same(t), []).append(i)
    first = {t: min((x for x in ids if x is not None), default=None) for t, ids in groups.items()}
    return sorted((str(i), str(first[same(t)]), len(groups[same(t)]), hashlib.sha256(same(t).encode()).hexdigest()) for i, t in rows)


def shown(df):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.digest.hex()) for r in df.collect())


def test_digest_index(spark, docs):
    index = digest_index.DigestIndex(spark, unit_keys=16)
    got = index.insert(docs)
    assert shown(got) == by_rule(TEXTS) and index.units > 1
    kept = [r for r in got.collect() if r.kept]
    assert len(kept) == len({same(t) for _, t in TEXTS}) and all(r.doc_id == r.keep_id for r in kept)
    more = [(10_000 + k, f"word{k} and some others, to draw from {k}" if k < 30 else f"new text {k // 2}") for k in range(60)] + [(-9, "same text twice"), (None, None)]
    index.insert(spark.createDataFrame(more, "doc_id long, text string"))
    every = [*TEXTS, *more]
    assert shown(index.verdicts()) == by_rule(every)
    gone = [(-9, "same\ntext twice"), (10, "same text twice"), (10_059, "new text 29"), (10_058, "new text 29"), (3, "not its text"), (77_777, ""), (None, "")]
    index.delete(spark.createDataFrame(gone, "doc_id long, text string"))
    left = [r for r in every if (r[0], same(r[1])) not in {(i, same(t)) for i, t in gone}]
    assert len(left) == len(every) - 6 and shown(index.verdicts()) == by_rule(left)
    asked = [(1, "new text 29"), (2, "  same text twice"), (3, "one two three four"), (4, None)]
    found = {r.doc_id: (r.keep_id, r.group_size) for r in index.lookup(spark.createDataFrame(asked, "doc_id long, text string")).collect()}
    rule = {t: (k, n) for _, k, n, t in by_rule(left)}
    assert found[1] == (None, 0) and all((str(found[i][0]), found[i][1]) == rule[hashlib.sha256(same(t).encode()).hexdigest()] for i, t in asked[1:])
    index.insert(spark.createDataFrame([(5, "new text 29")], "doc_id long, text string"))
    assert shown(index.verdicts()) == by_rule([*left, (5, "new text 29")])


def test_digest_index_edges(spark):
    shape = "doc_id string, text string"
    index = digest_index.DigestIndex(spark)
    assert index.insert(spark.createDataFrame([], shape)).count() == 0
    assert index.lookup(spark.createDataFrame([("a", "x")], shape)).collect()[0].asDict() == {"doc_id": "a", "keep_id": None, "group_size": 0}
    got = index.insert(spark.createDataFrame([("b", "x"), ("a", " x"), ("ä", "x"), (None, " x"), ("a", " x")], shape))
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in got.collect()) == [("None", "a", 2 + 1, False), ("a", "a", 3, False), ("a", "a", 3, True), ("b", "b", 2, True), ("ä", "b", 2, False)]


def test_one_text_in_most_rows(spark):
    """A hot text reaches its unit combined, not row by row."""
    rows = spark.range(0, 200_000, 1, 4).select((F.col("id") * 7 % 200_003).alias("doc_id"), F.when(F.col("id") % 3 > 0, "the same").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    index = digest_index.DigestIndex(spark)
    got = index.insert(rows)
    hot = rows.where("text = 'the same'").agg(F.min("doc_id"), F.count("*")).first()
    assert got.where("group_size > 1").select("keep_id", "group_size").distinct().collect() == [hot]
    assert got.where("kept").count() == 200_000 - hot[1] + 1
    combined = index._combine(index.rows).where(F.col("digest") == digest_index.digest(F.lit("the same")))
    assert combined.count() <= 8
