"""Scans without an exchange of pairs give the rows of the joins."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from quillmere.functions import text as T
from quillmere.operators import chunking, index, scan, search


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def joined(d, q, k, by=()):
    return search.top_k(search.sparse_scores(*index.pruned_scores_input(d, "doc_id", q, "item_id", by=by), "item_id", "doc_id", by), k, [*by, "item_id"], "doc_id")


def corpus(spark, n, shared=False):
    rng = random.Random(3)
    common, rare = [f"w{k}" for k in range(30)], [f"r{k}" for k in range(200)]
    texts = [(f"c{k % 3}", f"d{k}", " ".join(rng.choices(common, k=rng.randint(3, 40)) + rng.choices(rare, k=5))) for k in range(n)]
    texts += [("c0", f"t{k}", "w1 w2 r3") for k in range(60)] + [("c1", "e1", ""), ("c1", "e2", None), (None, "e3", "w1 r1"), ("c9", "e4", "unseen")]
    if shared:
        texts += [("c0", "d0", "w1 r1 r2"), ("c0", "t1", "w1 w2 r3"), ("c2", "d3", "w1"), ("c1", "d4", "w1 w1")]
    queries = [(k, " ".join(rng.sample(rare, 3) + rng.sample(common, 6) + ["w1"] * (k % 3))) for k in range(25)] + [(98, "nothing known"), (99, "w1 w2 r3"), (100, ""), (99, "w1")]
    return spark.createDataFrame(texts, "lang string, doc_id string, text string"), spark.createDataFrame(queries, "item_id long, text string")


@pytest.mark.parametrize("k", [1, 5, 10_000])
@pytest.mark.parametrize("shared", [False, True])
@pytest.mark.parametrize("by", [(), ("lang",)])
def test_sparse_scan_equals_join(spark, monkeypatch, k, shared, by):
    """Ties, texts without terms, null corpora, keys that texts share, and more documents than are scored at a time."""
    monkeypatch.setattr(scan, "CELLS", 500)
    d, q = corpus(spark, 400, shared)
    d = d.repartition(3)
    got, want = scan.sparse_top_k(d, "doc_id", q, "item_id", k, by=by), joined(d, q, k, by)
    assert rows(got.select(*want.columns)) == rows(want)
    if k == 5 and not shared:
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
        monkeypatch.setattr(scan, "LIMIT", 10)
        assert rows(scan.sparse_top_k(d, "doc_id", q, "item_id", k, by=by).select(*want.columns)) == rows(want)


def test_sparse_scan_of_nothing(spark):
    d, q = corpus(spark, 5)
    assert scan.sparse_top_k(d.limit(0), "doc_id", q, "item_id").count() == 0 == scan.sparse_top_k(d, "doc_id", q.limit(0), "item_id").count()


@pytest.mark.parametrize("block", [10_000, 7])
def test_dense_scan_equals_join(spark, monkeypatch, block):
    """Ties, null vectors and entries, other widths, NaN; no norm of 0, at which the join fails."""
    monkeypatch.setattr(search, "QUERY_BLOCK", block)
    monkeypatch.setattr(scan, "CELLS", 200)
    rng = random.Random(4)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    odd = [None, [1.0, None, 0.0, 0.0], [1.0, 2.0], [float("nan"), 1.0, 0.0, 0.0]]
    same = vector()
    d = spark.createDataFrame([(k, vector()) for k in range(150)] + [(200 + k, same) for k in range(9)] + [(300 + k, v) for k, v in enumerate(odd)], "doc_id long, d_vec array<float>").repartition(3)
    q = spark.createDataFrame([(k, vector()) for k in range(20)] + [(30, same)] + [(40 + k, v) for k, v in enumerate(odd)], "item_id long, q_vec array<float>")
    for k in (3, 10_000):
        want = search.top_k(search.dense_scores(q, d, "item_id", "doc_id"), k, "item_id", "doc_id")
        assert rows(scan.dense_top_k(q, d, "item_id", "doc_id", k).select(*want.columns)) == rows(want)


def test_windows_do_not_carry_the_text(spark):
    """The rows that an explode makes hold the window, not the tokens of the whole text, and the text is cut into tokens once."""
    d = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(1000))), (2, "a  b\tc"), (3, " "), (4, None)], "doc_id long, text string")
    c = chunking.chunk_fixed(d, "doc_id", 40, 20)
    got = c.collect()
    assert [(r.chunk_index, r.token_count) for r in got if r.doc_id == 1] == [(i, 40) for i in range(49)] and {r.doc_id for r in got} == {1, 2}
    assert [r.text for r in got if r.doc_id == 2] == ["a b c"] and got[1].text == " ".join(f"w{k}" for k in range(20, 60))
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert "Generate explode" in plan and "_t#" not in plan.split("Generate explode")[0]


def test_alike_scan_equals_join(spark, monkeypatch):
    """Several blocks a group, ties, other widths, nulls, a norm of 0 and groups that one side lacks."""
    monkeypatch.setattr(scan, "BLOCK", (7, 10))
    rng = random.Random(5)
    vector = lambda n=4: [rng.uniform(-1, 1) for _ in range(n)]
    same = vector()
    c = [(k, k % 3, vector()) for k in range(120)] + [(200 + k, 1, same) for k in range(9)] + [(300, 0, vector(3)), (301, 1, None), (302, None, same), (303, 7, same)]
    q = [(k, k % 3, vector()) for k in range(40)] + [(50, 1, same), (51, 0, vector(3)), (52, 2, vector(3)), (53, 1, None), (54, None, same), (55, 8, same)]
    d, q = spark.createDataFrame(c, "entry_id long, prompt_version int, d_vec array<float>"), spark.createDataFrame(q, "query_id long, prompt_version int, q_vec array<float>")
    cos = F.round(search._dot(F.col("q_vec"), F.col("d_vec")) / F.sqrt(search._dot(F.col("q_vec"), F.col("q_vec")) * search._dot(F.col("d_vec"), F.col("d_vec"))), 6)
    met = q.join(d, "prompt_version").where(F.size("q_vec") == F.size("d_vec")).select("query_id", "entry_id", cos.alias("score"))
    for k in (1, 5):
        want = search.top_k(met, k, "query_id", "entry_id")
        assert rows(scan.alike_top_k(q, d, "query_id", "entry_id", "prompt_version", k).select(*want.columns)) == rows(want)
    zero = spark.createDataFrame([(1, 1, [0.0] * 4)], d.schema)
    got = search.cache_lookup(q, d.where("prompt_version <> 1").union(zero), "query_id", "entry_id")
    assert {r.query_id for r in got.collect()} == {r.query_id for r in q.collect()} and not got.where("query_id = 50 and hit").count()


def test_distinct_terms_need_no_exchange(spark):
    for shared in (False, True):
        d, _ = corpus(spark, 100, shared)
        table = index.terms_of(index.token_table(d, "doc_id", by=("lang",))).select("lang", "term")
        got = index.distinct_terms(d, "doc_id", by=("lang",))
        assert rows(got.select("lang", "term")) == rows(table)
        assert shared or "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_overlap_by_scan_equals_prefix_index(spark, monkeypatch):
    from quillmere.operators import citations

    rng = random.Random(6)
    words = [f"w{k}" for k in range(40)]
    chunks = spark.createDataFrame([(f"s{k % 4}", k, f"c{k}", " ".join(rng.choices(words, k=rng.randint(0, 12)))) for k in range(200)] + [("s1", 900, "c900", None)], "document_id string, seq long, chunk_id string, text string")
    asked = spark.createDataFrame([(k, k % 2, f"s{k % 5}", " ".join(rng.sample(words, 5))) for k in range(40)] + [(90, 0, "s1", "")], "question_id long, group_no long, document_id string, ground_truth string")
    got = [rows(citations.best_overlap(asked, chunks, ["question_id", "group_no"], least)) for least in (0.2, 0.8)]
    monkeypatch.setattr(scan, "LIMIT", 0)
    assert got == [rows(citations.best_overlap(asked, chunks, ["question_id", "group_no"], least)) for least in (0.2, 0.8)]
    assert got[0]


def test_places_are_tokens(spark, monkeypatch):
    """Tokens and words of odd texts, a text at a time and many together, are those of Spark's expressions."""
    from quillmere.functions import places

    rng = random.Random(7)
    texts = ["".join(rng.choices("ab_é9 \t\n\x0b\xa0-.—Σσİßǅ½\u0301e中\u1ec7𝒳", k=rng.randint(0, 30))) for _ in range(400)] + [None, "", " ", "\n", "a" * 300]
    d = spark.createDataFrame(list(enumerate(texts)), "n int, text string").withColumn("c", T.composed(F.coalesce("text", F.lit(""))))
    words = F.transform(F.regexp_extract_all("c", F.lit(r"[^\s]+"), F.lit(0)), lambda w: T.tokens(w, unicode=False))
    want = [r[0] for r in d.orderBy("n").select(words).collect()]
    terms = sorted({t for words in want[:200] for w in words for t in w})
    for chars in (1, 150, 1_000_000):
        monkeypatch.setattr(places, "CHARS", chars)
        got = []
        for first, end, f in places.Places(terms).find(texts):
            size, bounds = iter(f.sizes.tolist()), [0, *f.tokens.cumsum().tolist()]
            for i in range(end - first):
                own = slice(bounds[i], bounds[i + 1])
                assert set(f.text[own].tolist()) <= {i}
                got.append(([next(size) for _ in range(f.words[i])], list(zip(f.place[own].tolist(), f.word[own].tolist(), strict=True))))
        assert got == [([len(w) for w in words], [(terms.index(t) if t in terms else -1, j) for j, w in enumerate(words) for t in w]) for words in want]


@pytest.mark.parametrize("shared", [False, True])
def test_windows_equal_rows_of_windows(spark, monkeypatch, shared):
    """Ties, words of several tokens or none, overlaps of many windows, texts that share a key, and few sums at a time."""
    from quillmere.operators import windows

    rng = random.Random(8)
    common, rare = [f"w{k}" for k in range(30)], [f"r{k}" for k in range(200)]
    word = lambda: rng.choice(["{}", "{}", "{}.", "{}-" + rng.choice(rare), "—"]).format(rng.choice(common + rare[:50]))
    texts = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 5, 9, 10, 11, 40, 150])))) for k in range(120)] + [(300 + k, "w1 w2 r3 w1") for k in range(30)] + [(400, None), (401, "... !"), (402, "É é W1\tW1\n r5")]
    if shared:
        texts += [(3, "w1 r1 r2"), (4, texts[4][1]), (5, ""), (301, "w1")]
    d = spark.createDataFrame(texts, "document_id long, text string").repartition(3)
    q = spark.createDataFrame([(k, " ".join(rng.sample(rare, 3) + rng.sample(common, 6) + ["w1"] * (k % 3))) for k in range(25)] + [(98, "nothing known"), (99, "w1 w2 r3"), (100, ""), (99, "w1 é")], "question_id long, text string")
    sizes = {"a": (10, 2), "b": (4, 0), "c": (40, 39), "d": (3, 1)}
    columns = ["config_id", "question_id", "chunk_id", "document_id", "score", "rank"]
    chunks = chunking.chunk_fixed_all(d, "document_id", sizes).select(F.col("strategy").alias("config_id"), F.format_string("%d_%d", "document_id", "chunk_index").alias("chunk_id"), "document_id", "text")
    for k in (3, 10_000):
        want, _ = scan.sparse_corpora(chunks, "chunk_id", q, "question_id", k, by=("config_id",), carry=("document_id",))
        want = rows(want.select(*columns).distinct())
        for first, cells, share in ((1 << 13, 2_000_000, 0.5), (50, 100, 0.9)):
            for module, name, value in ((windows, "FIRST", first), (windows, "SHARE", share), (scan, "CELLS", cells)):
                monkeypatch.setattr(module, name, value)
            found, corpora = windows.top_windows(d, "document_id", sizes, q, "question_id", k)
            assert rows(found.select(*columns)) == want and rows(corpora) == rows(chunks.select("config_id").distinct())
    assert windows.top_windows(d.limit(0), "document_id", sizes, q, "question_id")[0].count() == 0 == windows.top_windows(d, "document_id", sizes, q.limit(0), "question_id")[0].count()


def test_questions_and_texts_have_the_same_letters(spark):
    """A letter that Java's Unicode may lack is part of a token on both sides."""
    from quillmere.operators import windows

    d, q = spark.createDataFrame([(1, "ab\u0870cd x"), (2, "ab cd")], "document_id long, text string"), spark.createDataFrame([(1, "AB\u0870CD")], "question_id long, text string")
    for found in (windows.top_windows(d, "document_id", {"a": (5, 0)}, q, "question_id")[0], scan.sparse_top_k(d, "document_id", q, "question_id")):
        assert [r.document_id for r in found.collect()] == [1]


def test_chunkings_make_no_row_of_a_window(spark, folder, monkeypatch):
    """Work of the chunkings goes by documents: before, each of their windows was a text with a row of its own."""
    from quillmere.plans import QUERIES
    from quillmere.sources import stored

    made = []

    def counted(df, name):
        out = stored.stored(df, name)
        made.append(out.count())
        return out

    for name, module in list(sys.modules.items()):
        if name.startswith("quillmere.operators.") and hasattr(module, "stored"):
            monkeypatch.setattr(module, "stored", counted)
    QUERIES["chunkings_ranked"](spark, folder)
    assert made and max(made) < sum(r.n_chunks for r in QUERIES["chunk_counts"](spark, folder).collect())
