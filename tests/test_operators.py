"""Operators on small literals."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from quillmere import streaming
from quillmere.functions import text as T
from quillmere.operators import checks, chunking, citations, feedback, gate, index, metrics, observability, policy, prompts, search
from quillmere.plans import QUERIES
from quillmere.sources import files, web


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_markers_and_pages(spark):
    raw = F.lit("--- [batch trang 16-30/82] ---\n--- Trang 1 ---\nA\n-- trang 2 --\nB")
    assert one(spark, T.strip_markers(raw)) == "\nA\n\nB"
    assert one(spark, T.tag_pages(F.lit("--- Trang 3 ---\n\n \nA\n\nB\n-- Trang 4 --\n"))) == "[PG:3]\nA\n\nB\n[PG:4]"
    assert one(spark, T.tag_pages(raw)) == "\n[PG:16]\nA\n[PG:17]\nB"
    assert tuple(one(spark, T.page_range(T.tag_pages(raw)))) == (16, 17)
    assert tuple(one(spark, T.page_range(F.lit("none")))) == (None, None)


def test_unicode(spark):
    assert one(spark, T.nfc(F.lit("é"))) == "é"
    assert one(spark, F.array_join(T.tokens(F.lit("Điều_1 x² ½ a\u0323b C\r\nd")), "|")) == "điều_1|x²|½|ạb|c|d"
    assert one(spark, T.slug(F.lit("Đào tạo: Khóa 12!"))) == "ao-tao-khoa-12"
    assert one(spark, T.slug(F.lit("??"))) == "file"


def test_extraction_space_and_links(spark):
    """Lines of blanks stay; only runs of three or more line ends shrink. Links go to the site's root."""
    from quillmere.sources import web

    assert one(spark, T.extract_space(F.lit(" a\n \n \nb\n\t\nc\n\n\n\nd  e"))) == "a\n \n \nb\n \nc\n\nd e"
    base = F.lit("https://a.org/x/y.php?q=1")
    assert one(spark, web.absolute(F.lit("z.pdf"), base)) == "https://a.org/z.pdf"
    assert one(spark, web.absolute(F.lit("/z.pdf"), base)) == "https://a.org/z.pdf"
    assert one(spark, web.absolute(F.lit("http://b.org/z"), base)) == "http://b.org/z"
    assert one(spark, web.extension(F.lit("application/msword"), F.lit("https://a.org/x"))) == "html"
    assert one(spark, web.extension(F.lit("text/html"), F.lit("https://a.org/X.DOCX"))) == "docx"


def test_long_clause_stays_whole(spark):
    from quillmere.operators import chunking

    clause = "1. " + "w " * 700
    got = chunking.structure_aware(f"Điều 1. Một\n{clause.strip()}\n2. b c", 600)
    assert [g[1] for g in got] == ["Điều 1, Khoản 1", "Điều 1, Khoản 2"]


def test_sentences_numbers(spark):
    assert one(spark, T.sentences(F.lit("A b. C; d!\nE"))) == ["A b.", "C;", "d!", "E"]
    assert one(spark, T.numbers(F.lit("1.5, 20. và 1.5 3"))) == ["1.5", "20", "3"]


LAW = "Chương I\nQuy định chung\nĐiều 1. Phạm vi\nVăn bản này.\nĐiều 2. Đối tượng\n1. Một hai ba.\n2. Bốn năm sáu.\n3. Bảy tám chín.\nChương II\nĐiều 3. Khác\nHết."


def test_chunkers():
    chunks = chunking.structure_aware(LAW)
    assert [c[1] for c in chunks] == ["Điều 1", "Điều 2", "Điều 3"]
    assert chunks[0][2] == "Chương I: Quy định chung - Phạm vi" and chunks[2][2] == "Chương II - Khác"
    assert [c[1] for c in chunking.structure_aware(LAW, 13)][1:3] == ["Điều 2, Khoản 1-2", "Điều 2, Khoản 3"]
    tree = chunking.parent_child(LAW)
    assert [c[3] for c in tree] == [None, None, 1, 1, 1, None]
    assert chunking.structure_aware("") == [] and [c[1] for c in chunking.structure_aware("a b\n\nc")] == [None]
    assert all(len(t.split()) <= 12 for t, *_ in chunking.recursive("x y. " * 40, 10, 2))


def brute_tree(text):
    """(section, heading, parent, text) of the chunks of a document in its two articles, line by line."""
    lines = f"Chương I\nChung\nĐiều 1. Một\n1. {text or ''}\n2. b c\nĐiều 2. Hai\n1. d\n".split("\n")
    chapter, parts, out = "", [], []
    for k, line in enumerate(lines):
        if re.fullmatch(r"Chương [IVX]+", line):
            chapter = f"{line}: {lines[k + 1]}"
        if m := re.fullmatch(r"Điều (\d+)\. ([^\n]*)", line):
            parts.append((f"Điều {m[1]}", f"{chapter} - {m[2].strip()}", []))
        if parts:
            parts[-1][2].append(line)
    for section, heading, own in parts:
        parent, groups = len(out), [["", []]]
        out.append((section, heading, None, "\n".join(own).strip()))
        for line in own:
            if m := re.match(r"(\d{1,2})\. ", line):
                if groups[-1][0]:
                    groups.append([m[1], []])
                groups[-1][0] = m[1]
            groups[-1][1].append(line)
        out += [(f"{section}, Khoản {n}", heading, parent, "\n".join(g).strip()) for n, g in groups if n]
    return out


def test_parent_child_takes_whole_documents(spark, tmp_path):
    long = " ".join(f"từ{k}" for k in range(400))
    texts = [long, f"{long}\n7. mục {long}\n123. không phải mục", f"x\nĐiều 9. Giữa\nlời dẫn\n1. {long}\n\n  2. lùi\n3. c\r\nd", f"{long}\nChương II\nPhần sau\nĐiều 4. Cuối\nkhông có mục", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.chunk_index, r.section, r.heading, r.parent_index, r.text_md5, r.token_count) for r in QUERIES["chunks_parent_child"](spark, str(tmp_path)).collect()), key=lambda r: r[:2])
    assert got == [(i, k, s, h, p, hashlib.md5(t.encode()).hexdigest(), len(t.split())) for i, x in enumerate(texts) for k, (s, h, p, t) in enumerate(brute_tree(x))]


def test_fixed_windows(spark):
    d = spark.createDataFrame([(1, " ".join(map(str, range(700)))), (2, ""), (3, "a b")], "doc_id long, text string")
    got = [(r.doc_id, r.chunk_index, r.token_count) for r in chunking.chunk(d, "doc_id", "fixed").orderBy("doc_id", "chunk_index").collect()]
    assert got == [(1, 0, 300), (1, 1, 300), (1, 2, 200), (3, 0, 2)]


def test_bm25_brute_force(spark):
    docs = {1: "cat dog dog", 2: "cat", 3: "", 4: "bird dog cat cat"}
    ix = index.Bm25Index.build(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), "doc_id")
    q = index.query_vectors(spark.createDataFrame([(9, "dog dog bird zebra")], "q long, text string"), "q", ix.terms.select("term", "idf"))
    got = {r.doc_id: r.score for r in search.sparse_scores(q, ix.vectors, "q", "doc_id").collect()}
    n, avg = 4, sum(len(t.split()) for t in docs.values()) / 4
    idf = lambda w: math.log(1 + (n - (d := sum(w in t.split() for t in docs.values())) + 0.5) / (d + 0.5))
    for i, t in docs.items():
        ws = t.split()
        s = sum(idf(w) ** 2 * k * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for w, k in (("dog", 2), ("bird", 1)) if w in ws)
        assert got.get(i, 0) == pytest.approx(s, abs=1e-6)


def test_index_round_trip(spark, tmp_path):
    ix = index.Bm25Index.build(spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string"), "doc_id")
    ix.save(str(tmp_path / "ix"))
    back = index.Bm25Index.load(spark, str(tmp_path / "ix"))
    assert sorted(map(tuple, back.terms.collect())) == sorted(map(tuple, ix.terms.collect()))


def test_dispatcher_and_listwise(spark):
    with pytest.raises(ValueError, match="unknown mode"):
        search.retrieve("x", "q", "d")
    with pytest.raises(ValueError, match="lacks"):
        search.retrieve("hybrid_rrf", "q", "d")
    ids = F.array(*map(F.lit, "abcd"))
    assert one(spark, search.listwise_order(F.lit("[3, 1, 9, 3]"), ids)) == list("cabd")
    assert one(spark, search.listwise_order(F.lit(None), ids)) == list("abcd")


def test_retrieval_metrics(spark):
    r = spark.createDataFrame([(1, f"c{k}", k) for k in range(1, 8)] + [(2, "x", 1)], "question_id long, chunk_id string, rank int")
    g = spark.createDataFrame([(1, 0, "c2"), (1, 0, "c9"), (1, 1, "c6"), (2, 0, None), (3, 0, "c1")], "question_id long, group_no long, chunk_id string")
    m = {x.question_id: x for x in metrics.retrieval_metrics(r, g).collect()}
    assert m[1].recall == 0.5 and m[1].hit == 1 and m[1].mrr == 0.5
    assert m[1].ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert m[2].recall is None and m[3].recall == 0 and m[3].mrr == 0


def test_ndcg_takes_each_chunk_and_group_once(spark):
    r = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "question_id long, chunk_id string, rank int")
    g = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 1, "b")], "question_id long, group_no long, chunk_id string")
    assert metrics.retrieval_metrics(r, g).first().ndcg == pytest.approx(1.0)


def test_percentile_kinds(spark):
    d = spark.createDataFrame([(float(x),) for x in range(1, 21)], "x double")
    p = {k: metrics.percentiles(d, [], F.col("x"), {"v": k}).first()[0] for k in (("a", 0.95), ("b", 0.5), ("c", 0.95), ("d", 0.5), ("e", 0.01))}
    assert p == {("a", 0.95): 19.0, ("b", 0.5): 10.5, ("c", 0.95): 20.0, ("d", 0.5): 11.0, ("e", 0.01): 20.0}
    assert metrics.percentiles(d.where("x < 0"), [], F.col("x"), {"v": ("a", 0.5)}).first()[0] is None


def test_citations(spark):
    pairs = lambda s: [tuple(x) for x in one(spark, citations.cited_sections(F.lit(s)))]
    assert pairs("Điều 5, Khoản 2, Khoản 3") == [(5, 2), (5, 3)] and pairs("Điều 5, 6") == [(5, None), (6, None)] and pairs("Phụ lục") == []
    assert tuple(one(spark, citations.chunk_section(F.lit("Điều 4, Khoản 2-5")))) == (4, 2, 5) and tuple(one(spark, citations.chunk_section(F.lit("Điều 4, Khoản 2")))) == (4, 2, 2)
    ids = F.array(F.lit("chunk_a_001"), F.lit("chunk_b_001"), F.lit("chunk_a_002"))
    assert one(spark, citations.resolve_id(F.lit("002"), ids)) == "chunk_a_002" and one(spark, citations.resolve_id(F.lit("001"), ids)) is None and one(spark, citations.resolve_id(F.lit("2"), ids)) is None


def test_policies(spark):
    k = lambda *s: one(spark, policy.dynamic_k(F.array(*map(F.lit, s)).cast("array<double>"), 5))
    assert (k(), k(1.35), k(2.1), k(1.7)) == (5, 8, 3, 5)
    c = lambda r, b, v, a, f: one(spark, policy.confidence(*map(F.lit, (r, b, v, a, f))))
    assert c(False, 2.2, 1, 1, False) == 1.0 and c(False, 1.1, 0, 0, True) == 0.42 and c(True, 2.2, 1, 1, False) is None
    assert [one(spark, policy.complexity(F.lit(q))) for q in ("Học phí?", "A và B thế nào?", "x" * 61)] == ["simple", "hard", "medium"]
    assert one(spark, policy.ambiguity_handled(F.lit("Nếu A thì B, trường hợp C"))) and not one(spark, policy.ambiguity_handled(F.lit("Nếu A")))
    text = "Alpha beta. " * 40 + "Gamma delta. " + "Alpha beta. " * 40
    short = one(spark, policy.compress(F.lit(text), F.lit("gamma")))
    assert "Gamma delta." in short and len(short) < 1000
    with pytest.raises(KeyError):
        policy.render("{a}{b}", a=F.lit(1))


def test_gate(spark, folder):
    from quillmere.plans.operations import gate_scenarios

    status = {r.scenario: r.status for r in gate_scenarios(spark, folder).collect()}
    assert {status[f"{m}/missing"] for m, s, *_ in gate.BOUNDS if s == "critical"} == {"BLOCK"} and status["citation_accuracy/missing"] == "WARN"
    assert status["recall_at_5/none"] == "PASS" and status["faithfulness/breach"] == "BLOCK" and status["recall_at_5/small"] == "PASS"
    base = spark.createDataFrame([("recall_at_5", 0.95)], "metric string, value double")
    now = spark.createDataFrame([("k", "recall_at_5", 0.90)], "k string, metric string, value double")
    v = gate.violations(now, base, gate.bounds(spark, [("recall_at_5", "critical", 0.85, None)]), "k").first()
    assert v.reason == "regression" and v.baseline == 0.95 and gate.exit_code("BLOCK") == 1


def test_feedback(spark):
    texts = F.array(*map(F.lit, ("a b c", "a b c", "d e", "f", "g")))
    assert one(spark, feedback.diverse(texts)) == ["a b c", "d e", "f"]
    bad = spark.createDataFrame([("x", None, "user", "open"), ("thumbs_up", None, "user", "open"), ("thumbs_up", "nope", "user", "open")], "feedback_type string, error_label string, source string, status string")
    assert sorted(r.rule for r in feedback.broken_rules(bad).collect()) == ["error_label", "feedback_type"]
    with pytest.raises(KeyError):
        feedback.mark_reviewed(spark.createDataFrame([("a",)], "feedback_id string"), "b", None, "me")


def test_prompts(spark):
    def row(v, status="draft"):
        return spark.createDataFrame([("qa", v, "Q {q}", ["q"], status, None, "s", None, None, None, None)], prompts.SCHEMA)

    reg = prompts.create(prompts.create(prompts.empty(spark), row("p0")), row("p1"))
    with pytest.raises(ValueError):
        prompts.create(reg, row("p1"))
    assert prompts.create(reg, row("p1"), if_absent=True).count() == 2
    with pytest.raises(ValueError):
        prompts.activate(reg, "qa", "p0", "me", "2024-01-01")
    reg = prompts.activate(prompts.activate(reg, "qa", "p0", "me", "2024-01-01", "first"), "qa", "p1", "me", "2024-01-02", "next")
    assert {r.prompt_version: r.status for r in reg.collect()} == {"p0": "archived", "p1": "active"} and prompts.broken(reg).count() == 0
    assert prompts.pinned(reg, "qa").first().prompt_version == "p1"


def test_checks_raise(spark):
    with pytest.raises(ValueError):
        checks.assert_clean(spark.createDataFrame([("r", "critical", "c")], "rule string, severity string, chunk_id string"))


def test_web_and_files(spark, tmp_path):
    title, text = web.extract("<html><head><title>T</title><style>x</style></head><body><div class='a menu'>no</div><p>One<br>two</p><script>z</script></body>")
    assert title == "T" and text.split("\n") == ["One", "two"]
    assert [one(spark, web.absolute(F.lit(x), F.lit("http://h.org/a/b.html?q=1"))) for x in ("c.pdf", "/d.pdf", "https://x/y")] == ["http://h.org/c.pdf", "http://h.org/d.pdf", "https://x/y"]
    d = spark.createDataFrame([("1", ["a", "b"], None), ("2", [], 0.5)], "id string, labels array<string>, v double")
    files.write_jsonl(d, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), strict=True).count() == 2
    files.write_csv(d, str(tmp_path / "c"))
    back = {r.id: (r.labels, r.v) for r in files.read_csv(spark, str(tmp_path / "c")).collect()}
    assert back == {"1": ("a|b", None), "2": (None, "0.5")}
    assert files.write_index(d, str(tmp_path / "i"), "v1") and not files.write_index(d, str(tmp_path / "i"), "v1")


def test_quantile(spark):
    d = spark.createDataFrame([(0.2,), (0.7,), (1.5,), (70.0,)], "x double").agg(observability.buckets(F.col("x"), observability.LATENCY_BUCKETS).alias("b"))
    assert d.select(observability.quantile(F.col("b"), observability.LATENCY_BUCKETS, 0.5)).first()[0] == pytest.approx(1.0)
    assert d.select(observability.quantile(F.col("b"), observability.LATENCY_BUCKETS, 0.99)).first()[0] == 60.0


def test_stream_equals_batch(spark, folder, tmp_path):
    from quillmere.plans.operations import _traces

    t = _traces(spark, folder).select("ts", "latency_s", "n_errors", "fallback", "cost_usd", "trace_id").cache()
    t.repartition(3).write.parquet(str(tmp_path / "in"))
    s = streaming.windowed_stats(streaming.trace_stream(spark, str(tmp_path / "in"), t.schema), "1 hour", None, "90000 hours")
    q = s.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    want = observability.window_stats(t, "1 hour", None)
    key = lambda df: sorted((r.start, r.requests, round(r.p95 or 0, 6), round(r.cost, 3)) for r in df.collect())
    assert key(spark.table("w")) == key(want)


def test_stream_dedup_to_files(spark, folder, tmp_path):
    from quillmere.plans.operations import _traces

    t = _traces(spark, folder).select("ts", "trace_id").limit(50).cache()
    t.unionByName(t).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = streaming.distinct_traces(streaming.trace_stream(spark, str(tmp_path / "in"), t.schema))
    streaming.run_available(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_feedback_store(spark):
    from quillmere.operators import feedback

    schema = "feedback_id string, feedback_type string, error_label string, source string, status string"
    store = spark.createDataFrame([("f1", feedback.TYPES[0], None, feedback.SOURCES[0], feedback.STATUSES[0])], schema)
    more = feedback.create(store, spark.createDataFrame([("f2", feedback.TYPES[1], None, feedback.SOURCES[0], feedback.STATUSES[-1])], schema))
    assert feedback.get(more, "f2")["feedback_type"] == feedback.TYPES[1] and feedback.listed(more).count() == 2
    assert feedback.listed(more, feedback.STATUSES[-1]).count() == 1
    with pytest.raises(KeyError):
        feedback.get(store, "f2")
    with pytest.raises(KeyError):
        feedback.create(more, store)
    with pytest.raises(ValueError):
        feedback.create(store, spark.createDataFrame([("f3", "?", None, "?", "?")], schema))


def test_judge_replies(spark):
    """A reply without the rubric's scores raises, it never counts as a score."""
    from quillmere.operators import assembly

    good = '{"faithfulness": 0.5, "answer_relevance": 1, "context_relevance": 0, "hallucination": false}'
    pairs = spark.createDataFrame([(1, "q", "a", "c"), (2, "q", "a", "c"), (3, "r", "a", "c")], "question_id long, question string, answer string, context string")
    cache = spark.createDataFrame([], "key string, scores struct<faithfulness:double,answer_relevance:double,context_relevance:double,hallucination:boolean>")
    out, new = assembly.judge(pairs, cache, F.lit(good))
    assert out.count() == 3 and new.count() == 2 and out.first().scores.faithfulness == 0.5
    for bad in ("", "no", good.replace("0.5", "0.7"), good.replace("false", "null")):
        with pytest.raises(Exception, match="no scores"):
            assembly.judge(pairs, cache, F.lit(bad))[0].collect()
