"""Sections as relations give the chunks of the map over texts."""

import random

from pyspark.sql import functions as F

from quillmere.operators import chunking, sections

FIXED = [
    "Chương I\nQuy định chung\nĐiều 1. Phạm vi\nMở đầu\n1. một hai\n2. ba\n\nChương II\n\n  Tổ chức  \nĐiều 2. Đối tượng\nkhông khoản\nĐiều 3.\n1. a\n10. b\n100. c",
    "Lời nói đầu\nĐiều 5. Không chương\n1. x y z\ntiếp\n2.\nlạ", "Điều 1.\nĐiều 2. B\nnội dung\nĐiều 3. C", "Chương I\nĐiều 1. A\nChương II\nĐiều 2. B\nChương III\nChương IV\nHai\nĐiều 3. C",
    "Điều 1. Một", "  Điều 1. thụt lề\nkhông phải", "", None, "no headings\n\nat all", "Điều 7. x\r\n1. a\r\n2. b\r\n", "Điều 8. Dài\n" + "\n".join(f"{k}. " + "từ " * (3 * k) for k in range(1, 30)),
]


def made(seed):
    rng = random.Random(seed)
    lines = ["Chương I", "Chương  XIV ", "Chương", "Quy định chung", "", " ", "Điều 1. Một", "Điều 23.", "Điều 4. Bốn ", "1. a b c", "2. d", "12.\te f", "3.", "lời văn " * 9, "Điều này"]
    return "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 30)))


def test_same_chunks(spark):
    texts = FIXED + [made(k) for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for how, name, most in ((sections.parent_child, "parent_child", {}), (sections.structure_aware, "structure_aware", {"most": 20}), (sections.structure_aware, "structure_aware", {})):
        got = {}
        for r in how(docs, "doc_id", **most).collect():
            got.setdefault(r.doc_id, []).append((r.chunk_index, r.text, r.section, r.heading, r.asDict().get("parent_index"), r.token_count))
        for i, t in enumerate(texts):
            rows = chunking.STRATEGIES[name](t or "", **most) if chunking.articles(t or "") else []
            want = [(k, text, section, heading, parent, chunking.words(text)) for k, (text, section, heading, parent) in enumerate(rows)]
            assert sorted(got.get(i, []), key=lambda x: x[0]) == want, t


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame(list(enumerate(FIXED)), "doc_id long, text string")
    assert "Python" not in sections.parent_child(docs, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert sections.structure_aware(docs.where(F.lit(False)), "doc_id").count() == 0


def test_one_pass_over_each_text(spark):
    """No text is exchanged, and no step of the work is written out more than once in the plan."""
    docs = spark.createDataFrame(list(enumerate(FIXED)), "doc_id long, text string")
    for how in (sections.structure_aware, sections.parent_child):
        query = how(docs, "doc_id")._jdf.queryExecution()
        assert "Exchange" not in query.executedPlan().toString(), how
        plan = query.optimizedPlan().toString()
        # A count for bodies and one for clauses; an article's pattern marks it, and gives its number and title.
        assert plan.count(r"(?U)\S+") <= 2 and plan.count(sections.CLAUSE) == 1 and plan.count(sections.CHAPTER) == 1 and plan.count(sections.ARTICLE) == 3, how


def test_ends_and_long_articles(spark):
    """White space of all kinds at the ends of bodies, clauses and titles, many short clauses and many chapters, as the map has them."""
    blank = " \t\xa0\u1680\u2003\u202f\u3000 "
    texts = [
        f"Chương I\n{blank}Một{blank}\nĐiều 1. Hai{blank}\n1. a{blank}\n\n2. b c{blank}\n{blank}\nĐiều 2. Ba{blank}",
        "Điều 1. Dài\n" + "\n".join(f"{k % 90}. x y" for k in range(2000)),
        "\n".join(f"Chương X{'I' * (k % 4)}\n\n  Phần {k}\nĐiều {k}. a\n" + ("1. b\n2. c" if k % 3 else "") for k in range(400)),
        "Điều 1. Một\nChương I\nChương II\nHai\nĐiều 2. Ba\nĐiều 3. Bốn\nChương III",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for how, name, most in ((sections.parent_child, "parent_child", {}), (sections.structure_aware, "structure_aware", {"most": 5}), (sections.structure_aware, "structure_aware", {"most": 50})):
        for i, t in enumerate(texts):
            got = how(docs.where(F.col("doc_id") == i), "doc_id", **most).orderBy("chunk_index").collect()
            assert [(r.text, r.section, r.heading, r.asDict().get("parent_index")) for r in got] == chunking.STRATEGIES[name](t, **most), (name, i)
            assert [(r.chunk_index, r.token_count) for r in got] == [(k, chunking.words(r.text)) for k, r in enumerate(got)]
