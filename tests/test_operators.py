import itertools

import duckdb
import pytest

import __spark_entry__ as entry
from docmill.functions import text as T
from docmill.operators import chunking
from docmill.plans.registry import SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    result = duck.execute(SQL[name])
    cols = sorted(c[0] for c in result.description)
    assert sorted(got.columns) == cols
    order = [c[0] for c in result.description]
    flat = lambda v: round(float(v), 5) if isinstance(v, float) else v
    want = sorted((tuple(flat(dict(zip(order, r, strict=True))[c]) for c in cols) for r in result.fetchall()), key=str)
    assert sorted((tuple(flat(r[c]) for c in cols) for r in got.collect()), key=str) == want


def test_whole_text_is_carried(spark, tmp_path):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "long " * 50 + "end"), (1, 2, "assistant", "a"), (1, 3, "user", "next"), (2, 0, "assistant", "b")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = entry.queries()["w13_carried_text"](spark, str(tmp_path)).orderBy("conv_id", "turn").collect()
    assert [r.heading for r in got] == [None, rows[1][3], rows[1][3], "next", None]


def test_chunks_keep_every_word_under_the_limit():
    units = ["word " * n for n in (3, 50, 7, 400, 1, 1, 90)] + ["A sentence here. " * 60, "x" * 900]
    for most in (20, 60, 200):
        chunks = chunking.pack(units, most)
        assert "".join(itertools.chain(*[c.split() for c in chunks])) == "".join(itertools.chain(*[u.split() for u in units]))
        longest = max(chunking.tokens(s) for u in units for s in chunking.sentences(u))
        assert all(chunking.tokens(c) <= max(most, longest + int(most * 0.25) + 1) for c in chunks)


def test_chunks_have_context_and_keep_structured_lines(spark):
    rows = "\n".join(f"| {k}.5 | a. b |" for k in range(40))
    assert chunking.pack([rows], 90) == [rows]
    split = chunking.pack(["short", rows], 20)
    assert len(split) > 3 and "\n".join(split) == "short\n\n" + rows
    numbers = "Table 1\n" + "\n".join(["BLEU", "1.5", "2.75 %"] * 20)
    assert "\n".join(chunking.pack([numbers], 10)) == numbers
    text = "one two\n\nthree four\n\n" + "five " * 9 + "\n\nsix"
    got = chunking.chunked(spark.createDataFrame([(1, text), (2, None)], "d long, t string"), "d", "t", 10).orderBy("chunk_index").collect()
    assert [(r.context_before, r.context_after) for r in got] == [("", "five " * 9), ("three four", "six"), ("five " * 9, "")]


def test_methods_without_left_out_parts(spark):
    from pyspark.sql import functions as F

    from docmill.operators import ranking

    scan = "\n".join(["a line of text that is wrapped."] * 6)
    ocr = lambda t: spark.range(1).select(*[c.alias(k) for k, c in T.ocr_signals(F.lit(t)).items()]).first()
    assert (ocr(scan).ocr_score, ocr(scan).likely_scan) == (2, False)
    for mark in ("\x07", "\u200b", "\r"):
        assert (ocr(scan + mark).ocr_score, ocr(scan + mark).likely_scan) == (3, True)
    shares = spark.range(1).select(*[c.alias(k) for k, c in T.script_shares(T.script_counts(F.lit("ab Ж 日本語 한 1"))).items()]).first()
    assert (shares.latin, shares.cyrillic, shares.cjk, shares.hangul, shares.greek) == (2 / 7, 1 / 7, 3 / 7, 1 / 7, 0)
    said = lambda s, t: spark.range(1).select(T.semantic_issues(F.lit(s), F.lit(t)).alias("x")).first().x
    assert said("It is not so.", "It is so.") == "possible_negation_loss" and said("It is not so.", "It is never so.") == said("not", "") == ""
    assert said("no " + "word " * 40, "word") == "probable_semantic_omission,possible_negation_loss"
    long = "x" * 600 + " Holmes Watson"
    rows = [("p", 4.0, False), ("p", 2.0, False), ("p", 2.0, True), (long, 3.0, False), (long, 3.0, True), ("q", 2.0, False)]
    got = {r.prompt: r.fitness for r in ranking.penalized_fitness(spark.createDataFrame(rows, "prompt string, score double, test boolean")).collect()}
    assert got["p"] == round(3 - 0.1 * 4 / 3 - 0.5, 6) and got[long] == round(3 - 0.114 - 0.1, 6) and got["q"] == 1.0


def test_text_vectors(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        T.without_artifacts(F.lit("a​b ■ c□d ,x  y")).alias("clean"),
        T.without_page_lines(F.lit("one\n12\ntwo\nPage 13")).alias("pages"),
        T.detected_language(T.language_signals(F.lit("the cat and the dog"))).alias("en"),
        T.detected_language(T.language_signals(F.lit("привет"))).alias("ru"),
        T.sample_indices(F.lit(20), 3).alias("some"),
        T.sample_indices(F.lit(2), 3).alias("two"),
    ).first()
    assert row.clean == "ab c d,x y"
    assert row.pages == "one\n\ntwo\n"
    assert (row.en, row.ru) == ("English", "cyrillic")
    assert row.some == [5, 10, 14] and row.two == [0, 1]


def same_as_sql(spark, name, folder, tables):
    """The rows of a query on tables of one's own, checked against its SQL."""
    con = duckdb.connect()
    for t, rows in tables.items():
        rows.write.parquet(str(folder / f"{t}.parquet"))
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = sorted(map(tuple, entry.queries()[name](spark, str(folder)).collect()), key=str)
    assert got == sorted(con.execute(SQL[name]).fetchall(), key=str)
    return got


def test_page_text_decodes_what_its_sql_does(spark, tmp_path):
    pages = ["<title>a &amp;&amp</title><p>b</p>", "x &eacute; &#233; &lt &amp;lt; &#39; &copy;", None, "", "a\rb\x0bc\u2028d<br >e \u0085<p>\x0c f\u00a0</p >g</\x0bp>h", "<body>in</body>out"]
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    got = dict(same_as_sql(spark, "s13_page_text", tmp_path, {"pages": rows}))
    assert got[0] == "a &&amp b" and got[2] is None


def test_pairs_of_like_names_are_neither_merged_nor_moved(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey < 400")
    orders = rows.unionByName(rows.where("o_orderkey % 9 in (0, 8)"))
    got = same_as_sql(spark, "j02_later_same_name", tmp_path, {"orders": orders, "lineitem": spark.read.parquet(f"{SF}/lineitem.parquet").limit(1)})
    assert len(got) > len(set(got)) > 0
    plan = entry.queries()["j02_later_same_name"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan
