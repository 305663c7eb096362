"""Queries that SQL cannot say, against plain Python."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docmill.functions import cleaning as C
from docmill.functions import segments as S
from docmill.operators import boards, chunking, more

SF = "/root/testdata/sf0.001"


def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


def test_chunks_and_their_statistics(spark):
    rows = [(i, [c for c in chunking.pack([p for p in (t or "").split("\n") if p.strip()], 400)]) for i, t in documents()]
    got = {}
    for r in entry.queries()["k01_chunks"](spark, SF).collect():
        got.setdefault(r.doc, {})[r.chunk_index] = r.content
    assert {i: [got[i][k] for k in range(len(got[i]))] for i in got} == {i: c for i, c in rows if c}
    sizes = [chunking.tokens(x) for _, c in rows for x in c]
    told = entry.queries()["k06_chunk_stats"](spark, SF).first()
    assert (told.chunks, told.min_tokens, told.max_tokens) == (len(sizes), min(sizes), max(sizes))
    assert told.mean_tokens == pytest.approx(sum(sizes) / len(sizes), abs=1e-3) and told.within_percent == pytest.approx(100 * sum(s <= 400 for s in sizes) / len(sizes), abs=1e-3)
    packed = {r.doc: r.chunks for r in entry.queries()["k04_packed_units"](spark, SF).collect()}
    assert packed == {i: n for i, t in documents() if (n := len(chunking.pack([p for p in (t or "").split("\n") if p.strip()], 120)))}


def test_packing_by_its_rules():
    """No chunk is over the limit but what cannot be divided, none but the last or a lead is under the floor without cause,
    and no word is lost."""
    rnd = random.Random(7)
    for _ in range(300):
        units = [" ".join("ab"[: rnd.randrange(1, 3)] for _ in range(rnd.choice([2, 9, 30, 120]))) + rnd.choice(["", ".", ". And so. On."]) for _ in range(rnd.randrange(1, 9))]
        most = rnd.choice([10, 40])
        chunks = chunking.pack(units, most)
        assert " ".join(chunks).split() == " ".join(units).split()
        longest = max((chunking.tokens(s) for u in units for s in chunking.sentences(u)), default=0)
        assert all(chunking.tokens(c) <= max(most, longest + most // 4 + 1) for c in chunks)
        small = [u for u in units if chunking.tokens(u) <= most]
        if small == units:
            assert all(chunking.tokens(a) + chunking.tokens(b.split("\n\n")[0]) > most for a, b in zip(chunks, chunks[1:], strict=False))


def spread(text, size, most):
    value = re.sub(r"\s+", " ", text or "").strip()
    if not value or len(value) <= size:
        return [value] if value else []
    count = min(most, max(1, len(value) // size))
    if count == 1:
        return [value[:size]]
    out = []
    stride = (len(value) - size) / (count - 1)
    for k in range(count):
        at = round(k * stride)
        end = min(len(value), at + size)
        blank = value.rfind(" ", max(0, at - 100), at + 1) if at else -1
        after = value.find(" ", end, min(len(value), end + 100)) if end < len(value) else -1
        out.append(value[blank + 1 if blank >= 0 else at : after if after >= 0 else end].strip())
    return [c for c in out if c]


def test_spread_chunks(spark):
    rows = [*documents(), (-1, None), (-2, " "), (-3, "x" * 1200)]
    docs = spark.createDataFrame(rows, "i long, t string").withColumn("v", S.compact(F.col("t")))
    got = {r.i: r.c for r in docs.select("i", S.spread_chunks(F.col("v"), 500, 8).alias("c")).collect()}
    assert got == {i: spread(t, 500, 8) for i, t in rows}


def test_layouts_and_editorial_text(spark):
    text = "Head\fTitle of it\r\nPage 3 of 9\n-----\n12.\nA bro-\nken word.\nIntro ........ 4\n***bold*** end\n"
    got = spark.range(1).select(C.layout(F.lit(text), strip_style=True).alias("a"), C.layout(F.lit(text), pages=False).alias("b"), C.editorial(F.lit("ﬁne\xa0text\t here \n\n\n\n\n100. 5 <TRANSLATION>\x07")).alias("e"), C.cleaned(F.lit(None).cast("string")).alias("n")).first()
    assert got.a == "Head\n\nTitle of it\nA broken word.\nIntro 4\nbold end" and "12." in got.b and "***bold***" in got.b
    assert got.e == "fine text here\n\n1005" and got.n == ""


def test_names_and_generations(spark):
    docs = spark.createDataFrame([(1, "Dr Watson met Holmes. Holmes and Watson met Mary of Scots."), (2, None)], "i long, t string")
    got = {r.name: r.weight for r in more.weighted_names(docs, "i", "t").collect()}
    assert got["Watson"] >= 3 and got["Holmes"] == 1 and "Mary of Scots" in got
    population = spark.createDataFrame([(f"p{k}", k / 10) for k in range(20)], "prompt string, fitness double")
    one, two = (sorted(map(tuple, boards.next_generation(p, 3, 12).collect())) for p in (population, population.repartition(4)))
    assert one == two and [r[1] for r in one[:3]] == ["p19", "p18", "p17"] and len(one) == 12
    fit = {f"p{k}": k for k in range(20)}
    drawn = {r.slot: r.prompt for r in boards.tournament(population, spark.range(30).withColumnRenamed("id", "slot"), 20).collect()}
    assert set(drawn.values()) == {"p19"} and sum(fit[r[1]] for r in one[3:]) / 9 > 10


def test_rows_alike_and_null_keys(spark):
    from docmill.operators import ranking, rows

    given = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z"), (None, 1, "w")], "k string, o int, v string")
    assert sorted(((r.k, r.v) for r in rows.latest(given, ["k"], ["o"]).collect()), key=str) == [("a", "y"), (None, "z")]
    assert sorted(((r.k, r.v) for r in rows.first_wins(given, ["k"], ["o"]).collect()), key=str) == [("a", "x"), (None, "w")]
    assert rows.latest(given.limit(0), ["k"], ["o"]).count() == 0
    old = spark.createDataFrame([(" A ",)], "v string")
    new = spark.createDataFrame([("a", 1), ("B", 2), ("b ", 3), (" ", 4), (None, 5)], "v string, o int")
    assert [r.v for r in rows.insert_absent(new, old, F.col("v"), ["o"]).collect()] == ["B"]
    values = spark.createDataFrame([("a", v) for v in (5, 1, 3, None, 9, 7)] + [("b", 2), ("c", None)], "k string, v int")
    for percent, want in ((0, {"a": 1, "b": 2}), (50, {"a": 5, "b": 2}), (90, {"a": 9, "b": 2}), (100, {"a": 9, "b": 2})):
        assert {r.k: r.v for r in ranking.nearest_rank(values, "k", "v", percent).collect()} == want
    long = "the same long output " * 8
    units = spark.createDataFrame([(1, "s", long), (2, "s", long.upper()), (3, "t", f" {long}"), (4, "u", "short"), (5, None, long), (6, "v", None)], "u int, s string, t string")
    assert sorted((r.u, r.holder) for r in rows.duplicate_outputs(units, "u", F.col("s"), F.col("t")).collect()) == [(3, 1), (5, 1)]
