from pyspark.sql import functions as F

from docmill.operators import boards, ordered
from docmill.plans.ordered_plans import _streamed
from docmill.streaming import state


def said(frame, *columns):
    return [tuple(r[c] for c in columns) for r in frame.orderBy("i").collect()]


def test_breaker_opens_half_opens_and_closes(spark):
    rows = spark.createDataFrame([(k, 0, float(at), ok) for k, (at, ok) in enumerate([(0, False), (1, False), (2, True), (3, False), (4, False), (5, True), (14, True), (15, True), (16, False)])], "i int, job int, at double, ok boolean")
    got = said(ordered.circuit_breaker(rows, "job", ["i"], threshold=3, timeout=10.0), "allowed", "state")
    assert got == [(True, "closed"), (True, "closed"), (True, "closed"), (True, "closed"), (True, "open"), (False, "open"), (True, "half_open"), (True, "closed"), (True, "closed")]
    assert ordered.circuit_breaker(rows.limit(0), "job", ["i"]).count() == 0


def test_refused_requests_are_not_counted(spark):
    rows = spark.createDataFrame([(k, None if k == 5 else "a", float(at)) for k, at in enumerate([0, 10, 20, 65, 66, 66])], "i int, ip string, at double")
    assert said(ordered.rate_limited(rows, "ip", ["i"], most=2), "allowed") == [(True,), (True,), (False,), (True,), (False,), (True,)]


def test_rates_and_context(spark):
    rows = spark.createDataFrame([(0, 1, "t", 0.0, 0, 10), (1, 1, "t", 10.0, 1, 10), (2, 1, "t", 40.0, 2, 10), (3, 1, "t", 45.0, 3, 10), (4, 1, "r", 50.0, 0, 4)], "i int, job int, phase string, at double, done int, total int")
    got = [x for (x,) in said(ordered.remaining_time(rows, "job", ["i"]), "seconds_left")]
    assert got[0] is None and got[1] == 90.0 and got[2] == 8 * 20.0 and abs(got[3] - 7 * (20 - 0.15 * 15)) < 1e-9 and got[4] is None
    used = spark.createDataFrame([(k, 1, u) for k, u in enumerate([100, 5000, 1000, 1000, 1000, 1000, 1000, 100])], "i int, job int, used int")
    assert [x for (x,) in said(ordered.adaptive_context(used, "job", ["i"]), "size")] == [2048, 6144, 6144, 6144, 6144, 6144, 4096, 4096]


def test_stream_is_the_batch(spark):
    rows = spark.range(600).selectExpr("CAST(id AS INT) AS i", "id % 7 AS job", "CAST(id AS DOUBLE) AS at", "id % 4 <> 0 AS ok")
    step, start = ordered.breaker_step(2, 30.0), lambda: ("closed", 0, 0, None)
    parts = [rows.where(F.col("i").between(a, a + 199)) for a in (0, 200, 400)]
    stream = _streamed(spark, parts, lambda s: state.folded_stream(s, "job", ["i"], step, start, "allowed boolean, state string"))
    batch = ordered.folded(rows, "job", ["i"], step, start, "allowed boolean, state string")
    assert said(stream, "i", "allowed", "state") == said(batch, "i", "allowed", "state")
    phases = spark.createDataFrame([(0, "a", "started", 1.0), (1, "b", "started", 2.0), (2, "a", "completed", 4.5), (3, "b", "failed", 2.5), (4, "a", "completed", 9.0)], "i int, key string, status string, at double")
    got = _streamed(spark, [phases.where("i < 2"), phases.where("i >= 2")], lambda s: state.phase_stream(s, "key", ["i"]))
    assert said(got, "i", "seconds") == [(0, None), (1, None), (2, 3.5), (3, 0.5), (4, None)]


def test_windowed_streams(spark):
    rows = spark.createDataFrame([(0, "x", "2024-01-01 00:00:01", 5, 0.5), (1, "x", "2024-01-01 00:04:00", 7, 0.5), (2, "x", "2024-01-01 00:06:00", 1, 0.1), (3, "", "2024-01-01 00:06:00", 1, 0.1)], "i int, translation_id string, at string, total_tokens long, total_cost_usd double").withColumn("created_at", F.to_timestamp("at")).drop("at")
    got = _streamed(spark, [rows], state.usage_windows, "complete").collect()
    assert sorted((r.translation_id, r.calls, r.total_tokens) for r in got) == [("x", 1, 1), ("x", 2, 12)]
    for seconds, sessions in ((120, [("", 1), ("x", 1), ("x", 2)]), (119, [("", 1), ("x", 1), ("x", 1), ("x", 1)])):  # a gap of 120
        idle = _streamed(spark, [rows], lambda s, n=seconds: state.stalled_stream(s, "translation_id", "created_at", n), "complete").collect()
        assert sorted((r.translation_id, r.events) for r in idle) == sessions
    cells = _streamed(spark, [rows.select("i", "created_at", F.lit(1).alias("row"), F.col("total_tokens").alias("output"))], lambda s: state.latest_cells(s, ["row"], "created_at"), "complete").collect()
    assert [(r.row, r.output) for r in cells] == [(1, 1)]


def test_structure_helpers(spark):
    v = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert v(ordered.reconciled(F.array(F.lit("a")), F.lit(3))) == ["a", "", ""] and v(ordered.reconciled(F.array(*map(F.lit, "abcd")), F.lit(2))) == ["a", "b c d"]
    assert v(ordered.placeholder_problem(F.lit("[id1] [id0]"), F.lit(2))) is None and v(ordered.placeholder_problem(F.lit(None).cast("string"), F.lit(1))) == "count"
    assert v(ordered.is_not_translatable(F.lit("I"))) is False and v(ordered.is_not_translatable(F.lit(" 1.2 "))) and v(ordered.is_not_translatable(F.lit(None).cast("string")))
    assert v(ordered.language_code(F.lit("en-US"))) == "en" and v(ordered.language_code(F.lit("Klingon"))) is None and v(ordered.is_right_to_left(F.lit(None).cast("string"))) is False
    assert v(ordered.goes_on(F.lit("A long enough fragment that was cut by the page-"), F.lit("break"))) and not v(ordered.goes_on(F.lit("Short."), F.lit("and so on it goes for long")))
    assert v(F.array_join(ordered.absent_names(F.array(F.lit("Mr Holmes"), F.lit("Li")), F.lit("the watson case")), ",")) == "Mr Holmes"


def test_prompts_and_runs(spark):
    rows = spark.createDataFrame([("p", 8.0, 8.0, 8.0, 8.0, True, False), ("p", 6.0, 6.0, 6.0, 6.0, True, False), ("p", 4.0, 4.0, 4.0, 4.0, True, True), ("p", 0.0, 0.0, 0.0, 0.0, False, False), ("q holmes", 5.0, 5.0, 5.0, 5.0, False, False)], "prompt string, accuracy double, fluency double, style double, overall double, success boolean, test boolean")
    got = {r.prompt: r for r in boards.fitness(rows).collect()}
    assert got["p"].train_score == 7.0 and got["p"].fitness == round(7 - 0.1 * 4 - 0.5 * 3, 6) and got["q holmes"].fitness == -0.05
    nothing = boards.merged_run(spark.createDataFrame([], "run string, started_at string, completed_at string"), spark.createDataFrame([], "run string, model string, language string"), ["a"])
    assert nothing.count() == 0 and boards.latest_run(spark.createDataFrame([], "run string, started_at string")).count() == 0
    texts = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "text string, ord int")
    assert sorted((r.fold, r.text, r.role) for r in boards.folds(texts, "ord", 5, None).collect()) == sorted((f, t, "test" if "abc"[f - 1] == t else "train") for f in (1, 2, 3) for t in "abc")
