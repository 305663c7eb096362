"""Queries of ordered rows, structure helpers and streams, with the SQL that checks them.

Events of a user stand for a job's steps, attempts or requests (by event id), conversations for documents of units.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from docmill.operators import ordered as O
from docmill.plans.base import query, read
from docmill.plans.usage_plans import calls
from docmill.streaming import state as S

ATTEMPTS = {"user_id": "user_id", "event_id": "event_id", "at": "CAST(event_id AS DOUBLE)", "ok": "event_type <> 'error' AND event_id % 3 <> 0"}


def _events(spark, sf_dir, **columns):
    return read(spark, sf_dir, "events").selectExpr("user_id", "event_id", *[f"{e} AS {c}" for c, e in columns.items()])


BREAKER = """WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(event_id AS DOUBLE) AS t0, event_type <> 'error' AND event_id % 3 <> 0 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT user_id, 0::BIGINT AS event_id, 0::BIGINT AS n, 'closed' AS kind, 0 AS failures, 0 AS good, NULL::DOUBLE AS last, true AS allowed FROM e WHERE n = 1
  UNION ALL SELECT user_id, event_id, n, CASE WHEN NOT can THEN 'open' WHEN ok AND k2 = 'half_open' AND good + 1 >= 2 THEN 'closed' WHEN ok THEN k2 WHEN failures + 1 >= 3 THEN 'open' ELSE k2 END,
    CASE WHEN NOT can THEN failures WHEN ok AND k2 = 'half_open' AND good + 1 >= 2 THEN 0 WHEN ok AND k2 = 'half_open' THEN failures WHEN ok THEN greatest(0, failures - 1) ELSE failures + 1 END,
    CASE WHEN NOT can THEN good WHEN ok AND k2 = 'half_open' AND good + 1 >= 2 THEN 0 WHEN ok AND k2 = 'half_open' THEN good + 1 WHEN ok THEN good WHEN failures + 1 >= 3 THEN 0 ELSE good END,
    CASE WHEN can AND NOT ok THEN t0 ELSE last END, can
  FROM (SELECT e.*, f.failures, f.last, NOT (f.kind = 'open' AND e.t0 - f.last < 200) AS can, CASE WHEN f.kind = 'open' THEN 'half_open' ELSE f.kind END AS k2, CASE WHEN f.kind = 'open' AND e.t0 - f.last >= 200 THEN 0 ELSE f.good END AS good FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
SELECT user_id, event_id, allowed, kind AS state FROM f WHERE n > 0"""


@query(BREAKER)
def r04_circuit_breaker(spark, sf_dir):
    rows = _events(spark, sf_dir, at=ATTEMPTS["at"], ok=ATTEMPTS["ok"])
    return O.circuit_breaker(rows, "user_id", ["event_id"], threshold=3, timeout=200.0).select("user_id", "event_id", "allowed", "state")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(event_id AS DOUBLE) AS t0, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT user_id, 0::BIGINT AS event_id, 0::BIGINT AS n, []::DOUBLE[] AS kept, true AS allowed FROM e WHERE n = 1
  UNION ALL SELECT user_id, event_id, n, CASE WHEN len(k) >= 2 THEN k ELSE list_append(k, t0) END, len(k) < 2 FROM (SELECT e.*, list_filter(f.kept, lambda t: t > e.t0 - 500) AS k FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
SELECT user_id, event_id, allowed FROM f WHERE n > 0""")
def r05_rate_limited(spark, sf_dir):
    rows = _events(spark, sf_dir, at=ATTEMPTS["at"])
    return O.rate_limited(rows, "user_id", ["event_id"], most=2, window=500.0).select("user_id", "event_id", "allowed")


@query()
def r08_adaptive_context(spark, sf_dir):
    rows = _events(spark, sf_dir, used="CAST(value * 100 AS INT)")
    return O.adaptive_context(rows, "user_id", ["event_id"]).select("user_id", "event_id", "size")


@query()
def w06_remaining_time(spark, sf_dir):
    rows = _events(spark, sf_dir, at=ATTEMPTS["at"], phase="CASE WHEN event_id < 5000 THEN 'translating' ELSE 'refining' END", done="event_id % 5000", total="5000")
    return O.remaining_time(rows, "user_id", ["event_id"]).select("user_id", "event_id", F.round("seconds_left", 4).alias("seconds_left"))


BATCHES = """WITH RECURSIVE e AS (SELECT conv_id, turn, {size} AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f AS (SELECT conv_id, 0 AS turn, 0::BIGINT AS n, 0 AS batch, 0 AS units, 0::BIGINT AS size, 0 AS said FROM e WHERE n = 1
  UNION ALL SELECT conv_id, turn, n, b, CASE WHEN skip THEN units WHEN b > batch THEN 1 ELSE units + 1 END, CASE WHEN skip THEN size WHEN b > batch THEN own ELSE size + own END, CASE WHEN skip THEN -1 ELSE b END
  FROM (SELECT e.conv_id, e.turn, e.n, e.size AS own, f.batch, f.units, f.size, {skip} AS skip, f.batch + CASE WHEN NOT ({blank}) AND f.units > 0 AND (f.units >= 3 OR f.size + e.size > 900) THEN 1 ELSE 0 END AS b FROM f JOIN e ON e.conv_id = f.conv_id AND e.n = f.n + 1))
SELECT conv_id, turn, said AS batch FROM f WHERE n > 0"""


@query(BATCHES.format(size="length(text)", skip="false", blank="false"))
def y18_batches(spark, sf_dir):
    units = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return O.batched(units, "conv_id", ["turn"], 3, 900).select("conv_id", "turn", "batch")


@query(BATCHES.format(size="CASE WHEN turn % 3 = 0 THEN 0 ELSE length(text) END", skip="e.size = 0 AND f.units = 0", blank="e.size = 0"))
def k10_subtitle_blocks(spark, sf_dir):
    units = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, 0).otherwise(F.length("text")).alias("size"))
    return O.batched(units, "conv_id", ["turn"], 3, 900, blanks=True).select("conv_id", "turn", "batch")


CUES = "SELECT l_orderkey AS file, l_linenumber AS ord, l_partkey * 1000 + l_suppkey AS tie, CAST(l_linenumber AS STRING) AS number, concat('s', l_linenumber) AS start, concat('e', l_linenumber) AS stop, CASE WHEN l_partkey % 3 = 0 THEN concat('says ', l_partkey, '.') WHEN l_partkey % 3 = 1 THEN concat('Then ', l_partkey) ELSE concat('and ', l_partkey) END AS text FROM lineitem WHERE l_orderkey % 9 = 0"


def _cues(spark, sf_dir):
    read(spark, sf_dir, "lineitem").createOrReplaceTempView("docmill_lineitem")
    rows = spark.sql(CUES.replace("FROM lineitem", "FROM docmill_lineitem"))
    first = F.min_by(F.struct("number", "start", "stop", "text"), "tie")
    return rows.groupBy("file", "ord").agg(first.alias("c")).select("file", "ord", "c.*")


CUED = f"WITH RECURSIVE c0 AS ({CUES}), c AS (SELECT * FROM c0 QUALIFY row_number() OVER (PARTITION BY file, ord ORDER BY tie) = 1), "


@query(
    CUED
    + """e AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ord) AS n FROM c), f AS (SELECT file, 0::BIGINT AS n, -1 AS cue, NULL::VARCHAR AS held FROM e WHERE n = 1
  UNION ALL SELECT file, n, CASE WHEN j THEN cue ELSE cue + 1 END, CASE WHEN j THEN held || ' ' || text ELSE text END FROM (SELECT e.file, e.n, f.cue, f.held, e.text, f.held IS NOT NULL AND length(f.held) + length(e.text) + 1 <= 100 AND NOT regexp_matches(f.held, '[.!?]$') AND NOT regexp_matches(e.text, '^[A-Z]') AS j FROM f JOIN e ON e.file = f.file AND e.n = f.n + 1)),
g AS (SELECT f.file, f.cue, e.start, e.stop, e.text, e.ord FROM f JOIN e ON e.file = f.file AND e.n = f.n WHERE f.n > 0)
SELECT file, cue, min_by(start, ord) AS start, max_by(stop, ord) AS stop, string_agg(text, ' ' ORDER BY ord) AS text, count(*)::INT AS numbers FROM g GROUP BY 1, 2"""
)
def k11_merged_cues(spark, sf_dir):
    return O.merged_cues(_cues(spark, sf_dir), "file", "ord")


@query(CUED.replace("RECURSIVE ", "") + "x AS (SELECT 1) SELECT file, string_agg(number || chr(10) || start || ' --> ' || stop || chr(10) || text || chr(10), chr(10) ORDER BY ord) AS content FROM c GROUP BY 1")
def k12_subtitle_file(spark, sf_dir):
    return O.subtitle_file(_cues(spark, sf_dir), "file", "ord")


PHASES = "SELECT user_id AS job, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS phase, CASE event_id % 6 WHEN 0 THEN 'started' WHEN 1 THEN 'started' WHEN 2 THEN 'completed' WHEN 3 THEN 'completed' ELSE 'failed' END AS status, CAST(event_id AS DOUBLE) AS t0 FROM events"


@query(f"WITH p AS ({PHASES}), w AS (SELECT *, lead(status) OVER o AS s, lead(t0) OVER o AS a FROM p WINDOW o AS (PARTITION BY job, phase ORDER BY t0)) SELECT job, phase, t0 AS started_at, CASE WHEN s <> 'started' THEN s END AS ended, CASE WHEN s <> 'started' THEN a - t0 END AS seconds FROM w WHERE status = 'started'")
def r02_phase_times(spark, sf_dir):
    rows = _events(spark, sf_dir, at=ATTEMPTS["at"]).selectExpr("user_id AS job", "CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS phase", "CASE event_id % 6 WHEN 0 THEN 'started' WHEN 1 THEN 'started' WHEN 2 THEN 'completed' WHEN 3 THEN 'completed' ELSE 'failed' END AS status", "at")
    return O.phase_times(rows)


@query("WITH j AS (SELECT user_id AS job, max(event_id) AS last FROM events GROUP BY 1) SELECT job FROM j WHERE job % 3 <> 0 AND 12000 - last > 2300 AND job % 5 <> 0")
def r03_stalled_jobs(spark, sf_dir):
    jobs = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job")).agg(F.max("event_id").cast("double").alias("last_activity"))
    jobs = jobs.select("job", F.when(F.col("job") % 3 == 0, "paused").otherwise("running").alias("status"), F.when(F.col("job") % 5 != 0, F.col("last_activity")).alias("last_activity"))
    return O.stalled(jobs, F.lit(12000.0), 2300.0).select("job")


@query("SELECT event_id, least(100.0::DOUBLE, CASE WHEN event_id % 3 = 0 THEN r * 100.0 WHEN event_id % 2 = 0 THEN r * 40.0 ELSE 40.0 + r * 60.0 END) AS percent FROM (SELECT event_id, CASE WHEN event_id % 7 > 0 THEN least(event_id % 9 / (event_id % 7)::DOUBLE, 1.0) ELSE 0.0 END AS r FROM events)")
def w07_global_percent(spark, sf_dir):
    e = F.col("event_id")
    percent = O.global_percent(F.when(e % 2 == 0, "translating").otherwise("refining"), e % 9, e % 7, e % 3 != 0, 40.0)
    return read(spark, sf_dir, "events").select("event_id", percent.alias("percent"))


@query("WITH p AS (SELECT user_id, event_id, max(value) OVER w AS p, event_id * 2.0::DOUBLE AS e FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) SELECT user_id, event_id, p AS percent, round(CASE WHEN p >= 100 THEN 0.0 WHEN p > 0 THEN e * (100 - p) / p END, 4) AS seconds_left FROM p")
def w08_progress_snapshot(spark, sf_dir):
    out = O.progress_snapshot(read(spark, sf_dir, "events"), "user_id", "event_id", F.col("value"), F.col("event_id") * 2.0)
    return out.select("user_id", "event_id", "percent", F.round("seconds_left", 4).alias("seconds_left"))


MENTIONS = "WITH m AS (SELECT conv_id AS document, name AS entity, turn AS chunk, role AS section, count(*) AS n FROM (SELECT conv_id, turn, role, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS name FROM conversations) GROUP BY ALL), e AS (SELECT document, entity, min(chunk) AS first_chunk, max(chunk) AS last_chunk, CAST(sum(n) AS BIGINT) AS occurrences, count(DISTINCT section) AS sections FROM m GROUP BY 1, 2) "


def _memory(spark, sf_dir):
    names = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document"), F.col("turn").alias("chunk"), F.col("role").alias("section"), F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("entity"))
    return O.entity_memory(names.groupBy("document", "entity", "chunk", "section").agg(F.count("*").alias("n")))


@query(MENTIONS + "SELECT * FROM e")
def w09_entity_memory(spark, sf_dir):
    return _memory(spark, sf_dir)


RANK = "CASE WHEN last_chunk >= 6 THEN 90.0 ELSE 0.0 END + CASE length(entity) % 4 WHEN 0 THEN {character} WHEN 1 THEN {location} WHEN 2 THEN {organization} ELSE {other} END + least(occurrences, 40) * 0.75 + greatest(0.0, 18.0 - greatest(0, 8 - last_chunk) * 1.8) + 0.5 * 12.0 + CASE WHEN occurrences > 3 THEN 25.0 ELSE 0.0 END + CASE WHEN sections > 1 THEN 8.0 ELSE 0.0 END + least(occurrences * 10, 120) * 0.08"


def _ranked_entities(spark, sf_dir):
    last, n = F.col("last_chunk"), F.col("occurrences")
    category = F.element_at(F.array(*map(F.lit, ("character", "location", "organization", "other"))), F.length("entity") % 4 + 1)
    rank = O.entity_rank(last >= 6, category, n, F.greatest(F.lit(0), 8 - last), F.lit(0.5), n > 3, F.col("sections") > 1, n * 10)
    return _memory(spark, sf_dir).withColumn("rank", F.round(rank, 4))


RANKED = MENTIONS + ", k AS (SELECT document, entity, round(CAST(" + RANK.format(**{k: O.CATEGORY_RANK.get(k, O.OTHER_RANK) for k in ("character", "location", "organization", "other")}) + " AS DOUBLE), 4) AS rank FROM e) "


@query(RANKED + "SELECT * FROM k")
def w17_entity_rank(spark, sf_dir):
    return _ranked_entities(spark, sf_dir).select("document", "entity", "rank")


@query(RANKED + "SELECT document, entity, row_number() OVER (PARTITION BY document ORDER BY rank DESC, entity)::INT AS place FROM k QUALIFY place <= 5")
def w10_pruned_entities(spark, sf_dir):
    from docmill.operators.jobs import ranked_within

    return ranked_within(_ranked_entities(spark, sf_dir), ["document"], [F.desc("rank"), F.col("entity")], 5).select("document", "entity", "place")


VECTOR = r"SELECT conv_id, turn, least(80.0::DOUBLE, w / greatest(1, len(regexp_extract_all(t, '[.!?。！？]+')))::DOUBLE) AS sentence_words, least(30.0::DOUBLE, len(list_filter(regexp_split_to_array(t, '\n\s*\n'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g')) <> '')) * 1000.0::DOUBLE / w) AS paragraphs, least(30.0::DOUBLE, len(regexp_extract_all(t, '(?:^|\n)\s*(?:[-–—]|[\"“«])')) * 1000.0::DOUBLE / w) AS dialogue, least(40.0::DOUBLE, len(regexp_extract_all(t, '[;:]')) * 1000.0::DOUBLE / w) AS colons FROM (SELECT conv_id, turn, coalesce(text, '') AS t, greatest(1, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+(?:[''’-][\p{L}\p{N}_]+)*'))) AS w FROM conversations)"


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", *[c.alias(k) for k, c in O.style_vector(F.col("text")).items()])


def _rounded(names) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query(f"WITH v AS ({VECTOR}) SELECT conv_id, turn, {_rounded(O.STYLE_CAPS)} FROM v")
def x39_style_vector(spark, sf_dir):
    return _vectors(spark, sf_dir).select("conv_id", "turn", *[F.round(k, 6).alias(k) for k in O.STYLE_CAPS])


@query(f"WITH v AS ({VECTOR}) SELECT conv_id, turn, round(least(1.0::DOUBLE, sqrt((" + " + ".join(f"pow(({k} - lag({k}) OVER w) / {c}, 2)" for k, c in O.STYLE_CAPS.items()) + ") / 4)), 6) AS drift FROM v WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def w11_style_drift(spark, sf_dir):
    return O.style_drift(_vectors(spark, sf_dir), "conv_id", "turn").select("conv_id", "turn", F.round("drift", 6).alias("drift"))


@query("WITH p AS (SELECT a.conv_id, a.turn, list_distinct(regexp_extract_all(a.text, '[A-Z][a-z]{2,}')) AS names, lower(b.text) AS t FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1) SELECT conv_id, turn, len(list_filter(list_sort(names)[1:12], lambda n: NOT contains(t, lower(n)))) AS absent FROM p")
def w18_absent_names(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("t"))
    names = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{2,}"), F.lit(0))))
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.size(O.absent_names(names, F.col("t"))).cast("long").alias("absent"))


# Structure helpers ------------------------------------------------------------------------------------------------------

PARTS = "string_split(coalesce(text, ''), ' ')[1:doc_id % 6]"


@query(f"WITH p AS (SELECT doc_id, {PARTS} AS p FROM documents WHERE doc_id % 6 > 0) SELECT doc_id, CASE WHEN len(p) <= 3 THEN array_to_string(list_concat(p, list_resize([]::VARCHAR[], 3 - len(p), '')), '|') ELSE p[1] || '|' || p[2] || '|' || array_to_string(p[3:], ' ') END AS paragraphs FROM p")
def j13_reconciled(spark, sf_dir):
    parts = F.slice(F.split(F.coalesce("text", F.lit("")), " "), F.lit(1), (F.col("doc_id") % 6).cast("int"))
    return read(spark, sf_dir, "documents").where("doc_id % 6 > 0").select("doc_id", F.array_join(O.reconciled(parts, F.lit(3)), "|").alias("paragraphs"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'translation,review,audit' WHEN o_orderkey % 3 = 0 THEN 'review,audit' WHEN o_orderkey % 5 = 0 THEN 'audit' ELSE '' END AS stages FROM orders")
def y20_invalidated(spark, sf_dir):
    k = F.col("o_orderkey")
    now = {"translation": F.when(k % 2 == 0, "new").otherwise("old"), "review": F.when(k % 3 == 0, F.lit(None)).otherwise("old"), "audit": F.when(k % 5 == 0, "new").otherwise("old")}
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(O.invalidated(dict.fromkeys(now, F.lit("old")), now), ",").alias("stages"))


@query("SELECT doc_id, 'epub:' || coalesce(source, '') || ':' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || ':' || sha256(coalesce(source, '') || chr(0) || doc_id || chr(0) || lang)[1:24] AS unit FROM documents")
def y19_stable_unit_id(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", O.stable_unit_id(F.coalesce("source", F.lit("")), F.col("doc_id"), F.col("lang")).alias("unit"))


HOLDERS = "CASE doc_id % 4 WHEN 0 THEN '[id0] a [id1]' WHEN 1 THEN '[id1] [id0]' WHEN 2 THEN '[id0] [id2]' ELSE '[id0]' END"


@query("SELECT doc_id, CASE doc_id % 4 WHEN 2 THEN 'order' WHEN 3 THEN 'count' END AS problem, CASE doc_id % 4 WHEN 2 THEN '[id1]' WHEN 3 THEN '[id1]' ELSE '' END AS missing FROM documents")
def y10_placeholders(spark, sf_dir):
    text = F.expr(HOLDERS)
    return read(spark, sf_dir, "documents").select("doc_id", O.placeholder_problem(text, F.lit(2)).alias("problem"), F.array_join(O.missing_placeholders(text, F.array(F.lit("[id0]"), F.lit("[id1]"))), ",").alias("missing"))


@query("SELECT doc_id, doc_id % 5 < 3 AS fixed FROM documents")
def y13_not_translatable(spark, sf_dir):
    text = F.expr("CASE doc_id % 5 WHEN 0 THEN concat(' ', doc_id, '. (2)–3 ') WHEN 1 THEN ' ' WHEN 2 THEN NULL WHEN 3 THEN '...' ELSE concat('mix ', doc_id) END")
    return read(spark, sf_dir, "documents").select("doc_id", O.is_not_translatable(text).alias("fixed"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'ar' END AS code, doc_id % 4 = 2 AS rtl FROM documents")
def y15_language_code(spark, sf_dir):
    language = F.expr("CASE doc_id % 4 WHEN 0 THEN 'en-US' WHEN 1 THEN ' French ' WHEN 2 THEN 'Arabic' ELSE 'Klingon' END")
    return read(spark, sf_dir, "documents").select("doc_id", O.language_code(language).alias("code"), O.is_right_to_left(language).alias("rtl"))


SEAM = "CASE doc_id % 3 WHEN 0 THEN concat(repeat('word ', 10), 'split-') WHEN 1 THEN concat(repeat('word ', 10), 'end.') ELSE repeat('word ', 10) END"


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE true END AND doc_id % 2 = 0 AS goes_on FROM documents")
def y01_goes_on(spark, sf_dir):
    after = F.expr("CASE WHEN doc_id % 2 = 0 THEN '  ting and so it goes on' ELSE 'Ting and so it goes on' END")
    return read(spark, sf_dir, "documents").select("doc_id", O.goes_on(F.expr(SEAM), after).alias("goes_on"))


@query("SELECT event_id, greatest(event_id + greatest(0.0::DOUBLE, event_id % 7 - 3.0), CASE WHEN event_id % 5 = 0 THEN event_id + 2.0::DOUBLE ELSE event_id END) AS at FROM events")
def y27_resume_at(spark, sf_dir):
    e = F.col("event_id").cast("double")
    return read(spark, sf_dir, "events").select("event_id", O.resume_at(e, F.col("event_id") % 7 - 3.0, F.when(F.col("event_id") % 5 == 0, e + 2.0)).alias("at"))


# Streams: the same results as over the table ----------------------------------------------------------------------------


def _streamed(spark, frames, build, mode="append"):
    """The rows that a stream of files, which are written one frame after another, gives until they are used up. The files
    and the stream's checkpoint lie in the shared folder, or in a temporary one where none is set and all runs on one machine."""
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    shared = shared or tempfile.mkdtemp()
    at, name = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}", f"docmill_{uuid.uuid4().hex}"
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    run = build(stream).writeStream.format("parquet" if mode == "append" else "memory").outputMode(mode).option("checkpointLocation", f"{at}/state")
    run = (run.option("path", f"{at}/out") if mode == "append" else run.queryName(name)).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{at}/out") if mode == "append" else spark.table(name)


@query(BREAKER)
def r04_circuit_breaker_stream(spark, sf_dir):
    rows = _events(spark, sf_dir, at=ATTEMPTS["at"], ok=ATTEMPTS["ok"])
    cuts = [-1, *rows.approxQuantile("event_id", [0.25, 0.5, 0.75], 0.01), 1 << 60]
    parts = [rows.where((F.col("event_id") > a) & (F.col("event_id") <= b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    fold = lambda s: S.folded_stream(s, "user_id", ["event_id"], O.breaker_step(3, 200.0), lambda: ("closed", 0, 0, None), "allowed boolean, state string")
    return _streamed(spark, parts, fold).select("user_id", "event_id", "allowed", "state")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS calls, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT) + CAST(json_extract_string(props, '$.k') AS BIGINT) % 7) AS BIGINT) AS total_tokens FROM events GROUP BY 1")
def g09_daily_stream(spark, sf_dir):
    rows = calls(spark, sf_dir).withColumn("created_at", F.col("created_at").cast("timestamp"))
    return _streamed(spark, [rows.where(F.col("event_id") % 3 == k) for k in range(3)], lambda s: S.daily_usage(s, "40 days"), "complete")
