"""Queries of document structure, files, memory, rules and reports, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions import cleaning as C
from docmill.functions import pairs as P
from docmill.functions import structure as B
from docmill.functions import text as T
from docmill.operators import boards, chunking, glossary, ledger, more, ordered, ranking, rows
from docmill.plans.base import query, read
from docmill.plans.quality_plans import PAIR, pair_rows
from docmill.plans.usage_plans import C as CALLED
from docmill.plans.usage_plans import USED, calls
from docmill.sources import readers

# Structure: documents with blocks of each kind put in -------------------------------------------------------------------

PUT = {
    "watermark": "'OceanofPDF.com'",
    "junk_link": "'https://example.org/x'",
    "clean": "'[A label](https://a.b/c)'",
    "header_footer": "'Page 12 of 300'",
    "note": "concat('[', doc_id % 90, '] what the note says of it')",
    "critical_apparatus": "'Smith, J., op. cit. and others'",
    "glossary": "concat('ka: the first', chr(10), 'ba: the second', chr(10), 'ren: the third name')",
    "table": "concat('| a | b |', chr(10), '| 1 | 2 |')",
    "formula": "'$$ x = y $$'",
    "toc": "concat('One ..... 3', chr(10), 'Two ..... 9')",
    "title": "concat('THE CHAPTER ', 'OF IT')",
}
BLOCKS = "concat(" + ", chr(10), chr(10), ".join(f"CASE WHEN doc_id % 3 <> {k % 3} THEN {v} ELSE 'x y z and so on, it goes' END" for k, v in enumerate(PUT.values())) + ", chr(10), ' ', chr(10), 'the plain end of it, as it is')"
KINDS = {"clean": "junk_link"}
POLICY = {"watermark": "exclude", "junk_link": "exclude", "clean": "clean", "header_footer": "exclude", "note": "translate", "critical_apparatus": "preserve", "glossary": "translate", "table": "reconstruct", "formula": "preserve", "toc": "reconstruct", "title": "translate"}
TOLD = "WITH b AS (" + " UNION ALL ".join(f"SELECT doc_id, {k} AS block, CASE WHEN doc_id % 3 <> {k % 3} THEN '{KINDS.get(n, n)}' ELSE 'narrative' END AS type, CASE WHEN doc_id % 3 <> {k % 3} THEN '{POLICY[n]}' ELSE 'translate' END AS policy, CASE WHEN doc_id % 3 <> {k % 3} THEN {v} ELSE 'x y z and so on, it goes' END AS text FROM documents" for k, (n, v) in enumerate(PUT.items())) + f" UNION ALL SELECT doc_id, {len(PUT)}, 'narrative', 'translate', 'the plain end of it, as it is' FROM documents) "


def _blocks(spark, sf_dir):
    return B.classified(read(spark, sf_dir, "documents").selectExpr("doc_id", f"{BLOCKS} AS t"), "doc_id", "t")


@query(TOLD + "SELECT doc_id, block, type, policy FROM b")
def f01_block_kinds(spark, sf_dir):
    return _blocks(spark, sf_dir).select("doc_id", "block", "type", "policy")


@query(r"WITH l AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\n(?:\s*\n)+'), lambda b: regexp_matches(b, '[^\s\x{00A0}]'))) AS blocks FROM documents) SELECT * FROM l WHERE blocks > 0")
def f02_line_blocks(spark, sf_dir):
    return B.line_blocks(read(spark, sf_dir, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("blocks"))


HELD = {"table": lambda t, x: B.is_table(x), "formula": B.is_formula, "toc": lambda t, x: B.is_toc(x), "note": lambda t, x: B.is_note(x), "glossary": B.is_glossary, "critical_apparatus": B.is_apparatus, "title": lambda t, x: B.is_title(x)}


def _held(kind: str):
    def run(spark, sf_dir):
        held = HELD[kind](F.col("text"), F.split("text", "\n"))
        return _blocks(spark, sf_dir).where(F.col("type").isin(kind, "narrative")).select("doc_id", "block", held.alias("held"))

    return run


for _n, _k in enumerate(HELD, 3):
    _run = _held(_k)
    _run.__name__ = f"f{_n:02d}_is_{_k}"
    query(TOLD + f"SELECT doc_id, block, type = '{_k}' AS held FROM b WHERE type IN ('{_k}', 'narrative')")(_run)


@query(TOLD + "SELECT doc_id, md5(string_agg(CASE WHEN policy = 'clean' THEN 'A label' ELSE text END, chr(10) || chr(10) ORDER BY block)) AS digest FROM b WHERE policy <> 'exclude' GROUP BY 1")
def f10_with_policies(spark, sf_dir):
    return B.with_policies(_blocks(spark, sf_dir), "doc_id").select("doc_id", F.md5("text").alias("digest"))


@query(TOLD + "SELECT doc_id, type, policy, count(*) AS blocks FROM b GROUP BY 1, 2, 3")
def f11_block_counts(spark, sf_dir):
    return B.block_counts(_blocks(spark, sf_dir), "doc_id")


@query(TOLD + "SELECT doc_id, md5(string_agg(CASE WHEN policy = 'clean' THEN 'A label' ELSE text END, chr(10) || chr(10) ORDER BY block)) AS digest, count(*)::INT AS blocks FROM b WHERE policy <> 'exclude' GROUP BY 1")
def p02_structured_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").selectExpr("doc_id", f"{BLOCKS} AS t").withColumn("t", C.repaired_numbers(F.col("t"))[0])
    return B.with_policies(B.classified(docs, "doc_id", "t"), "doc_id").select("doc_id", F.md5("text").alias("digest"), "blocks")


# Parts with entries of their own ------------------------------------------------------------------------------------------

_SHARES = ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {k}" for k, p in T.SCRIPTS.items())


@query(f"WITH c AS (SELECT doc_id, {_SHARES} FROM documents), t AS (SELECT *, {' + '.join(T.SCRIPTS)} AS total, greatest({', '.join(T.SCRIPTS)}) AS best FROM c) SELECT doc_id, CASE WHEN best = 0 THEN '' {' '.join(f'WHEN {k} = best THEN {chr(39)}{k}{chr(39)}' for k in T.SCRIPTS)} END AS script, CASE WHEN total > 0 THEN best / total::DOUBLE ELSE 0 END AS ratio FROM t")
def f14_dominant_script(spark, sf_dir):
    counts = read(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in T.script_counts(F.col("text")).items()])
    best = F.greatest(*[F.col(k) for k in T.SCRIPTS])
    name = F.lit("")
    for k in reversed(T.SCRIPTS):
        name = F.when((best > 0) & (F.col(k) == best), k).otherwise(name)
    total = sum((F.col(k) for k in T.SCRIPTS), F.lit(0))
    return counts.select("doc_id", name.alias("script"), F.when(total > 0, best / total).otherwise(0.0).alias("ratio"))


@query("SELECT event_id, CASE WHEN value / 10 >= 9 THEN 'excellent' WHEN value / 10 >= 7 THEN 'good' WHEN value / 10 >= 5 THEN 'acceptable' WHEN value / 10 >= 3 THEN 'poor' ELSE 'failed' END AS label FROM events")
def f40_score_label(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", ranking.score_bucket(F.col("value") / 10).alias("label"))


@query("SELECT doc_id, doc_id % 5 = 0 AS marker_page FROM documents WHERE doc_id > 2200 OR doc_id < 900")
def f19_page_markers(spark, sf_dir):
    from docmill.functions.segments import page_markers

    text = F.expr("CASE WHEN doc_id % 5 = 0 THEN concat('a', chr(10), doc_id % 800 + 1, chr(10), '1984') ELSE concat('a ', doc_id, chr(10), '1999', chr(10), '0') END")
    return read(spark, sf_dir, "documents").where("doc_id > 2200 OR doc_id < 900").select("doc_id", (page_markers(text) > 0).alias("marker_page"))


@query("SELECT doc_id, doc_id % 4 < 2 AS heading FROM documents")
def f37_heading_lines(spark, sf_dir):
    line = F.expr("CASE doc_id % 4 WHEN 0 THEN concat('Chapter ', doc_id) WHEN 1 THEN '2.1 the method of it' WHEN 2 THEN 'it ends here.' ELSE 'x = y + 2' END")
    return read(spark, sf_dir, "documents").select("doc_id", C._mapped(C.is_heading, "boolean")(line).alias("heading"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 2 THEN '[id1]' WHEN 3 THEN '[id1]' ELSE '' END AS missing FROM documents")
def u05_missing_placeholders(spark, sf_dir):
    text = F.expr("CASE doc_id % 4 WHEN 0 THEN '[id0] a [id1]' WHEN 1 THEN '[id1] [id0]' WHEN 2 THEN '[id0] [id2]' ELSE '[id0]' END")
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(ordered.missing_placeholders(text, F.array(F.lit("[id0]"), F.lit("[id1]"))), ",").alias("missing"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'británico' || p_partkey WHEN p_partkey % 3 = 1 THEN 'rojo,roja,rojas,rojos' ELSE 'papel,papeles' END AS forms FROM part WHERE p_partkey % 3 > 0")
def x19_target_forms(spark, sf_dir):
    target = F.expr("CASE WHEN p_partkey % 3 = 1 THEN ' rojo ' ELSE 'papel' END")
    return read(spark, sf_dir, "part").where("p_partkey % 3 > 0").select("p_partkey", F.array_join(glossary.target_alternatives(target), ",").alias("forms"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 1.25::DOUBLE + least(length(l_returnflag) * 50, 40) / 80.0::DOUBLE AS score FROM lineitem")
def x21_candidate_score(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", glossary.candidate_score(F.lit("character"), F.col("l_quantity"), F.repeat("l_returnflag", F.lit(50))).alias("score"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(0.15::DOUBLE, least(0.98::DOUBLE, 1 - exp(-(l_quantity % 9) / 4.0::DOUBLE) + 0.08 + least(l_quantity, 10.0) / 80.0::DOUBLE)), 9) AS confidence FROM lineitem")
def x22_candidate_confidence(spark, sf_dir):
    found = glossary.candidate_confidence(F.col("l_quantity"), F.col("l_quantity") % 9, F.lit("acronym"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(found, 9).alias("confidence"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 >= 3 AND doc_id % 3 <= 1 THEN 'paragraph_collapse' ELSE 'none' END AS code FROM documents")
def x63_collapse(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce(P.collapse_issue(F.col("doc_id") % 7, F.col("doc_id") % 3)["code"], F.lit("none")).alias("code"))


@query("SELECT doc_id, doc_id % 4 < 2 AS rtl FROM documents")
def y16_right_to_left(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", ordered.is_right_to_left(F.expr("CASE doc_id % 4 WHEN 0 THEN 'ar-SA' WHEN 1 THEN ' Hebrew' WHEN 2 THEN 'en' ELSE NULL END")).alias("rtl"))


@query("SELECT conv_id, count(*) = count(DISTINCT turn) AND max(turn) = count(*) - 1 AND min(turn) = 0 AS resumable FROM conversations GROUP BY 1")
def y21_resume_prefix(spark, sf_dir):
    told = rows.completed_prefix(read(spark, sf_dir, "conversations"), "conv_id", "turn", F.lit(True))
    return told.select("conv_id", (F.col("prefix") == F.col("chunks")).alias("resumable"))


@query("SELECT conv_id, bool_and(turn % 5 <> 4) AS publishable FROM conversations GROUP BY 1")
def y22_publishable(spark, sf_dir):
    state = F.when(F.col("turn") % 5 == 4, "failed").otherwise("approved")
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.every(state.isin("approved", "exported")).alias("publishable"))


@query("SELECT user_id, round(sum(CASE WHEN event_type <> 'error' THEN event_id % 90 ELSE 0 END) / nullif(sum(CASE WHEN event_type <> 'error' THEN event_id % 7 + 1 ELSE 0 END), 0)::DOUBLE, 6) AS rate FROM events GROUP BY 1")
def y26_token_rate(spark, sf_dir):
    done = F.col("event_type") != "error"
    sums = read(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.when(done, F.col("event_id") % 90).otherwise(0)).alias("t"), F.sum(F.when(done, F.col("event_id") % 7 + 1).otherwise(0)).alias("s"))
    return sums.select("user_id", F.round(F.try_divide(F.col("t"), F.col("s")), 6).alias("rate"))


@query("WITH k AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM events) SELECT event_type, event_id FROM k WHERE n <= CASE event_type WHEN 'error' THEN 3 ELSE 7 END")
def y33_top_per_bucket(spark, sf_dir):
    return more.top_per_bucket(read(spark, sf_dir, "events"), "event_type", [F.desc("value"), F.col("event_id")], {"error": 3}, 7).select("event_type", "event_id")


@query("SELECT event_type, count(*) AS n, count(*) >= CASE event_type WHEN 'error' THEN 1000000 ELSE 40 END AS saturated FROM events GROUP BY 1")
def y32_saturation(spark, sf_dir):
    return more.saturation(read(spark, sf_dir, "events"), "event_type", {"error": 1_000_000})


@query("SELECT event_type, count_if(event_id % 4 = 0 AND value >= 50) AS kept, count_if(event_id % 4 = 1) AS rejected, count_if(event_id % 4 > 1) AS open FROM events GROUP BY 1")
def y34_review_summary(spark, sf_dir):
    state = F.col("event_id") % 4
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if((state == 0) & (F.col("value") >= 50)).alias("kept"), F.count_if(state == 1).alias("rejected"), F.count_if(state > 1).alias("open"))


@query("SELECT user_id, count_if(event_id % 3 = 0) AS accepted, count_if(event_id % 3 = 1) AS warned, count_if(event_id % 3 = 2) AS rejected FROM events GROUP BY 1")
def g36_refinement_counts(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, ("accepted", "warned", "rejected"))), (F.col("event_id") % 3 + 1).cast("int"))
    return boards.decision_counts(read(spark, sf_dir, "events").withColumn("decision", said), "user_id")


LONGEST = "list_max(list_transform(string_split(p_name || '|' || p_type, '|'), lambda x: length(trim(x))))"


@query(f"SELECT p_partkey, {LONGEST}::INT AS size, row_number() OVER (PARTITION BY p_brand ORDER BY {LONGEST} DESC, p_partkey)::INT AS place FROM part")
def t02_longest_first(spark, sf_dir):
    from pyspark.sql.window import Window as W

    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", glossary.longest(F.concat_ws("|", "p_name", "p_type")).alias("size"))
    return part.select("p_partkey", "size", F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("size"), "p_partkey")).alias("place"))


@query(CALLED + f", t AS (SELECT translation_id, {USED}, max(created_at) AS last_seen FROM c WHERE translation_id <> '' GROUP BY 1) SELECT translation_id, calls FROM t ORDER BY calls % 2, last_seen DESC, translation_id LIMIT 20")
def t08_live_order(spark, sf_dir):
    t = ledger.by_translation_whole(calls(spark, sf_dir))
    return t.orderBy(F.col("calls") % 2, F.desc("last_seen"), "translation_id").limit(20).select("translation_id", "calls")


@query(CALLED + f"SELECT 'process' AS part, process_type AS name, {USED} FROM c GROUP BY 2 UNION ALL SELECT 'model', provider || '/' || model, {USED} FROM c GROUP BY 2 UNION ALL SELECT 'phase', coalesce(nullif(phase, ''), nullif(process_type, ''), 'unknown'), {USED} FROM c GROUP BY 2 UNION ALL SELECT 'day', CAST(CAST(created_at AS DATE) AS VARCHAR), {USED} FROM c GROUP BY 2")
def p06_usage_summary(spark, sf_dir):
    """All breakdowns from one scan: grouping sets over their names."""
    c = calls(spark, sf_dir)
    names = F.array(*[F.struct(F.lit(p).alias("part"), n.alias("name")) for p, n in (("process", F.col("process_type")), ("model", F.concat_ws("/", "provider", "model")), ("phase", ledger.filled("phase", "process_type", default="unknown")), ("day", F.to_date("created_at").cast("string")))])
    return c.withColumn("_n", F.explode(names)).groupBy("_n.part", "_n.name").agg(*ledger.whole_usage("total_cost_usd"))


# Memory, terms, rules -----------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(coalesce(text, ''), '[\s\x{00A0}]+', ' ', 'g'), '^ | $', '', 'g')) AS digest FROM documents")
def x35_memory_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(more.memory_text(F.col("text")), 256).alias("digest"))


SAFE = "'api_token=[redacted]' || chr(31) || 'glossary_terms=' || sha256(lang) || chr(31) || 'style=' || coalesce(source, '')"
NORMAL = r"regexp_replace(regexp_replace(coalesce({}, ''), '[\s\x{{00A0}}]+', ' ', 'g'), '^ | $', '', 'g')"


@query(f"SELECT doc_id, {SAFE} AS options FROM documents")
def x36_safe_options(spark, sf_dir):
    given = F.create_map(F.lit("style"), F.coalesce("source", F.lit("")), F.lit("api_token"), F.col("lang"), F.lit("glossary_terms"), F.col("lang"), F.lit("_fidelity_report"), F.lit("7"))
    entries = F.transform(F.array_sort(F.map_entries(more.safe_options(given))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(entries, "\x1f").alias("options"))


KEY = f"sha256(sha256({NORMAL.format('text')}) || chr(30) || sha256({NORMAL.format('lang')} || chr(30)) || chr(30) || sha256({SAFE}) || chr(30) || 'en' || chr(30) || coalesce(source, ''))"


def _keyed(spark, sf_dir):
    given = F.create_map(F.lit("style"), F.coalesce("source", F.lit("")), F.lit("api_token"), F.col("lang"), F.lit("glossary_terms"), F.col("lang"), F.lit("_fidelity_report"), F.col("doc_id").cast("string"))
    return read(spark, sf_dir, "documents").select("doc_id", more.memory_key(F.col("text"), F.col("lang"), F.lit(None).cast("string"), given, F.lit("en"), F.col("source")).alias("key"))


@query(f"SELECT doc_id, {KEY} AS key FROM documents")
def x34_memory_key(spark, sf_dir):
    return _keyed(spark, sf_dir)


@query(f"WITH k AS (SELECT doc_id, {KEY} AS key FROM documents), m AS (SELECT key, min(doc_id) AS first FROM k WHERE doc_id % 2 = 0 GROUP BY 1) SELECT doc_id, first IS NOT NULL AS hit, CASE WHEN first IS NOT NULL THEN 'out ' || first END AS translated FROM k LEFT JOIN m USING (key)")
def j08_remembered(spark, sf_dir):
    keyed = _keyed(spark, sf_dir)
    memory = keyed.where("doc_id % 2 = 0").groupBy("key").agg(F.concat(F.lit("out "), F.min("doc_id")).alias("translated"))
    return more.remembered(keyed, memory).select("doc_id", "hit", "translated")


@query("SELECT p_partkey, p_type AS source, p_name AS target, p_brand AS policy, origin FROM (SELECT *, p_size % 2 AS origin FROM part) QUALIFY row_number() OVER (PARTITION BY lower(p_type), lower(p_name), lower(p_brand), origin ORDER BY p_partkey) = 1")
def u07_folded_terms(spark, sf_dir):
    terms = read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("source"), F.col("p_name").alias("target"), F.col("p_brand").alias("policy"), (F.col("p_size") % 2).alias("origin"))
    return more.fold_terms(terms, "p_partkey")


@query("WITH p AS (SELECT p_partkey, p_type AS source, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END AS target, p_partkey % 9 AS n FROM part) SELECT min_by(source, p_partkey) AS source, coalesce(min_by(target, p_partkey) FILTER (target <> ''), '') AS target, CAST(sum(n) AS BIGINT) AS occurrences FROM p GROUP BY lower(source)")
def u08_richest_entries(spark, sf_dir):
    entries = read(spark, sf_dir, "part").selectExpr("p_partkey", "p_type AS source", "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END AS target", "'' AS category", "p_partkey % 9 AS occurrences", "array(p_brand) AS contexts")
    return more.richest_entries(entries, "p_partkey").select("source", "target", "occurrences")


@query()
def g28_weighted_names(spark, sf_dir):
    return more.weighted_names(read(spark, sf_dir, "documents"), "doc_id", "text")


QUOTES = "concat('He said \"the same phrase\" and «the same  phrase», ', '\"short\" \"other phrase ', doc_id, '\"')"


@query("SELECT doc_id, 'the same phrase' AS phrase, 2 AS occurrences FROM documents")
def y30_quoted_phrases(spark, sf_dir):
    return more.quoted_phrases(read(spark, sf_dir, "documents").selectExpr("doc_id", f"{QUOTES} AS t"), "doc_id", "t").select("doc_id", "phrase", F.col("occurrences").cast("int").alias("occurrences"))


@query("WITH m AS (SELECT DISTINCT l_orderkey AS document, l_linenumber % 2 AS chunk, 'e' || l_suppkey % 7 AS entity FROM lineitem) SELECT a.document, a.entity AS a, b.entity AS b, count(*) AS n FROM m a JOIN m b ON a.document = b.document AND a.chunk = b.chunk AND a.entity < b.entity GROUP BY 1, 2, 3")
def y31_co_mentions(spark, sf_dir):
    mentions = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS document", "l_linenumber % 2 AS chunk", "concat('e', l_suppkey % 7) AS entity")
    return more.co_mentions(mentions)


RULES = [("echo", "high", "panthera +leo", "both"), ("euro", "low", "[0-9]+ eur", "candidate"), ("link", "low", "https://ex", "source"), ("broken", "high", "([", "both")]


@query(PAIR + "SELECT conv_id, turn, 'echo' AS code, 'high' AS severity FROM p UNION ALL SELECT conv_id, turn, 'euro', 'low' FROM p WHERE regexp_matches(t, '(?i)[0-9]+ eur') UNION ALL SELECT conv_id, turn, 'link', 'low' FROM p WHERE regexp_matches(s, '(?i)https://ex')")
def x48_detector_hits(spark, sf_dir):
    return more.detector_hits(pair_rows(spark, sf_dir), RULES, ["conv_id", "turn"]).select("conv_id", "turn", "code", "severity")


ENTRIES = [("Panthera leo", "león", "the", True), ("kg", "kg", "", True), ("EUR", "euro", "", True), ("items", "cosas", "zebra", False), ("doi", "id", "panthera", True)]


@query(PAIR + ", w AS (SELECT conv_id, turn, ' ' || array_to_string(regexp_extract_all(lower(s), '[\\p{L}\\p{N}_]+'), '  ') || ' ' AS s, ' ' || array_to_string(regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+'), '  ') || ' ' AS t FROM p), e(source_term, a, f) AS (VALUES ('Panthera leo', 'panthera  leo', 'the'), ('EUR', 'eur', NULL), ('doi', 'doi', 'panthera')) SELECT conv_id, turn, source_term, CASE WHEN f IS NOT NULL AND contains(t, ' ' || f || ' ') THEN 'forbidden_default' ELSE 'glossary_residual' END AS code FROM w, e WHERE (f IS NOT NULL AND contains(t, ' ' || f || ' ')) OR (contains(s, ' ' || a || ' ') AND contains(t, ' ' || a || ' '))")
def x49_residual_terms(spark, sf_dir):
    entries = spark.createDataFrame(ENTRIES, "source_term string, target_term string, forbidden string, approved boolean")
    return more.residual_terms(pair_rows(spark, sf_dir), entries, ["conv_id", "turn"])


@query("WITH p AS (SELECT event_id, event_id % 3 AS a, event_id % 4 AS b FROM events) SELECT event_id, CASE WHEN a = 0 THEN '' WHEN b = 0 THEN '12,12,7' WHEN b = 1 THEN '12' ELSE '' END AS missing FROM p WHERE b < 2 OR a = 0")
def x40_missing_numbers(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("event_id % 4 < 2 OR event_id % 3 = 0")
    source = F.when(F.col("event_id") % 3 == 0, "only 12 here").otherwise("12 and 12 with 7")
    output = F.when(F.col("event_id") % 4 == 0, "none").when(F.col("event_id") % 4 == 1, "12 with 7").otherwise("12 12 7")
    return e.select("event_id", F.array_join(more.missing_numbers(source, output), ",").alias("missing"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'Holmes' END AS absent FROM events")
def x41_absent_names(spark, sf_dir):
    whole = F.when(F.col("event_id") % 3 == 0, "the HOLMES case").otherwise("the case")
    return read(spark, sf_dir, "events").select("event_id", F.array_join(more.absent_repeated_names(F.lit("Holmes met Watson and Holmes left"), whole), ",").alias("absent"))


@query("SELECT doc_id, '[id900000]' || chr(10) || 'one ' || doc_id || chr(10) || chr(10) || '[id900001]' || chr(10) || 'two' AS marked, CASE WHEN doc_id % 2 = 0 THEN 'one ' || doc_id || chr(10) || chr(10) || 'two' END AS restored FROM documents")
def c32_protected_blocks(spark, sf_dir):
    marked = more.protected_blocks(F.concat(F.lit("one "), "doc_id", F.lit("\n \n\ntwo ")))
    docs = read(spark, sf_dir, "documents").select("doc_id", marked.alias("marked"))
    answer = F.when(F.col("doc_id") % 2 == 0, F.col("marked")).otherwise(F.replace("marked", F.lit("[id900001]"), F.lit("[id900002]")))
    return docs.select("doc_id", "marked", more.restored_blocks(answer, F.lit(2)).alias("restored"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'one ' || doc_id || chr(10) || chr(10) || 'two' END AS restored FROM documents")
def c33_restored_blocks(spark, sf_dir):
    answer = F.expr("CASE WHEN doc_id % 2 = 0 THEN concat('[id900000]', chr(10), 'one ', doc_id, ' [id900001] two') ELSE '[id900000] one [id900001] ' END")
    return read(spark, sf_dir, "documents").select("doc_id", more.restored_blocks(answer, F.lit(2)).alias("restored"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'wrapper_tag' WHEN 1 THEN 'input_marker' WHEN 2 THEN 'prompt_heading' ELSE '' END AS hits FROM documents")
def f24_residual_protocol(spark, sf_dir):
    text = F.expr("CASE doc_id % 4 WHEN 0 THEN 'a </translation> b' WHEN 1 THEN 'so END_INPUT.' WHEN 2 THEN '## Instructions: none' ELSE 'plain text' END")
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(more.residual_protocol(text), ",").alias("hits"))


@query("SELECT doc_id, doc_id % 3 AS n FROM documents")
def f25_outside_literals(spark, sf_dir):
    text = F.expr("concat('see https://a.b/x.Y and c.D@e.org ', repeat('end.Next ', CAST(doc_id % 3 AS INT)))")
    return read(spark, sf_dir, "documents").select("doc_id", P.spacing_counts(text)["period_join"].alias("n"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'es' WHEN 1 THEN 'en' WHEN 2 THEN 'de' WHEN 3 THEN '' ELSE 'klingon' END AS code FROM documents")
def x16_language_key(spark, sf_dir):
    name = F.expr("CASE doc_id % 5 WHEN 0 THEN ' Español' WHEN 1 THEN 'en_US' WHEN 2 THEN 'Deutsch' WHEN 3 THEN NULL ELSE 'Klingon' END")
    return read(spark, sf_dir, "documents").select("doc_id", more.language_key(name).alias("code"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN greatest(event_id % 5, 1) WHEN event_id % 3 = 1 THEN greatest(least(CAST(floor((event_id % 100 * 1000 - 5000) / 1000.0) AS BIGINT) + 1, 65), 1) ELSE CAST(least(pow(2.0, event_id % 7 + 2), 60.0) AS BIGINT) END AS seconds FROM events")
def r06_wait_seconds(spark, sf_dir):
    e = F.col("event_id")
    found = more.wait_seconds(F.when(e % 3 == 0, e % 5), F.when(e % 3 == 1, e % 100 * 1000), F.lit(5000), e % 7)
    return read(spark, sf_dir, "events").select("event_id", found.alias("seconds"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 1.1::DOUBLE WHEN n_nationkey % 3 = 1 THEN 0.8 ELSE 0.95 END AS least, CASE WHEN n_nationkey % 3 = 0 THEN 1.25::DOUBLE WHEN n_nationkey % 3 = 1 THEN 0.95 ELSE 1.3 END AS most FROM nation")
def x28_output_ratio(spark, sf_dir):
    ratios = spark.createDataFrame([("english", "spanish", 1.1, 1.25), ("spanish", "english", 0.8, 0.95)], "source string, target string, least double, most double")
    pairs = read(spark, sf_dir, "nation").selectExpr("n_nationkey", "CASE n_nationkey % 3 WHEN 0 THEN 'English ' WHEN 1 THEN 'SPANISH' ELSE 'x' END AS source", "CASE n_nationkey % 3 WHEN 0 THEN 'spanish' WHEN 1 THEN 'english' ELSE 'y' END AS target")
    return more.output_ratio(pairs, ratios).select("n_nationkey", "least", "most")


@query("SELECT * FROM (VALUES ('Alpha', 'mini', 1.0::DOUBLE), ('alpha', 'MINI', 1.0), ('alpha', 'mini-2025', 1.0), ('beta', 'mini', 9.0), ('gamma', 'x', NULL), ('alpha', 'zz', NULL)) v(provider, model, price)")
def x29_default_price(spark, sf_dir):
    models = spark.createDataFrame([("Alpha", "mini"), ("alpha", "MINI"), ("alpha", "mini-2025"), ("beta", "mini"), ("gamma", "x"), ("alpha", "zz")], "provider string, model string")
    prices = spark.createDataFrame([("alpha", "mini", 1.0), ("alpha", "max", 5.0), ("beta", "mini", 9.0)], "_provider string, known string, price double")
    return more.default_price(models, prices)


@query("SELECT doc, count(*) AS chunks, CAST(sum(n + 500) * 2 AS BIGINT) AS input_tokens, CAST(ceil(round(sum(n * 1.25::DOUBLE) * 2, 6)) AS BIGINT) AS output_tokens, round((sum(n + 500) * 2 * 0.5::DOUBLE + sum(n * 1.25::DOUBLE) * 2 * 1.5::DOUBLE) / 1e6, 4) AS cost_usd FROM (SELECT l_orderkey AS doc, CAST(l_quantity AS BIGINT) * 7 AS n FROM lineitem) GROUP BY 1")
def x27_estimate(spark, sf_dir):
    chunks = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc", "CAST(l_quantity AS BIGINT) * 7 AS n_tokens")
    return ledger.estimate(chunks, F.lit(1.25), 2, 0.5, 1.5, overhead=500)


@query("WITH e AS (SELECT user_id % 9 AS document, event_type, event_id, value FROM events) SELECT document, 'decision' AS kind, CASE WHEN event_type = 'error' THEN 'unknown' ELSE event_type END AS name, count(*)::DOUBLE AS value FROM e GROUP BY 1, 3 UNION ALL SELECT document, 'score', 'style', round(avg(CAST(event_id % 10 AS DOUBLE)), 6) FROM e GROUP BY 1 UNION ALL SELECT document, 'issue', 'i' || event_id % 3, count(*) FROM e WHERE event_id % 2 = 0 GROUP BY 1, 3")
def g34_audit_summary(spark, sf_dir):
    records = read(spark, sf_dir, "events").selectExpr("user_id % 9 AS document", "CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS decision", "map('style', CAST(event_id % 10 AS DOUBLE)) AS scores", "CASE WHEN event_id % 2 = 0 THEN array(concat('i', event_id % 3)) ELSE cast(array() AS array<string>) END AS issues")
    return more.audit_summary(records)


@query("SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' OR regexp_matches(text, 'Ã.|Â|â[\\x{0080}-\\x{00FF}\\x{20AC}\\x{2122}]|ï¿½|\\x{FFFD}|ðŸ|[\\x{0080}-\\x{009F}]') THEN 'fail' WHEN doc_id % 4 = 0 THEN 'warn' ELSE 'pass' END AS status FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '(?m)^\\s*[0-9]{1,5}[.]?\\s*$') AND NOT contains(coalesce(text, ''), chr(10) || chr(10))")
def p03_output_report(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("NOT coalesce(text, '') RLIKE '(?m)^\\\\s*[0-9]{1,5}[.]?\\\\s*$' AND NOT contains(coalesce(text, ''), chr(10) || chr(10))")
    shown = docs.select("doc_id", F.expr("CASE WHEN doc_id % 4 = 0 AND trim(text) <> '' THEN concat(text, ' oceanofpdf.com') ELSE text END").alias("text"))
    return more.output_report(shown, "doc_id", "text", F.lit(0)).select("doc_id", "status")


@query("SELECT CASE WHEN a IS NULL THEN 'new' WHEN b IS NULL THEN 'fixed' ELSE 'kept' END AS state, count(*) AS n FROM (SELECT event_id AS a FROM events WHERE event_id % 3 <> 0) x FULL JOIN (SELECT event_id AS b FROM events WHERE event_id % 4 <> 0) y ON a = b GROUP BY 1")
def x56_finding_changes(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return more.finding_changes(e.where("event_id % 3 <> 0"), e.where("event_id % 4 <> 0"), ["event_id"])


@query("SELECT p_partkey, replace(upper(p_name), ' ', '_') AS name FROM part")
def e01_registered_rules(spark, sf_dir):
    more.register_rule("loud", F.upper)
    more.register_rule("joined", lambda t: F.replace(t, F.lit(" "), F.lit("_")))
    return read(spark, sf_dir, "part").select("p_partkey", more.apply_rules(F.col("p_name"), ["loud", "joined"]).alias("name"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || ' ' || 'next' WHEN o_orderkey % 3 = 1 THEN o_orderpriority || 'next' ELSE o_orderpriority || 'next' END AS text FROM orders")
def y02_joined_paragraphs(spark, sf_dir):
    before = F.when(F.col("o_orderkey") % 3 == 1, F.concat("o_orderpriority", F.lit("- "))).otherwise(F.col("o_orderpriority"))
    proven = F.col("o_orderkey") % 3 == 2
    a = F.regexp_replace(before, r"[\s\x{00A0}]+$", "")
    joined = F.when(a.rlike(r"[-\x{00AD}]$"), F.concat(F.substr(a, F.lit(1), F.length(a) - 1), F.lit("next"))).when(proven, F.concat(a, F.lit("next"))).otherwise(F.concat(a, F.lit(" next")))
    return read(spark, sf_dir, "orders").select("o_orderkey", joined.alias("text"))


@query("SELECT conv_id, turn, ntile(2) OVER (PARTITION BY conv_id ORDER BY turn)::INT AS half FROM conversations")
def k22_bisected(spark, sf_dir):
    from pyspark.sql.window import Window as W

    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.ntile(2).over(W.partitionBy("conv_id").orderBy("turn")).alias("half"))


@query(r"SELECT l_orderkey AS file, count(*) <> count(*) FILTER (l_linenumber % 5 <> 0) AS mismatch FROM lineitem WHERE l_orderkey % 20 = 0 GROUP BY 1")
def x68_subtitle_counts(spark, sf_dir):
    from docmill.plans.text_plans import files

    times = lambda t: F.regexp_count(t, F.lit(r"(?m)^\s*[0-9]{2}:[0-9]{2}:[0-9]{2}[,.][0-9]{3}\s+-->\s+.+$"))
    output = F.regexp_replace("content", r"(?m)^00:05:00,000 --> .*$", "lost")
    return files(spark, sf_dir).select("file", (times(F.col("content")) != times(output)).alias("mismatch"))


# Files --------------------------------------------------------------------------------------------------------------------


def _files(spark, sf_dir):
    """Documents as files of several encodings and types."""
    docs = read(spark, sf_dir, "documents").where("text is not null")
    body = F.expr("CASE doc_id % 4 WHEN 0 THEN encode(text, 'UTF-8') WHEN 1 THEN encode(text, 'UTF-16') WHEN 2 THEN concat(unhex('EFBBBF'), encode(text, 'UTF-8')) ELSE encode(regexp_replace(text, '[^\\\\x00-\\\\xFF]', '?'), 'ISO-8859-1') END")
    return docs.select("doc_id", F.concat(F.lit("/in/"), "doc_id", F.lit(".txt")).alias("path"), body.alias("content"))


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id % 4 < 3 AND text IS NOT NULL AND text <> '' AND NOT regexp_matches(text, '[ÃÂâïð\\x{0080}-\\x{009F}]')")
def s01_decoded_files(spark, sf_dir):
    found = _files(spark, sf_dir).where("doc_id % 4 < 3")
    clean = read(spark, sf_dir, "documents").where("text <> '' AND NOT text RLIKE '[ÃÂâïð\\\\x{0080}-\\\\x{009F}]'").select("doc_id")
    told = readers.texts(found).select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("doc_id"), F.md5("text").alias("digest"))
    return told.join(clean, "doc_id", "left_semi")


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'epub' WHEN 1 THEN 'txt' WHEN 2 THEN 'pdf' WHEN 3 THEN 'zip' ELSE 'txt' END AS type FROM documents")
def s02_file_type(spark, sf_dir):
    path = F.expr("CASE doc_id % 5 WHEN 0 THEN 'a/b.EPUB' WHEN 1 THEN 'c.md' WHEN 4 THEN 'd.odd' ELSE 'noext' END")
    content = F.expr("CASE doc_id % 5 WHEN 2 THEN unhex('255044462D31') WHEN 3 THEN unhex('504B0304AA') ELSE encode('plain', 'UTF-8') END")
    return read(spark, sf_dir, "documents").select("doc_id", readers.file_type(path, content).alias("type"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' END AS type FROM documents")
def s03_binary_type(spark, sf_dir):
    content = F.expr("CASE doc_id % 3 WHEN 0 THEN unhex('255044462D31') WHEN 1 THEN unhex('504B0304') ELSE unhex('504B') END")
    return read(spark, sf_dir, "documents").select("doc_id", readers.binary_type(content).alias("type"))


@query("SELECT l_orderkey AS file, count(*) FILTER (l_linenumber % 5 <> 0) AS blocks FROM lineitem WHERE l_orderkey % 20 = 0 GROUP BY 1 HAVING blocks > 0")
def s07_subtitle_blocks(spark, sf_dir):
    from docmill.plans.text_plans import files

    found = files(spark, sf_dir).select(F.col("file").cast("string").alias("path"), F.encode("content", "UTF-8").alias("content"))
    return readers.blocks(found, "srt").groupBy(F.col("path").cast("long").alias("file")).agg(F.count("*").alias("blocks"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{\"a\": [1, \"}\"]}' WHEN 1 THEN '[1, 2]' END AS json FROM documents")
def s24_first_json(spark, sf_dir):
    text = F.expr("CASE doc_id % 3 WHEN 0 THEN 'so: {\"a\": [1, \"}\"]} and {' WHEN 1 THEN 'x [1, 2] y' ELSE 'open { [ }' END")
    return read(spark, sf_dir, "documents").select("doc_id", C._mapped(readers.first_json, "string")(text).alias("json"))


@query(r"SELECT page_id, len(string_split(regexp_replace(html, '\n$', ''), chr(10)))::INT AS lines FROM pages")
def g43_line_counts(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("text"))
    return more.line_counts(pages).select(F.col("path").alias("page_id"), "lines")


@query()
def k04_packed_units(spark, sf_dir):
    """Chunks of paragraphs, as many as they are, with their tokens (no word is lost)."""
    return chunking.chunked(read(spark, sf_dir, "documents"), "doc_id", "text", 120, "\n").groupBy("doc").agg(F.count("*").alias("chunks"), F.max("n_tokens").alias("most"))
