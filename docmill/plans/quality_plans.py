"""Queries of entities, pairs, gates and the quality run, with the SQL that checks them.

A user's turn and the assistant's next stand for a source and its candidate; both get a tail of numbers, dates, amounts,
measurements, links and names that differs where the conversation's number says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import entities as E
from docmill.functions import pairs as P
from docmill.functions import text as T
from docmill.operators import gates
from docmill.plans.base import query, read

#: The tail, in words that both engines read; {} is what differs.
TAIL = "concat(' On 20', 10 + conv_id % 15, '-0', 1 + turn % 9, '-1', (conv_id % 10 + {0}) % 10, ' it cost $', conv_id % 900, '.50 or ', turn + 3 + {0}, ' EUR, ', conv_id % 97, ' % of 12 ', 100 + conv_id % 800, ' items, ', turn % 40 + {1}, ' kg and ', conv_id % 30, ' V; see https://ex.org/p', conv_id + {1}, '. ISBN 978-3-16-14841', conv_id % 10, '-', {1}, ' (doi: 10.1000/ab.', turn, ') species Panthera leo', CASE WHEN conv_id % 4 = 0 THEN ' [id3] [id7]' ELSE '' END)"
SOURCE_TAIL = TAIL.format("0", "0")
TARGET_TAIL = TAIL.format("CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END", "CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END")
#: Every seventh candidate is its source, every eleventh is empty.
TARGET = f"CASE WHEN conv_id % 7 = 0 THEN s WHEN conv_id % 11 = 0 THEN ' ' ELSE concat(t, {TARGET_TAIL}) END"
PAIR = "WITH p0 AS (SELECT a.conv_id, a.turn, a.text AS s, b.text AS t FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'), p1 AS (SELECT conv_id, turn, concat(s, " + SOURCE_TAIL + ") AS s, t FROM p0), p AS (SELECT conv_id, turn, s, " + TARGET + " AS t FROM p1) "


def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    a = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("s"))
    b = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("t"))
    rows = a.join(b, ["conv_id", "turn"]).selectExpr("conv_id", "turn", f"concat(s, {SOURCE_TAIL}) AS s", "t")
    return rows.selectExpr("conv_id", "turn", "s", f"{TARGET} AS t")


# RE2 has no look-around: what stands between words is doubled, so that each match can take its own. {} is the text.
LEFT, RIGHT = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
DOUBLED = r"regexp_replace({}, '([^\p{L}\p{N}_])', '\1\1', 'g')"
KINDS = {
    "number": f"list_transform(regexp_extract_all({DOUBLED}, '{LEFT}([0-9]" + "{1,3}(?:  [0-9]{3})+|[0-9]+)" + f"{RIGHT}', 1), lambda v: replace(v, ' ', ''))",
    "date": "regexp_extract_all({}, '20[0-9]{2}-0[0-9]-[0-9]{2}')",
    "percentage": "list_transform(regexp_extract_all({}, '[0-9]+ %'), lambda v: replace(v, ' ', ''))",
    "currency": r"list_concat(regexp_extract_all({}, '\$[0-9]+[.]50'), list_transform(regexp_extract_all({}, '[0-9]+ EUR'), lambda v: replace(v, ' ', '')))",
    "measurement": f"list_transform(regexp_extract_all({DOUBLED}, '{LEFT}([0-9]+  (?:kg|V)){RIGHT}', 1), lambda v: upper(replace(v, ' ', '')))",
    "identifier": "list_transform(regexp_extract_all({}, 'doi: 10[.]1000/ab[.][0-9]+'), lambda v: upper(replace(v, ' ', '')))",
    "url": "regexp_extract_all({}, 'https://ex[.]org/p[0-9]+')",
    "isbn": "list_transform(regexp_extract_all({}, 'ISBN ([0-9X-]+)', 1), lambda v: replace(v, '-', ''))",
    "scientific_name": "regexp_extract_all({}, 'species (Panthera leo)', 1)",
}


def _in(kind: str, column: str) -> str:
    return KINDS[kind].replace("{}", column)


def _kind(kind: str):
    sql = PAIR + f"SELECT conv_id, turn, array_to_string({_in(kind, 's')}, '|') AS in_source, array_to_string({_in(kind, 't')}, '|') AS in_target FROM p"

    def run(spark, sf_dir):
        f = E.KINDS[kind]
        return pair_rows(spark, sf_dir).select("conv_id", "turn", F.array_join(f(F.col("s")), "|").alias("in_source"), F.array_join(f(F.col("t")), "|").alias("in_target"))

    return sql, run


for _n, _k in enumerate(E.KINDS, 1):
    _sql, _run = _kind(_k)
    _run.__name__ = f"x0{_n}_{_k}s"
    query(_sql)(_run)


DIFFERENCES = PAIR + ", v AS (" + " UNION ALL ".join(f"SELECT conv_id, turn, '{k}' AS kind, unnest({_in(k, c)}) AS v, {n} AS n FROM p" for k in KINDS for c, n in (("s", 1), ("t", -1))) + "), g AS (SELECT conv_id, turn, kind, v, sum(n) AS n FROM v GROUP BY ALL), d AS (SELECT conv_id, turn, kind, CAST(sum(greatest(0, n)) AS BIGINT) AS missing, CAST(sum(greatest(0, -n)) AS BIGINT) AS added FROM g GROUP BY ALL) "


@query(DIFFERENCES + "SELECT * FROM d WHERE missing > 0 OR added > 0")
def j10_entity_differences(spark, sf_dir):
    return E.entity_differences(pair_rows(spark, sf_dir), ["conv_id", "turn"], "s", "t")


@query(DIFFERENCES + "SELECT conv_id, turn, kind, CASE WHEN conv_id % 2 = 1 THEN 'critical' WHEN turn % 4 = 0 AND kind IN ('number', 'date', 'percentage', 'currency', 'measurement', 'url') THEN 'medium' WHEN length(s) >= 4000 AND kind IN ('number', 'date', 'percentage', 'currency', 'measurement') THEN 'medium' ELSE 'critical' END AS severity FROM d JOIN p USING (conv_id, turn) WHERE missing > 0 OR added > 0")
def x67_mismatch_severity(spark, sf_dir):
    rows = pair_rows(spark, sf_dir)
    found = E.entity_differences(rows, ["conv_id", "turn"], "s", "t").join(rows.select("conv_id", "turn", F.length("s").alias("n")), ["conv_id", "turn"])
    return found.select("conv_id", "turn", "kind", E.mismatch_severity(F.col("kind"), F.col("conv_id") % 2 == 0, F.col("turn") % 4 == 0, F.col("n")).alias("severity"))


STRIP, FOLD = r"regexp_replace({}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')", r"lower(trim(regexp_replace({}, '[\s\x{{00A0}}]+', ' ', 'g')))"
CODES = "array_to_string({}, ',')"


def _codes(found):
    return F.array_join(F.transform(found, lambda i: i["code"]), ",")


@query(PAIR + f"SELECT conv_id, turn, concat_ws(',', CASE WHEN {STRIP.format('s')} = '' THEN 'missing_source_unit' END, CASE WHEN {STRIP.format('t')} = '' THEN 'empty_translation' END, CASE WHEN {STRIP.format('t')} <> '' AND {FOLD.format('s')} = {FOLD.format('t')} AND length({STRIP.format('s')}) >= 40 THEN 'untranslated_source' END) AS codes FROM p")
def x61_coverage_issues(spark, sf_dir):
    return pair_rows(spark, sf_dir).select("conv_id", "turn", _codes(P.coverage_issues(F.col("s"), F.col("t"), F.lit(False))).alias("codes"))


# Each place of a text on its own, as what stands beside a lost space may stand beside the next.
JOINS = {c: f"len(list_filter(range(1, length(q) + 1), lambda i: regexp_matches(q[i:i + {n}], '^{p}')))" for c, n, p in (("period_join", 2, "[a-zÀ-ɏ0-9][.][A-ZÀ-ɏ]"), ("comma_join", 2, "[a-zÀ-ɏ],[A-ZÀ-ɏ]"), ("semicolon_join", 2, "[a-zÀ-ɏ];[A-ZÀ-ɏ]"), ("colon_join", 2, "[a-zÀ-ɏ]:[A-ZÀ-ɏ]"), ("word_join", 3, "[a-zß-ɏ][A-ZÀ-Þ][a-zß-ɏ]{2}"))}
JOINED = "concat(replace(t, '. ', CASE WHEN conv_id % 2 = 0 THEN '.' ELSE '. ' END), ' mail a.B@ex.org, www.Ab.cd/E.F')"


@query(
    PAIR
    + f", q AS (SELECT conv_id, turn, regexp_replace(replace(replace({JOINED}, 'a.B@ex.org', '*'), 'www.Ab.cd/E.F', '*'), 'https://ex[.]org/[^\\s]+', '*', 'g') AS q FROM p) SELECT conv_id, turn, "
    + ", ".join(f"{p} AS {c}" for c, p in JOINS.items())
    + " FROM q"
)
def x12_lost_spaces(spark, sf_dir):
    rows = pair_rows(spark, sf_dir).selectExpr("conv_id", "turn", f"{JOINED} AS t")
    return rows.select("conv_id", "turn", *[c.alias(k) for k, c in P.spacing_counts(F.col("t")).items()])


@query(PAIR + ", n AS (SELECT *, length(s) AS a, length(t) AS b, length(t) / greatest(1, length(s))::DOUBLE AS r FROM p) SELECT conv_id, turn, CASE WHEN a < 80 OR b <= 0 THEN 'none' WHEN (a >= 120 AND r < 0.35) OR (a >= 300 AND r < 0.45) THEN 'severe_length_drop' WHEN r < 0.58 THEN 'length_drop' WHEN r > 2.2 THEN 'length_expansion' ELSE 'none' END AS code FROM n")
def x42_length_issue(spark, sf_dir):
    found = P.length_ratio_issue(F.length("s"), F.length("t"))
    return pair_rows(spark, sf_dir).select("conv_id", "turn", F.coalesce(found["code"], F.lit("none")).alias("code"))


@query(PAIR + ", n AS (SELECT *, length(s) AS a, length(t) AS b, length(t) / greatest(1, length(s))::DOUBLE AS r FROM p) SELECT conv_id, turn, CASE WHEN a < 120 OR b = 0 THEN 'none' WHEN a >= 500 AND (r < 0.7 OR r > 1.6) THEN 'reject' WHEN r < 0.55 OR r > 2.0 THEN 'warning' ELSE 'none' END AS plain, CASE WHEN a < 120 OR b = 0 THEN 'none' WHEN a >= 500 AND (r < 0.45 OR r > 2.2) THEN 'reject' WHEN r < 0.6 OR r > 1.9 THEN 'warning' ELSE 'none' END AS modern FROM n")
def x64_refined_length(spark, sf_dir):
    said = lambda modern: F.coalesce(P.refined_length_issue(F.length("s"), F.length("t"), modern)["severity"], F.lit("none"))
    return pair_rows(spark, sf_dir).select("conv_id", "turn", said(False).alias("plain"), said(True).alias("modern"))


PARTS = r"len(list_filter(string_split_regex(replace({}, '. ', chr(10) || chr(10)), '\n\s*\n+'), lambda x: trim(x) <> ''))"


@query(PAIR + f", n AS (SELECT conv_id, turn, {PARTS.format('s')} AS a, {PARTS.format('t')} AS b FROM p) SELECT conv_id, turn, CASE WHEN a >= 3 AND b <= 1 THEN 'paragraph_collapse' ELSE 'none' END AS pair, CASE WHEN a >= 3 AND b <= 1 THEN 'reject' WHEN a >= 5 AND b < greatest(2, floor(a * 0.5)) THEN 'warning' ELSE 'none' END AS refined FROM n")
def x65_paragraph_issues(spark, sf_dir):
    count = lambda c: P.paragraph_count(F.replace(F.col(c), F.lit(". "), F.lit("\n\n")))
    rows = pair_rows(spark, sf_dir).select("conv_id", "turn", count("s").alias("a"), count("t").alias("b"))
    none = F.lit("none")
    return rows.select("conv_id", "turn", F.coalesce(P.collapse_issue(F.col("a"), F.col("b"))["code"], none).alias("pair"), F.coalesce(P.refined_paragraph_issue(F.col("a"), F.col("b"))["severity"], none).alias("refined"))


@query(PAIR + r", n AS (SELECT conv_id, turn, list_sort(regexp_extract_all(s, '(?i)\[id[0-9]+\]')) AS a, list_sort(regexp_extract_all(replace(t, '[id7]', CASE WHEN turn % 4 = 0 THEN '[id3]' ELSE '[id7]' END), '(?i)\[id[0-9]+\]')) AS b FROM p) SELECT conv_id, turn, CASE WHEN len(a) > 0 AND a <> b THEN 'reject' ELSE 'none' END AS severity FROM n")
def x62_placeholders(spark, sf_dir):
    t = F.expr("replace(t, '[id7]', CASE WHEN turn % 4 = 0 THEN '[id3]' ELSE '[id7]' END)")
    return pair_rows(spark, sf_dir).withColumn("t", t).select("conv_id", "turn", F.coalesce(P.placeholder_issue(F.col("s"), F.col("t"))["severity"], F.lit("none")).alias("severity"))


TERMS = "['of the', 'Is', 'kg', 'panthera leo', 'EUR', 'no such', '']"


@query(PAIR + f"SELECT conv_id, turn, array_to_string(list_filter({TERMS}, lambda x: x <> '' AND contains(lower(s), lower(x)) AND NOT contains(lower(replace(t, 'kg', 'lb')), lower(x))), ',') AS lost FROM p")
def x66_lost_terms(spark, sf_dir):
    terms = F.array(*map(F.lit, ["of the", "Is", "kg", "panthera leo", "EUR", "no such", ""]))
    return pair_rows(spark, sf_dir).select("conv_id", "turn", F.array_join(P.lost_terms(F.col("s"), F.replace("t", F.lit("kg"), F.lit("lb")), terms), ",").alias("lost"))


TOTALS = PAIR + f", v AS (SELECT conv_id, turn, unnest({_in('number', 's')}) AS v, 1 AS n FROM p UNION ALL SELECT conv_id, turn, unnest({_in('number', 't')}), -1 FROM p), g AS (SELECT conv_id, turn, v, sum(n) AS n, count_if(n = 1) AS a FROM v GROUP BY ALL), m AS (SELECT conv_id, turn, sum(a) AS total, sum(greatest(0, n)) AS missing FROM g GROUP BY ALL) "


@query(TOTALS + "SELECT conv_id, turn, CAST(total AS BIGINT) AS total, CAST(missing AS BIGINT) AS missing, CASE WHEN total < 1 OR missing <= 0 THEN 'none' WHEN missing / greatest(1, total)::DOUBLE <= 0.35 THEN 'warning' ELSE 'reject' END AS severity FROM m")
def x43_missing_numbers(spark, sf_dir):
    rows = pair_rows(spark, sf_dir)
    values = lambda c: rows.select("conv_id", "turn", F.explode(E.digit_groups(F.col(c))).alias("v")).groupBy("conv_id", "turn", "v")
    a, b = values("s").agg(F.count("*").alias("a")), values("t").agg(F.count("*").alias("b"))
    both = a.join(b, ["conv_id", "turn", "v"], "full_outer").groupBy("conv_id", "turn").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("total"), F.sum(F.greatest(F.lit(0), F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0)))).alias("missing"))
    found = P.missing_tokens_issue(F.col("total"), F.col("missing"), "numbers_missing", 0.35)
    return both.select("conv_id", "turn", "total", "missing", F.coalesce(found["severity"], F.lit("none")).alias("severity"))


def _marks(k: str) -> str:
    return "len(list_filter(regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+'), lambda w: list_contains(string_split('" + P.MARKERS[k] + "', ' '), w)))"


@query(PAIR + f", m AS (SELECT conv_id, turn, {FOLD.format('s')} = {FOLD.format('t')} AND len(list_filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '\\p{{L}}'))) >= 3 AS echo, {_marks('English')} AS en, {_marks('Spanish')} AS es, {_marks('French')} AS fr FROM p) SELECT conv_id, turn, echo AND en >= 1 AND es = 0 AS spanish, echo AND es >= 2 AND en = 0 AS english, echo AND en >= 1 AND fr = 0 AS french FROM m")
def x44_latin_echo(spark, sf_dir):
    s, t = F.col("s"), F.col("t")
    return pair_rows(spark, sf_dir).select("conv_id", "turn", *[P.latin_echo(s, t, k).alias(k.lower()) for k in ("Spanish", "English", "French")])


@query("SELECT doc_id, CASE WHEN toxic = 1 OR quality * 10 < 7 THEN 'fail' WHEN doc_id % 10 < 8 OR doc_id % 3 = 0 THEN 'warn' ELSE 'pass' END AS decision FROM labels")
def x50_decision(spark, sf_dir):
    scores = {"critical": F.col("quality") * 10, "style": F.col("doc_id") % 10}
    return read(spark, sf_dir, "labels").select("doc_id", P.decision(scores, F.col("toxic") == 1, F.col("doc_id") % 3 == 0, 8.0, ("critical",)).alias("decision"))


AXES = ("CASE doc_id % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'flag' WHEN 2 THEN 'reject' ELSE NULL END", "CASE doc_id % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'repair_needed' WHEN 2 THEN 'fail' WHEN 3 THEN 'odd' ELSE NULL END", "CASE doc_id % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'warn' ELSE NULL END")


@query("WITH a AS (SELECT doc_id, " + ", ".join(f"{e} AS {c}" for e, c in zip(AXES, "efp", strict=True)) + " FROM documents) SELECT doc_id, ['pass', 'warn', 'fail'][greatest(CASE WHEN e IS NULL OR e = 'accept' THEN 0 WHEN e = 'reject' THEN 2 ELSE 1 END, CASE WHEN f IS NULL OR f = 'pass' THEN 0 WHEN f = 'fail' THEN 2 ELSE 1 END, CASE WHEN p IS NULL OR p = 'pass' THEN 0 WHEN p = 'fail' THEN 2 ELSE 1 END) + 1] AS verdict FROM a")
def x51_worst_axis(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", P.worst(*[F.expr(e) for e in AXES]).alias("verdict"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 7 <> 0 THEN 'accepted' WHEN doc_id % 5 = 0 THEN 'fail' WHEN doc_id % 3 = 0 THEN 'retry' WHEN doc_id % 7 = 0 THEN 'repair' WHEN doc_id % 11 = 0 THEN 'accepted_with_warnings' ELSE 'accepted' END AS decision FROM documents")
def x52_candidate_decision(spark, sf_dir):
    found = P.issues(F.when(F.col("doc_id") % 5 == 0, P.issue("placeholder_mismatch", "warning")), F.when(F.col("doc_id") % 3 == 0, P.issue("untranslated_source", "warning")), F.when(F.col("doc_id") % 7 == 0, P.issue("x", "reject")), F.when(F.col("doc_id") % 11 == 0, P.issue("y", "warning")))
    return read(spark, sf_dir, "documents").select("doc_id", P.candidate_decision(found, F.col("doc_id") % 2 == 0).alias("decision"))


# Documents of units: a conversation is a document, its pairs are units --------------------------------------------------

NEGATED = "len(list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: list_contains(string_split('" + T.NEGATIONS + "', ' '), w)))"
SOLID = r"length(regexp_replace({}, '[\s\x{{00A0}}]+', '', 'g'))"
SEMANTIC = f"""SELECT conv_id, turn, c.code, c.severity, 'semantics' AS gate FROM (SELECT conv_id, turn, unnest([
  CASE WHEN length({STRIP.format('s')}) >= 100 AND {SOLID.format('t')} > 0 AND {SOLID.format('t')} / {SOLID.format('s')}::DOUBLE < 0.55 THEN {{'code': 'probable_semantic_omission', 'severity': 'critical'}} WHEN length({STRIP.format('s')}) >= 100 AND {SOLID.format('t')} / {SOLID.format('s')}::DOUBLE > 2.2 THEN {{'code': 'probable_semantic_addition', 'severity': 'high'}} END,
  CASE WHEN {SOLID.format('s')} > 0 AND {SOLID.format('t')} > 0 AND {NEGATED.format('s')} > 0 AND {NEGATED.format('t')} = 0 THEN {{'code': 'possible_negation_loss', 'severity': 'critical'}} END]) AS c FROM p) WHERE c IS NOT NULL"""
COVERAGE = f"""SELECT conv_id, turn, c.code, 'critical' AS severity, 'translation' AS gate FROM (SELECT conv_id, turn, unnest([CASE WHEN {STRIP.format('t')} = '' THEN {{'code': 'empty_translation'}} END, CASE WHEN {STRIP.format('t')} <> '' AND {FOLD.format('s')} = {FOLD.format('t')} AND length({STRIP.format('s')}) >= 40 THEN {{'code': 'untranslated_source'}} END]) AS c FROM p) WHERE c IS NOT NULL"""
SPACES = "SELECT conv_id, turn, code, CASE WHEN code = 'spacing_word_join' THEN 'medium' ELSE 'critical' END AS severity, 'typography' AS gate FROM (" + " UNION ALL ".join(f"SELECT conv_id, turn, 'spacing_{c}' AS code FROM (SELECT conv_id, turn, regexp_replace(t, 'https://ex[.]org/[^\\s]+', '*', 'g') AS q FROM p) WHERE {p} > 0" for c, p in JOINS.items()) + ")"
ISSUES = DIFFERENCES + f", i AS ({SEMANTIC} UNION ALL {COVERAGE} UNION ALL {SPACES} UNION ALL SELECT conv_id, turn, kind || '_mismatch' AS code, 'critical' AS severity, 'entities' AS gate FROM d WHERE missing > 0 OR added > 0) "


def semantic_issues(s, t):
    both = (P.solid_size(s) > 0) & (P.solid_size(t) > 0)
    ratio = P.solid_size(t) / F.greatest(F.lit(1), P.solid_size(s))
    long = F.length(P.stripped(s)) >= 100
    length = F.when(both & long & (ratio < 0.55), P.issue("probable_semantic_omission", "critical")).when(both & long & (ratio > 2.2), P.issue("probable_semantic_addition", "high"))
    return P.issues(length, F.when(both & (T.negations(s) > 0) & (T.negations(t) == 0), P.issue("possible_negation_loss", "critical")))


def unit_issues(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, code, severity, gate): all that the validators find in units, as one table."""
    s, t = F.col("s"), F.col("t")
    counts = rows.select("*", *[c.alias(k) for k, c in P.spacing_counts(t).items()])
    named = [("semantics", semantic_issues(s, t)), ("translation", P.coverage_issues(s, t, F.lit(False))), ("typography", P.spacing_issues({k: F.col(k) for k in P.SPACING}))]

    def at(gate):
        return lambda i: F.struct(i["code"].alias("code"), i["severity"].alias("severity"), F.lit(gate).alias("gate"))

    every = F.concat(*[F.transform(found, at(gate)) for gate, found in named])
    own = counts.select("conv_id", "turn", F.explode(every).alias("i")).select("conv_id", "turn", "i.*")
    kinds = E.entity_differences(rows, ["conv_id", "turn"], "s", "t").select("conv_id", "turn", F.concat("kind", F.lit("_mismatch")).alias("code"), F.lit("critical").alias("severity"), F.lit("entities").alias("gate"))
    return own.unionByName(kinds)


@query(ISSUES + "SELECT * FROM i")
def x11_unit_issues(spark, sf_dir):
    return unit_issues(pair_rows(spark, sf_dir))


@query(ISSUES + "SELECT code, count(*) AS issues, count(DISTINCT (conv_id, turn)) AS units FROM i GROUP BY 1")
def x70_issue_report(spark, sf_dir):
    return gates.entity_report(unit_issues(pair_rows(spark, sf_dir)).withColumn("unit", F.concat_ws(":", "conv_id", "turn")))


def _manifest(spark, sf_dir):
    """Units with their stages, and their issues."""
    rows = pair_rows(spark, sf_dir)
    found = unit_issues(rows).select(F.col("conv_id").alias("document"), F.concat_ws(":", "conv_id", "turn").alias("unit"), "code", "severity", "gate")
    bad = found.groupBy("unit").agg(F.max(gates.blocking(F.col("severity"))).alias("blocks"), F.max(gates.blocking(F.col("severity")) & (F.col("gate") == "translation")).alias("fails"))
    units = rows.select(F.col("conv_id").alias("document"), F.concat_ws(":", "conv_id", "turn").alias("unit"), F.col("turn").alias("ord"), F.col("t").alias("target"), (F.col("turn") % 9 != 8).alias("translatable"))
    stage = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), "failed").otherwise("passed")
    return units.join(bad, "unit", "left").select("document", "unit", "ord", "target", "translatable", F.lit("passed").alias("extraction"), stage("fails").alias("translation"), stage("blocks").alias("audit"), stage("blocks").alias("approval")), found


BLOCK = "('critical', 'high', 'error', 'reject')"
MANIFEST = ISSUES + f", b AS (SELECT conv_id, turn, bool_or(severity IN {BLOCK}) AS blocks, bool_or(severity IN {BLOCK} AND gate = 'translation') AS fails FROM i GROUP BY ALL), u AS (SELECT p.conv_id AS document, p.turn, t, p.turn % 9 <> 8 AS translatable, coalesce(fails, false) AS fails, coalesce(blocks, false) AS blocks FROM p LEFT JOIN b USING (conv_id, turn)), m AS (SELECT document, count(*) AS extracted, count_if(translatable) AS translatable, count_if(NOT translatable) AS excluded, count_if(translatable) AS sent_to_model, count_if(translatable AND t <> '') AS responded, count(*) AS passed_extraction, count_if(NOT fails) AS passed_translation, count_if(NOT blocks) AS passed_audit, count_if(NOT blocks) AS passed_approval FROM u GROUP BY 1) "


@query(MANIFEST + "SELECT * FROM m")
def g21_manifest_counts(spark, sf_dir):
    return gates.manifest_counts(_manifest(spark, sf_dir)[0])


GATED = MANIFEST + f""", a AS (SELECT conv_id AS document, gate, code, conv_id || ':' || turn AS unit, bool_or(severity IN {BLOCK}) AS blocks FROM i GROUP BY ALL
  UNION ALL SELECT document, 'translation', 'incomplete_translation_coverage', NULL, true FROM m WHERE passed_translation <> translatable UNION ALL SELECT document, 'final', 'unapproved_units', NULL, true FROM m WHERE passed_approval <> translatable),
f AS (SELECT document, gate, count(*) AS issues, count_if(blocks) AS blocking FROM a GROUP BY 1, 2), e AS (SELECT document, unnest(['{"', '".join(gates.GATES)}']) AS gate FROM m),
gs AS (SELECT document, gate, CASE WHEN coalesce(blocking, 0) > 0 THEN 'blocked' WHEN coalesce(issues, 0) > 0 THEN 'passed_with_warnings' ELSE 'passed' END AS status, coalesce(issues, 0) AS issues, coalesce(blocking, 0) AS blocking FROM e LEFT JOIN f USING (document, gate)) """


@query(GATED + "SELECT * FROM gs")
def g24_gate_statuses(spark, sf_dir):
    units, found = _manifest(spark, sf_dir)
    return gates.gate_statuses(gates.manifest_counts(units), found)


@query(GATED + "SELECT document, CASE WHEN bool_or(status = 'blocked') THEN 'blocked' WHEN bool_or(status = 'passed_with_warnings') THEN 'passed_with_warnings' ELSE 'passed' END AS status, count_if(status = 'blocked') AS blocked_gates, CAST(sum(issues) AS BIGINT) AS issues FROM gs GROUP BY 1")
def p01_quality_run(spark, sf_dir):
    units, found = _manifest(spark, sf_dir)
    return gates.final_status(gates.gate_statuses(gates.manifest_counts(units), found))


@query(ISSUES + f", r AS (SELECT conv_id AS document, conv_id || ':' || turn AS unit, turn AS ord, count(DISTINCT code) AS codes, bool_or(contains(code, 'language') OR contains(code, 'untranslated')) AS a, bool_or(contains(code, 'entity') OR contains(code, 'number') OR contains(code, 'isbn')) AS b, bool_or(contains(code, 'spacing')) AS c, bool_or(contains(code, 'semantic') OR contains(code, 'negation')) AS d FROM i WHERE severity IN {BLOCK} GROUP BY 1, 2, 3) SELECT document, unit, ord, codes, CASE WHEN a THEN 'strict_target_language' WHEN b THEN 'entity_preserving_repair' WHEN c THEN 'deterministic_structure_repair' WHEN d THEN 'source_aware_semantic_repair' ELSE 'strict_retranslation' END AS strategy FROM r")
def g25_repair_units(spark, sf_dir):
    return gates.repair_units(*_manifest(spark, sf_dir))


@query(
    PAIR
    + """, u AS (SELECT conv_id AS document, CAST(turn // 4 AS BIGINT) AS section, length(t) AS chars, length(t) >= 40 AS checked, conv_id % 7 = 0 OR conv_id % 13 = 0 AND turn % 3 = 0 AS src FROM p),
s AS (SELECT document, section, CAST(sum(CASE WHEN checked THEN chars ELSE 0 END) AS BIGINT) AS checked_chars, CAST(sum(CASE WHEN checked AND src THEN chars ELSE 0 END) AS BIGINT) AS source_chars FROM u GROUP BY 1, 2),
w AS (SELECT document, NULL::BIGINT AS section, CAST(sum(checked_chars) AS BIGINT) AS checked_chars, CAST(sum(source_chars) AS BIGINT) AS source_chars FROM s GROUP BY 1), b AS (SELECT *, coalesce(source_chars / nullif(checked_chars, 0)::DOUBLE, 0) AS r FROM (SELECT * FROM s UNION ALL SELECT * FROM w))
SELECT document, section, checked_chars, source_chars, round(r, 6) AS ratio, CASE WHEN section IS NOT NULL AND r > 0.15 AND source_chars >= 40 THEN 'section_source_language_ratio' WHEN section IS NULL AND r > 0.01 THEN 'document_source_language_ratio' END AS code FROM b"""
)
def g22_language_ratios(spark, sf_dir):
    rows = pair_rows(spark, sf_dir)
    units = rows.select(F.col("conv_id").alias("document"), F.floor(F.col("turn") / 4).alias("section"), F.length("t").alias("chars"), (F.length("t") >= 40).alias("checked"), ((F.col("conv_id") % 7 == 0) | ((F.col("conv_id") % 13 == 0) & (F.col("turn") % 3 == 0))).alias("is_source"))
    return gates.language_ratios(units, ["document", "section"])


@query("SELECT l_orderkey AS document, CAST(sum(l_partkey % 90) AS BIGINT) AS prompt_tokens, CAST(sum(l_suppkey % 40) AS BIGINT) AS completion_tokens, CAST(sum(CASE WHEN l_linenumber % 2 = 0 AND l_partkey > 0 THEN l_partkey ELSE l_partkey % 90 + l_suppkey % 40 END) AS BIGINT) AS total_tokens, round(sum(CAST(l_tax AS DECIMAL(9,2)))::DOUBLE, 6) AS cost_usd, coalesce(string_agg(DISTINCT nullif(CASE WHEN l_returnflag = 'R' THEN '' ELSE l_returnflag END, ''), ',' ORDER BY nullif(CASE WHEN l_returnflag = 'R' THEN '' ELSE l_returnflag END, '')), '') AS models FROM lineitem GROUP BY 1")
def g23_model_usage(spark, sf_dir):
    units = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS document", "l_partkey % 90 AS prompt_tokens", "l_suppkey % 40 AS completion_tokens", "CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE 0 END AS total_tokens", "CAST(l_tax AS DECIMAL(9,2)) AS cost_usd", "CASE WHEN l_returnflag = 'R' THEN '' ELSE l_returnflag END AS model")
    return gates.model_usage(units).withColumn("cost_usd", F.col("cost_usd").cast("double"))


@query("SELECT conv_id AS document, concat_ws(',', CASE WHEN count(DISTINCT CASE WHEN conv_id % 3 = 0 THEN role ELSE CAST(turn AS STRING) END) < count(*) THEN 'duplicate_unit_id' END, CASE WHEN min(turn) <> 0 OR max(turn) <> count(*) - 1 OR count(DISTINCT turn) <> count(*) THEN 'non_contiguous_order' END, CASE WHEN bool_or(turn % 5 = 4) THEN 'source_checksum_mismatch' END) AS codes FROM conversations GROUP BY 1")
def w04_manifest_identity(spark, sf_dir):
    units = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document"), F.expr("CASE WHEN conv_id % 3 = 0 THEN role ELSE CAST(turn AS STRING) END").alias("unit"), F.col("turn").alias("ord"), F.col("text").alias("source"), F.col("text").alias("target"), F.when(F.col("turn") % 5 == 4, "0").otherwise(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("source_checksum"), F.lit(None).cast("string").alias("target_checksum"))
    return gates.manifest_identity(units)


@query("WITH s AS (SELECT conv_id AS document, turn AS ord FROM conversations WHERE turn < 6), o AS (SELECT conv_id AS document, turn AS ord FROM conversations WHERE conv_id % 4 <> 0), a AS (SELECT document, count(*) AS n FROM s GROUP BY 1), b AS (SELECT document, count(*) AS m FROM o GROUP BY 1) SELECT document, coalesce(m, 0) - n AS surplus FROM a LEFT JOIN b USING (document)")
def j14_aligned_surplus(spark, sf_dir):
    blocks = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document"), F.col("turn").alias("ord"), "text")
    return gates.aligned(blocks.where("ord < 6"), blocks.where("document % 4 <> 0"))[1]
