"""Queries of small marks in texts, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions import marks as M
from docmill.operators import boards
from docmill.plans.base import query, read
from docmill.plans.boards import _evaluations

WHOLE = "coalesce(text, '')"


@query(r"""SELECT doc_id, pos, regexp_matches(substr(coalesce(text, ''), 1, pos), '(?:^|\n|[.!?]["''»”)]?\s)\s*["''«“(]?$') AS begins FROM documents, (SELECT unnest([0, 17, 64, 200, 333]) AS pos)""")
def f23_sentence_begins(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.array(*[F.lit(k) for k in (0, 17, 64, 200, 333)])).alias("pos"))
    return rows.select("doc_id", "pos", M.begins_sentence(F.col("text"), F.col("pos")).alias("begins"))


CONTENT = "CASE doc_id % 7 WHEN 0 THEN 'V_{cm}' WHEN 1 THEN '10.50' WHEN 2 THEN 'price' WHEN 3 THEN 'x^2 + y^2' WHEN 4 THEN cast(doc_id AS varchar(9)) WHEN 5 THEN '10.505' ELSE text END"


@query(f"WITH c AS (SELECT doc_id, {CONTENT} AS content FROM documents) SELECT doc_id, NOT regexp_full_match(coalesce(content, ''), '[0-9]+([.][0-9][0-9]?)?|[a-zA-Z]+') AS formula FROM c")
def f28_formula_or_price(spark, sf_dir):
    return read(spark, sf_dir, "documents").selectExpr("doc_id", f"{CONTENT} AS content").select("doc_id", M.is_formula(F.col("content")).alias("formula"))


@query(rf"""WITH t AS (SELECT doc_id, {WHOLE} AS t, length({WHOLE}) AS n FROM documents), h AS (SELECT doc_id, t, n, CASE WHEN n < 100 THEN n // 2 ELSE floor(n * 0.4::DOUBLE)::BIGINT END AS pos FROM t),
p AS (SELECT doc_id, n, substr(t, 1, pos) AS a, substr(t, pos + 1) AS b FROM h)
SELECT doc_id, md5(CASE WHEN n < 100 THEN a ELSE regexp_replace(a, '^\s+|\s+$', '', 'g') END) AS first, md5(CASE WHEN n < 100 THEN b ELSE regexp_replace(b, '^\s+|\s+$', '', 'g') END) AS second FROM p""")
def k21_halves(spark, sf_dir):
    first, second = M.halves(F.col("text"), 0.4)
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(first).alias("first"), F.md5(second).alias("second"))


TAGGED = "concat('[id0]', coalesce(substr(text, 1, 40), ''), '[id1]', coalesce(text, ''), '[id10][id2]', 'end [id', doc_id, ']')"
TAGS = {"[id0]": "<p>", "[id1]": "<b>", "[id2]": "</p>", "[id10]": "</b>"}


def _tagged(spark, sf_dir):
    return read(spark, sf_dir, "documents").selectExpr("doc_id", f"{TAGGED} AS t")


@query(f"SELECT doc_id, md5(replace(replace(replace(replace({TAGGED}, '[id10]', '</b>'), '[id2]', '</p>'), '[id1]', '<b>'), '[id0]', '<p>')) AS digest FROM documents")
def y12_restored_tags(spark, sf_dir):
    tags = F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair])
    return _tagged(spark, sf_dir).select("doc_id", F.md5(M.restored_tags(F.col("t"), tags)).alias("digest"))


@query(f"SELECT doc_id, array_to_string(list_filter(regexp_extract_all({TAGGED}, '\\[id[0-9]+\\]'), lambda p: list_contains(['[id0]', '[id2]'], p)), ',') AS signature FROM documents")
def y14_signature(spark, sf_dir):
    blocks = F.array(F.lit("[id0]"), F.lit("[id2]"))
    return _tagged(spark, sf_dir).select("doc_id", F.array_join(M.signature(F.col("t"), blocks), ",").alias("signature"))


PROMPT = "concat(CASE doc_id % 13 " + " ".join(f"WHEN {k} THEN '{p[-1]} '" for k, (_, p) in enumerate(M.PHASES)) + " WHEN 10 THEN '\"suggestions\" del GLOSARIO ' WHEN 11 THEN '' END, coalesce(substr(text, 1, 60), ''))"


def _told(phrase: str) -> str:
    beside = f" AND contains(p, '{M.BESIDE[phrase]}')" if phrase in M.BESIDE else ""
    return f"(contains(p, '{phrase}'){beside})"


@query(f"WITH p AS (SELECT doc_id, lower({PROMPT}) AS p FROM documents) SELECT doc_id, CASE " + " ".join(f"WHEN {' OR '.join(_told(x) for x in phrases)} THEN '{name}'" for name, phrases in M.PHASES) + " ELSE 'llm_call' END AS phase FROM p")
def y42_phase(spark, sf_dir):
    return read(spark, sf_dir, "documents").selectExpr("doc_id", f"{PROMPT} AS p").select("doc_id", M.phase(F.col("p")).alias("phase"))


NAMED = r"concat('Ro*Land met Al\\Ban and Ann*Lee. ', coalesce(text, ''), ' Ann*Lee, Val*Di and ViI*Ox')"
RENDERED = r"concat('Ro*Land met AlBan, ', CASE WHEN doc_id % 2 = 0 THEN 'Ann Lee, Vil*Ox ' ELSE 'Ann*Lee Val*Di ' END, coalesce(text, ''))"


def _renderings(spark, sf_dir):
    return read(spark, sf_dir, "documents").selectExpr("doc_id", f"{NAMED} AS s", f"{RENDERED} AS c")


@query()
def j20_missing_symbol_names(spark, sf_dir):
    return M.missing_symbol_names(_renderings(spark, sf_dir), "doc_id", "s", "c")


@query()
def c36_restored_symbol_names(spark, sf_dir):
    return _renderings(spark, sf_dir).select("doc_id", F.md5(M.restored_symbol_names(F.col("s"), F.col("c"))).alias("digest"))


NOTED = "concat('See [the label](https://a.b/c) [[12]](#n) x [3], ', coalesce(text, ''), ' [5](notes.html) [z-library](u) www.a.org/x ( ) .')"


@query()
def c28_spoken_text(spark, sf_dir):
    text, links, notes = M.spoken(F.col("t"))
    return read(spark, sf_dir, "documents").selectExpr("doc_id", f"{NOTED} AS t").select("doc_id", F.md5(text).alias("digest"), links.alias("links"), notes.alias("notes"))


OUT = "CASE WHEN turn % 3 = 1 THEN '  ' ELSE text END"


@query(rf"""WITH b AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS s, trim(coalesce({OUT}, '')) AS o FROM conversations),
w AS (SELECT conv_id, turn, s, o, right(coalesce(lag(s) OVER x, ''), 500) AS context_before, substr(coalesce(lead(s) OVER x, ''), 1, 500) AS context_after FROM b WINDOW x AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, s AS text, context_before, context_after FROM w WHERE o = '' AND regexp_matches(s, '[\p{{L}}\p{{N}}_]')""")
def y05_emptied_blocks(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "text", f"{OUT} AS o")
    return M.emptied_blocks(turns, "conv_id", "turn", "text", "o")


@query()
def y44_tournament(spark, sf_dir):
    population = boards.fitness(_evaluations(spark, sf_dir)).select("prompt", "fitness")
    return boards.tournament(population, spark.range(20).withColumnRenamed("id", "slot"), 3)


@query("SELECT * FROM (VALUES " + ", ".join("({}, '{}', '{}')".format(k, *p.split(">")) for k, p in enumerate((M.PAIR_TIERS[0][1] + " " + M.PAIR_TIERS[1][1]).split())) + ") AS t(place, source, target)")
def y47_pair_tier(spark, sf_dir):
    return M.pair_tier(spark, " Standard")
