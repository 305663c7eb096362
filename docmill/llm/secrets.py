"""Secret scans with a randomness test battery, in DataFrame operations only.

Base spans come from three patterns. The battery adds spans of kind "random": a token of 20 or more characters that
mixes letters with digits, or cases inside a word, and that is no UUID, is taken to be written in the least alphabet that
holds it (hex, base 32 or base 62 and 64), and tested three ways, on its letters and digits: how much its characters
repeat beyond what is uniform in that alphabet (chi-squared), how often the class of character changes (runs; a capital
goes with the small letter after it), and the serial correlation of neighbours' codes.

What ordinary tokens score is measured on the corpus itself: all tokens of NULL_LENGTH or more characters that are made
of words alone (with numbers and separators between them) give the mean and spread of each test, and then the spread of
the sum of the standardised tests, all shrunk to a prior that holds where there are few. False discoveries
are controlled at FDR (Benjamini-Hochberg) among tokens of like length over the whole corpus, from counts of scores by
bin: bounded tables, however large the corpus. Base spans are tested like others, so random spans may touch them.

Positions come from the lengths of what a pattern matches and of what lies between, summed within a document.

Defined cases: null text is empty; rows that repeat id and text get the same result each; rows that share an id alone
are judged each by its own text; a null id is an id like others; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import table

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
#: One of these is in every text that the first pattern matches, in lower case.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")
#: What may be random; tokens of words and numbers, which are ordinary; the least length of an assigned value.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"
ORDINARY = r"^[+/_-]*(?:(?:[A-Z]?[a-z]{3,}|[A-Z]{4,})(?:[+/_-]+|[0-9]{1,4}(?![0-9])|(?=[A-Z])|$)|[0-9]{1,4}[+/_-]+)+[0-9]{0,4}$"
UUID = r"^(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
VALUE = 8
#: Least length of a token that is tested, and of one that tells what ordinary tokens score; expected false share among
#: the random spans; score bins a unit; lengths at which classes of like length begin.
LENGTH, NULL_LENGTH, FDR, BINS, LENGTHS = 20, 16, 0.01, 50, (20, 32, 64, 256)
#: Ordinary tokens before any is seen: mean and spread (of one character) of the tests, and how many tokens that counts for.
TESTS = ("repeats", "changes", "serial")
MEAN, SPREAD, WEIGHT = (0.05, 0.07, 0.3), (0.15, 0.4, 1.0), 200.0


#: What marks matches while they are taken apart.
EDGE, INNER = "\x01", "\x02"


def _marked(text: Column, pattern: str, group: int) -> Column:
    """text cut at the matches of a pattern: what lies between them and, in turn, each match with a group of it."""
    return F.split(F.regexp_replace(text, pattern, f"{EDGE}$0{INNER}${group}{EDGE}"), EDGE, -1)


def _found(parts: Column) -> Column:
    """(gap, hit, value) of each match: lengths of the text before it and of itself, and a group of it."""
    gaps, hits = F.filter(parts, lambda _, i: i % 2 == 0), F.filter(parts, lambda _, i: i % 2 == 1)
    rows = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(F.length(g).alias("gap"), F.length(F.substring_index(h, INNER, 1)).alias("hit"), F.substring_index(h, INNER, -1).alias("value")))
    return F.when(F.size(parts) > 1, rows)


def _matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = reduce(or_, [F.contains(F.lower("t"), F.lit(n)) for n in NAMES])
    # No pattern matches the marks, so texts that hold them are told by blanks in their place.
    plain = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), F.translate(text, EDGE + INNER, "\x03\x03").alias("t"))
    # Whatever else a text holds, hex runs lie in tokens.
    cut = plain.select("doc_id", "h", "t", F.when(named, _marked(F.col("t"), ASSIGN, 2)).alias("assign"), F.when(F.contains("t", F.lit("AKIA")), _marked(F.col("t"), ACCESS, 0)).alias("access"), _marked(F.col("t"), TOKEN, 0).alias("random"))
    cut = cut.withColumn("hex", F.when(F.exists("random", lambda x: x.rlike(HEX)), _marked(F.col("t"), HEX, 0)))
    return cut.select("doc_id", "h", *[_found(F.col(k)).alias(k) for k in KINDS])


def _spans(scanned: DataFrame) -> DataFrame:
    """(doc_id, h, kind, start, end, value), kind by its number; each different text of an id once."""
    parts = [scanned.where(F.col(k).isNotNull()).select("doc_id", "h", F.lit(i).alias("kind"), F.posexplode(k).alias("nth", "m")).select("doc_id", "h", "kind", "nth", "m.gap", "m.hit", "m.value") for i, k in enumerate(KINDS)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.distinct()
    so_far = W.partitionBy("doc_id", "h", "kind").orderBy("nth")
    end = F.sum(F.col("gap") + F.col("hit")).over(so_far)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("hit")).select("doc_id", "h", "kind", "start", "end", "value")


def battery(tokens: DataFrame) -> DataFrame:
    """tokens (value, ...) with what the three tests measure of the value's letters and digits, and how many these are.

    Each step is a column of its own, so that no step runs again for every character of the next."""
    solid, chars, codes = F.col("solid"), F.col("chars"), F.col("codes")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, c: a + c)
    out = tokens.withColumn("solid", F.regexp_replace("value", "[^A-Za-z0-9]", "")).withColumns({"chars": F.split(solid, ""), "size": F.length(solid).cast("double")})
    out = out.withColumn("codes", F.transform(chars, lambda c: F.ascii(c).cast("double")))
    kind = lambda c: F.when(c < 58, 0).when(c < 91, 1).otherwise(2)
    out = out.withColumns({"kinds": F.transform(codes, kind), "mean": total(codes) / F.col("size")})
    out = out.withColumn("off", F.transform(codes, lambda c: c - F.col("mean")))
    neighbours = lambda name, f: total(F.zip_with(F.slice(name, F.lit(1), F.size(name) - 1), F.slice(name, F.lit(2), F.size(name) - 1), f))
    alphabet = F.when(solid.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 16.0).when(solid.rlike("^[A-Z2-7]+$"), 32.0).otherwise(62.0)
    times = F.transform(F.array_distinct(chars), lambda c: F.col("size") - F.length(F.replace(solid, c, F.lit(""))))
    out = out.withColumns({"times": times, "spread": total(F.transform("off", lambda c: c * c)), "alphabet": alphabet})
    # Chi-squared over the alphabet, as the rate at which two characters agree beyond the uniform one.
    repeats = total(F.transform("times", lambda c: c * (c - 1))) / (F.col("size") * (F.col("size") - 1)) - 1.0 / F.col("alphabet")
    changes = neighbours("kinds", lambda a, b: ((a != b) & ~((a == 1) & (b == 2))).cast("double")) / (F.col("size") - 1)
    serial = F.when(F.col("spread") > 0, neighbours("off", lambda a, b: a * b) / F.col("spread")).otherwise(1.0)
    return out.withColumns({"repeats": repeats, "changes": changes, "serial": serial}).drop("solid", "chars", "codes", "kinds", "mean", "off", "times", "spread", "alphabet")


def ordinary_tests(tokens: DataFrame) -> DataFrame:
    """One row: mean and spread (as of one character) of each test over ordinary tokens with their tests."""
    w, n = F.lit(WEIGHT), F.count("*")
    means = [((F.coalesce(F.sum(t), F.lit(0.0)) + w * m) / (n + w)).alias(f"m_{t}") for t, m in zip(TESTS, MEAN, strict=True)]
    spreads = [((F.coalesce(F.sum("size") * F.var_pop(t), F.lit(0.0)) + w * s * s) / (n + w)).alias(f"v_{t}") for t, s in zip(TESTS, SPREAD, strict=True)]
    return tokens.agg(*means, *spreads)


def summed(tests: DataFrame, usual: DataFrame) -> DataFrame:
    """tests with the sum of their standard scores: the higher, the less ordinary."""
    z = [sign * (F.col(t) - F.col(f"m_{t}")) * F.sqrt("size") / F.sqrt(F.col(f"v_{t}")) for t, sign in zip(TESTS, (-1.0, 1.0, -1.0), strict=True)]
    score = (z[0] + z[1] + z[2] * F.signum(F.col("m_serial"))) / F.sqrt(F.lit(3.0))
    return tests.join(F.broadcast(usual)).withColumn("score", score).drop(*usual.columns)  # one row


def calibrated(tests: DataFrame) -> DataFrame:
    """The rows to be tested with their score, whose spread over ordinary tokens is one."""
    scored = table(summed(tests, ordinary_tests(tests.where("ordinary"))), "secrets-scored")
    w = F.lit(WEIGHT)
    spread = scored.where("ordinary").agg(F.sqrt((F.coalesce(F.sum(F.col("score") * F.col("score")), F.lit(0.0)) + w) / (F.count("*") + w)).alias("usual"))
    return scored.where("tested").join(F.broadcast(spread)).withColumn("score", F.col("score") / F.col("usual")).drop("usual")  # one row


def upper_tail(z: Column) -> Column:
    """1 - the normal distribution function, within 1e-7 absolutely, and falling for every z >= 0."""
    x = F.greatest(z, F.lit(0.0)) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return 0.5 * series * F.exp(-x * x)


def random_spans(spans: DataFrame) -> DataFrame:
    """Of the spans of kind random, those that the battery discovers."""
    value = F.col("value")
    mixed = (value.rlike("[0-9]") & value.rlike("[A-Za-z]")) | value.rlike("[a-z][A-Z]")
    ordinary = value.rlike(ORDINARY)
    tokens = spans.where(F.col("kind") == KINDS.index("random")).withColumn("ordinary", ordinary)
    tokens = tokens.where(~value.rlike(UUID) & (F.col("ordinary") | (mixed & (F.length("value") >= LENGTH))))
    tokens = tokens.select("doc_id", "h", "kind", "start", "end", "value", F.length("value").alias("length"), "ordinary", (mixed & (F.length("value") >= LENGTH)).alias("tested"))
    tokens = tokens.repartition(int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "h", "start")  # a few bytes, but much to do
    known = table(battery(tokens).drop("value"), "secrets-tested")
    of_length = F.lit(0)
    for i, n in enumerate(LENGTHS):
        of_length = F.when(F.col("length") >= n, i).otherwise(of_length)
    scored = calibrated(known).withColumn("class", of_length)
    scored = scored.withColumn("bin", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("score"))) * BINS))
    counts = scored.groupBy("class", "bin").agg(F.count("*").alias("n"))
    above = W.partitionBy("class").orderBy(F.desc("bin"))
    counts = counts.withColumns({"k": F.sum("n").over(above), "m": F.sum("n").over(W.partitionBy("class"))})
    least = counts.where(upper_tail(F.col("bin") / F.lit(float(BINS))) <= F.lit(FDR) * F.col("k") / F.col("m")).groupBy("class").agg(F.min("bin").alias("least"))
    return scored.join(F.broadcast(least), "class").where("bin >= least").select("doc_id", "h", "kind", "start", "end")  # at most a row for each of LENGTHS


def told_apart(spans: DataFrame) -> DataFrame:
    """Spans, with fresh: a random one that touches no base span."""
    known = F.col("kind") < KINDS.index("random")
    order = W.partitionBy("doc_id", "h").orderBy("start", "kind")
    before = F.max(F.when(known, F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, 0))
    after = F.min(F.when(known, F.col("start"))).over(order.rowsBetween(0, W.unboundedFollowing))
    new = spans.withColumns({"before": before, "after": after})
    touches = F.coalesce(F.col("before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("after") < F.col("end"), F.lit(False))
    return new.withColumn("fresh", ~known & ~touches).drop("before", "after")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random, n_new) of every row of docs; n_new random spans
    touch no base span."""
    scanned = table(_matches(docs, id_col, text_col), "secrets-scanned")
    spans = table(_spans(scanned), "secrets-spans")
    base = spans.where((F.col("kind") != KINDS.index("random")) & ((F.col("kind") != 0) | (F.length("value") >= VALUE))).drop("value")
    every = told_apart(base.unionByName(random_spans(spans)))
    by_doc = every.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("found"), F.count_if("fresh").alias("n_new"))
    by_doc = by_doc.select(F.col("doc_id").alias("s_id"), F.col("h").alias("s_h"), "found", "n_new")
    plain = scanned.select("doc_id", "h")
    out = plain.join(by_doc, plain["doc_id"].eqNullSafe(by_doc["s_id"]) & (F.col("h") == F.col("s_h")), "left")
    found = F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    names = F.array(*map(F.lit, KINDS))
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(found, lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(said(F.filter(found, lambda s: s["kind"] < 3)), 256).alias("base_sha256"), said(found).alias("spans"), count(3).alias("n_random"), F.coalesce("n_new", F.lit(0)).alias("n_new"))
