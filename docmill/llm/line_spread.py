"""Line dedup by distinct-site spread, in DataFrame operations only.

A line is what lies between line feeds, trimmed of white space; blank lines are none. A HyperLogLog sketch of the sites
of each line hash is merged by aggregation, map side first. Lines whose estimate is clear of the threshold are decided
by it; those near it get an exact distinct count of sites. A line that stands on at least `sites` sites is boilerplate:
its first occurrence (by document id, then place) stays, all others are removed.

Defined cases: a null source is one site of its own, told apart from every text, the empty one included; a null text
stays null and has no lines; a text that loses nothing is unchanged, byte for byte; blank lines stay where they are; a
document without an id comes after those with one; rows that repeat id and text get the same result each, rows that
share an id alone are judged each by its own text; an empty table gives no rows; other columns are kept by
`without_boilerplate` and ignored by `dedup_lines`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, table

#: Sites from which a line is boilerplate; log2 of a sketch's registers; standard errors that count as near.
SITES, REGISTERS, NEAR = 5, 12, 6
#: Fixed value: white space at a line's ends.
BLANK = " \t\n\x0b\f\r"


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(doc_id, h, site, pos, k1, k2) of every line that is not blank; h tells texts of one id apart."""
    site = F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit("null"))
    each = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"), site.alias("site"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    each = each.withColumn("line", F.btrim("line", F.lit(BLANK))).where("line <> ''")
    return each.select("doc_id", "h", "site", "pos", F.xxhash64("line").alias("k1"), F.hash("line").alias("k2"))


def line_sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(k1, k2, n, sketch): occurrences and sketch of sites of each line hash. Those of several corpora merge."""
    return _lines(docs, id_col, text_col, site_col).groupBy("k1", "k2").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", F.lit(REGISTERS)).alias("sketch"))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """One sketch of each line hash, from sketches of several corpora."""
    return sketches.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.hll_union_agg("sketch").alias("sketch"))


def _suspects(sketches: DataFrame, sites: int) -> DataFrame:
    """(k1, k2, n, sure): line hashes that may be boilerplate; sure ones need no exact count."""
    width = max(1.0, NEAR * 1.04 / 2 ** (REGISTERS / 2) * sites)
    spread = F.hll_sketch_estimate("sketch")
    return sketches.where((F.col("n") >= sites) & (spread >= sites - width)).select("k1", "k2", "n", (spread > sites + width).alias("sure"))


def _meet(lines: DataFrame, keys: DataFrame, limit: int) -> DataFrame:
    """Lines that keys name. Keys up to limit are broadcast; of more, only those that hold over 1 / limit of all named
    lines (there are fewer than limit), so that no key of the join that shuffles is hot."""
    if keys.limit(limit + 1).count() <= limit:
        return lines.join(F.broadcast(keys.drop("n")), ["k1", "k2"])
    total = keys.agg(F.sum("n")).first()[0]
    hot = F.broadcast(keys.where(F.col("n") * limit > total).drop("n"))
    rest = lines.join(hot, ["k1", "k2"], "left_anti").join(keys.where(F.col("n") * limit <= total).drop("n"), ["k1", "k2"])
    return lines.join(hot, ["k1", "k2"]).unionByName(rest)


def _removals(docs: DataFrame, id_col: str, text_col: str, site_col: str, sites: int, limit: int) -> DataFrame:
    """(t_id, t_h, gone): the sorted places of the lines that each text loses."""
    lines = _lines(docs, id_col, text_col, site_col)
    suspects = table(_suspects(line_sketches(docs, id_col, text_col, site_col), sites), "suspects")
    met = table(_meet(lines, suspects, limit), "suspect-lines")
    exact = met.where("not sure").groupBy("k1", "k2").agg(F.count_distinct("site").alias("spread")).where(F.col("spread") >= sites).select("k1", "k2")
    decided = table(suspects.where("sure").select("k1", "k2", "n").unionByName(suspects.join(exact, ["k1", "k2"]).select("k1", "k2", "n")), "boilerplate")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "pos")
    repeated = _meet(met.drop("sure"), decided, limit)
    first = table(repeated.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("n")), "first-places")
    gone = _meet(repeated, first, limit).where(~place.eqNullSafe(F.col("first")))
    return gone.groupBy(F.col("doc_id").alias("t_id"), F.col("h").alias("t_h")).agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def _kept(lines: Column, gone: Column) -> Column:
    """The lines between the places that are gone, in time linear in the lines."""
    edges = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    runs = F.zip_with(F.slice(edges, 1, F.size(gone) + 1), F.slice(edges, 2, F.size(gone) + 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.flatten(F.transform(runs, lambda r: F.slice(lines, r["a"] + 2, r["b"] - r["a"] - 1)))


def without_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES, limit: int = BROADCAST_ROWS) -> DataFrame:
    """docs with the texts that are left of theirs."""
    every = _applied(docs, id_col, text_col, site_col, sites, limit)
    return every.select(*[F.col(f"row.`{c}`").alias(c) if c != text_col else F.col("left").alias(c) for c in docs.columns])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) of every row of docs: its lines, those removed, and the text left."""
    every = _applied(docs.select(id_col, text_col, site_col), id_col, text_col, site_col, sites, limit)
    text = F.col(f"row.`{text_col}`")
    filled = F.size(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != ""))
    n_lines = F.when(text.isNull(), 0).otherwise(filled).cast("long")
    n_gone = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    return every.select(F.col(f"row.`{id_col}`").alias("doc_id"), n_lines.alias("n_lines"), n_gone.alias("n_removed"), F.col("left").alias("text"))


def _applied(docs: DataFrame, id_col: str, text_col: str, site_col: str, sites: int, limit: int) -> DataFrame:
    """(row, gone, left): the rows of docs, the places of the lines they lose, the text that is left.

    What texts lose grows with them, so the two meet by a shuffle on the text's key at every size: texts move once.
    """
    gone = table(_removals(docs, id_col, text_col, site_col, sites, limit), "removals")
    joined = docs.join(gone.hint("merge"), docs[id_col].eqNullSafe(gone["t_id"]) & (F.xxhash64(docs[text_col]) == gone["t_h"]), "left")
    joined = joined.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), gone["gone"].alias("gone"))
    text = F.col(f"row.`{text_col}`")
    joined = joined.select("row", "gone", F.when(F.col("gone").isNotNull(), F.split(text, "\n")).alias("lines"))
    return joined.select("row", "gone", F.when(F.col("gone").isNull(), text).otherwise(F.array_join(_kept(F.col("lines"), F.col("gone")), "\n")).alias("left"))
