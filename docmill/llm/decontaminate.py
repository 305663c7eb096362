"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

The index stores, of the training text, the postings (term, document, position) of those terms that the test windows
are looked up by: of each window its two rarest terms, by their counts over all documents. The postings' positions,
adjusted by the terms' offsets in the window, are intersected, rarest first; what remains is compared word by word with
the window, in the few documents that have a candidate. Proximity matches come from the same lists.

Defined cases: null or word-less text has no words, no hits, and the digest of an empty list; an item without words has
no window; an item of fewer words than a window is one window; items that share a window all count; an item without an
id can hit but is not listed; rows that repeat id and text get the same result each; rows that share an id alone are
judged each by its own text; empty tables give no hits or no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import small_side, table

#: Words of a window; terms by which a window is looked up; places by which they may be off in a proximity match.
WINDOW, ANCHORS, SLOP = 13, 2, 2
#: What lies between words, and the letters that are lowered.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def raw_words(text: Column) -> Column:
    """The words of a text in their own letters; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def lowered(word: Column) -> Column:
    """A-Z lowered, and nothing else."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def test_windows(items: DataFrame, item_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(wid, len, terms) of each different window, and (wid, item) for each item that has it."""
    words = items.select(F.col(item_col).cast("string").alias("item"), F.transform(raw_words(F.col(text_col)), lowered).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window + 1))
    each = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("terms")).withColumn("wid", F.xxhash64(F.concat_ws(" ", "terms")))
    each = table(each.distinct(), "windows")
    return each.select("wid", F.size("terms").alias("len"), "terms").dropDuplicates(["wid"]), each.select("wid", "item").distinct()


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), raw_words(text).alias("words"))


def anchors(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, wid, off, len, rank, of): the rarest terms of each window whose terms all occur in docs; of is how many."""
    terms = windows.select("wid", "len", F.posexplode("terms").alias("off", "term"))
    vocabulary = table(terms.select("term").distinct(), "terms")
    counts = _scan(docs, id_col, text_col).select(F.explode("words").alias("w")).select(lowered(F.col("w")).alias("term")).join(small_side(vocabulary), "term").groupBy("term").agg(F.count("*").alias("n"))
    found = terms.join(table(counts, "term-counts"), "term", "left")
    found = found.groupBy("wid", "len", "term").agg(F.min("off").alias("off"), F.first("n").alias("n"))
    whole = W.partitionBy("wid")
    found = found.withColumn("lost", F.max(F.col("n").isNull()).over(whole)).where("not lost")
    found = found.withColumn("rank", F.row_number().over(whole.orderBy("n", "term"))).where(F.col("rank") <= ANCHORS)
    return table(found.withColumn("of", F.max("rank").over(whole)).select("term", "wid", "off", "len", "rank", "of"), "anchors")


def postings(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """In one pass over the texts: the index (term, doc_id, h, n_words, pos) for the terms that keys name (h tells texts of
    one id apart), and (doc_id, h, n_words) of every row of docs, which a word of null after a text's last one stands for."""
    each = _scan(docs, id_col, text_col).select("doc_id", "h", F.size("words").alias("n_words"), F.posexplode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("pos", "w"))
    each = each.select(lowered(F.col("w")).alias("term"), "doc_id", "h", "n_words", "pos")
    wanted = keys.select("term").distinct().withColumn("wanted", F.lit(True))
    written = table(each.join(small_side(wanted), "term", "left").where("wanted or term is null").drop("wanted"), "postings")
    return written.where("term is not null"), written.where("term is null").select("doc_id", "h", F.col("n_words").cast("long").alias("n_words"))


def _lists(index: DataFrame, keys: DataFrame) -> DataFrame:
    """Offset-adjusted lists: where each window would start for each posting of one of its terms."""
    found = index.join(small_side(keys), "term").withColumn("start", F.col("pos") - F.col("off"))
    return found.where("start >= 0 and start + len <= n_words").select("doc_id", "h", "wid", "start", "len", "rank", "of")


def exact_phrases(docs: DataFrame, index: DataFrame, keys: DataFrame, windows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, wid, start, len) of every occurrence of a window."""
    met = _lists(index, keys).groupBy("doc_id", "h", "wid", "start", "len", "of").agg(F.count_distinct("rank").alias("n")).where("n = of")
    tested = met.join(small_side(windows.select("wid", F.concat_ws(" ", "terms").alias("phrase"))), "wid")
    tested = table(tested.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "len", "wid", "phrase")).alias("met")), "phrases-met")
    met = tested.select(F.col("doc_id").alias("t_id"), F.col("h").alias("t_h"), "met")
    # Only the texts that have a candidate are taken apart again.
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    texts = texts.join(small_side(met.select("t_id", "t_h")), texts["doc_id"].eqNullSafe(F.col("t_id")) & (F.col("h") == F.col("t_h")), "left_semi").distinct()
    texts = texts.join(met, texts["doc_id"].eqNullSafe(F.col("t_id")) & (F.col("h") == F.col("t_h")))
    texts = texts.select("doc_id", "h", F.transform(raw_words(F.col("text")), lowered).alias("words"), "met")
    same = F.filter("met", lambda m: F.array_join(F.slice("words", m["start"] + 1, m["len"]), " ") == m["phrase"])
    return texts.select("doc_id", "h", F.inline(F.transform(same, lambda m: F.struct(m["wid"].alias("wid"), m["start"].alias("start"), m["len"].alias("len"))))).distinct()


def near_starts(index: DataFrame, keys: DataFrame, slop: int) -> DataFrame:
    """(doc_id, h, wid, start): where the rarest terms of a window stand within slop places of their places in it."""
    lists = _lists(index, keys)
    cell = F.floor(F.col("start") / (slop + 1))
    first = lists.where("rank = 1").select("doc_id", "h", "wid", "start", "of", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    rest = lists.where("rank > 1").select(F.col("doc_id").alias("r_id"), F.col("h").alias("r_h"), F.col("wid").alias("r_wid"), F.col("start").alias("r_start"), cell.alias("r_cell"))
    on = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("h") == F.col("r_h")) & (F.col("wid") == F.col("r_wid")) & (F.col("cell") == F.col("r_cell"))
    near = first.join(rest, on).where(F.abs(F.col("start") - F.col("r_start")) <= slop)
    return near.unionByName(first.where("of = 1"), allowMissingColumns=True).select("doc_id", "h", "wid", "start").distinct()


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, wid, start): where the rarest terms of a window stand within slop places of their places in it."""
    windows, _ = test_windows(items, item_col, item_text, window)
    keys = anchors(docs, windows, id_col, text_col)
    return near_starts(postings(docs, keys, id_col, text_col)[0], keys, slop).select("doc_id", "wid", "start")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, h) of every row of docs; n_near counts where the
    rarest terms of a window stand within SLOP places of their places in it (what a window less exact would match)."""
    windows, owners = test_windows(items, item_col, item_text, window)
    keys = anchors(docs, windows, id_col, text_col)
    index, every = postings(docs, keys, id_col, text_col)
    hits = table(exact_phrases(docs, index, keys, windows, id_col, text_col), "phrases")
    before = W.partitionBy("doc_id", "h").orderBy("start", "len").rowsBetween(W.unboundedPreceding, -1)
    spans = hits.select("doc_id", "h", "start", (F.col("start") + F.col("len")).alias("end"), "len").distinct()
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0))))
    hit = spans.withColumn("fresh", fresh).groupBy("doc_id", "h").agg(F.sum("fresh").alias("n_hit"))
    listed = hits.select("doc_id", "h", "wid").distinct().join(small_side(owners), "wid").groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("item")).alias("items"))
    told = hit.join(listed, [hit["doc_id"].eqNullSafe(listed["doc_id"]), hit["h"] == listed["h"]]).select(hit["doc_id"].alias("t_id"), hit["h"].alias("t_h"), "n_hit", "items")
    near = near_starts(index, keys, SLOP).groupBy(F.col("doc_id").alias("p_id"), F.col("h").alias("p_h")).agg(F.count("*").alias("n_near"))
    told = told.join(near, [told["t_id"].eqNullSafe(near["p_id"]), told["t_h"] == near["p_h"]], "full_outer")
    told = told.select(F.coalesce("t_id", "p_id").alias("t_id"), F.coalesce("t_h", "p_h").alias("t_h"), "n_hit", "items", "n_near")
    out = every.join(told, every["doc_id"].eqNullSafe(F.col("t_id")) & (F.col("h") == F.col("t_h")), "left")
    n_hit, found = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), F.sha2(F.array_join(found, ","), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"), F.coalesce("n_near", F.lit(0)).alias("n_near"), "h")


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that are not contaminated."""
    told = decontaminate(docs, items, id_col, text_col, **options).where("contaminated").select(F.col("doc_id").alias("t_id"), F.col("h").alias("t_h")).distinct()
    told = table(told, "contaminated")
    return docs.join(small_side(told), docs[id_col].eqNullSafe(told["t_id"]) & (F.xxhash64(docs[text_col]) == told["t_h"]), "left_anti")
