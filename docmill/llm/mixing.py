"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

The documents of a source, shuffled by the hash of their id, form an endless stream of words, cut into equal blocks.
A slot of the mix is a golden-ratio point, mapped through the cumulative target shares to a source; the rank of the slot
among its source's slots names the block that it takes. So every prefix of the mix holds each source close to its share.
A source's last block is cut where its target ends; slots that the points leave a source short of come last.

Prefix sums and ranks are taken in two levels (totals by hash prefix or run of slots, then within), so no source's rows
meet in one task; only the table of sources (a row each) and tables of totals pass through one. Documents come out in
the order of their first slots.

Defined cases: null or word-less text has size 0, takes 0 and has no slot; null sources form one source, which ranks
last; rows with a null id are placed by the hash of their text; repeated rows are separate documents; rows that share an
id are placed by size, then by the text's hash; ids, sources and texts alone decide, so reruns agree; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import small_side, table

#: Words of a block; slots whose ranks are taken together; cells in which slots find their source; documents whose places
#: are taken together.
BLOCK, RUN, CELLS, TOGETHER = 1024, 65_536, 4096, 2_000
#: Between words stand runs of blanks and of the control characters from tab to carriage return.
GAP = r"[\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, sid, source_size, target): weights by the rank of the source, repeating, share a budget of share times all
    words; no target is above cap times its source's size, and the excess is shared again by weight."""
    rank = W.orderBy(F.col("source").asc_nulls_last())
    t = sizes.withColumn("sid", F.row_number().over(rank) - 1)
    t = t.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("sid") % len(weights) + 1).cast("int")))
    t = t.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    every = W.partitionBy()
    before = W.orderBy(F.col("most") / F.col("w"), "sid").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumns({"budget": F.sum("source_size").over(every) * F.lit(float(share)), "all_w": F.sum("w").over(every), "used": F.coalesce(F.sum("most").over(before), F.lit(0.0)), "used_w": F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    t = t.withColumn("full", F.col("most") / F.col("w") <= (F.col("budget") - F.col("used")) / (F.col("all_w") - F.col("used_w")))
    t = t.withColumns({"held": F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(every), "held_w": F.sum(F.when(F.col("full"), F.col("w")).otherwise(0.0)).over(every)})
    target = F.when(F.col("full"), F.col("most")).otherwise((F.col("budget") - F.col("held")) * F.col("w") / (F.col("all_w") - F.col("held_w")))
    return t.select("source", "sid", "source_size", target.alias("target"))


def placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, cap: float) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in the stream of their source (doc_id, source, size, t, sid, at), and the sources."""
    size = F.size(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), GAP), "")).cast("long")
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(F.col(text_col)).alias("t"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("m"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), "m"))
    sized = table(plain.select("doc_id", "source", "size", "t", F.md5(name).alias("h")), "mixing-sizes")
    sources = table(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "mixing-sources")
    digits, n = 1, sized.count()
    while n > TOGETHER * 16**digits and digits < 8:
        digits += 1
    known = small_side(sources.select(F.col("source").alias("s"), "sid"))
    sized = sized.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("part", F.substring("h", 1, digits))
    totals = sized.groupBy("sid", "part").agg(F.sum("size").alias("words"))
    totals = totals.select("sid", "part", F.coalesce(F.sum("words").over(W.partitionBy("sid").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("size").over(W.partitionBy("sid", "part").orderBy("h", "size", "t").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = sized.withColumn("inside", inside).join(small_side(totals), ["sid", "part"])
    return out.select("doc_id", "source", "size", "t", "sid", (F.col("base") + F.col("inside")).alias("at")), sources


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, sid, block_no): the order in which the mix takes the blocks of the sources."""
    spark = sources.sparkSession
    need = sources.select("sid", F.round("target").cast("long").alias("take")).withColumn("blocks", F.ceil(F.col("take") / F.lit(block)).cast("long"))
    slots = need.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    reach = W.orderBy("sid")
    spans = need.where("blocks > 0").withColumn("hi", F.sum("blocks").over(reach) / F.lit(float(max(1, slots)))).withColumn("lo", F.coalesce(F.lag("hi").over(reach), F.lit(0.0)))
    cells = spans.select("sid", "blocks", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.col("hi") * CELLS))).alias("cell"))
    golden = (5**0.5 - 1) / 2
    far = (golden * (1 << 24)) % 1.0
    i = F.col("id")
    x = F.shiftright(i, 24) * F.lit(far) + i.bitwiseAND(F.lit((1 << 24) - 1)) * F.lit(golden)
    points = spark.range(slots).withColumn("x", x - F.floor(x)).withColumn("cell", F.floor(F.col("x") * CELLS))
    drawn = points.join(small_side(cells), "cell").where("x >= lo and x < hi").select("id", "sid").withColumn("run", F.floor(F.col("id") / RUN))
    drawn = table(drawn, "mixing-slots")
    runs = drawn.groupBy("sid", "run").agg(F.count("*").alias("n"))
    runs = runs.select("sid", "run", "n", F.coalesce(F.sum("n").over(W.partitionBy("sid").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranked = drawn.withColumn("inside", F.row_number().over(W.partitionBy("sid", "run").orderBy("id")) - 1).join(small_side(runs.select("sid", "run", "base")), ["sid", "run"])
    ranked = ranked.select(F.col("id").alias("slot"), "sid", (F.col("base") + F.col("inside")).alias("block_no"))
    kept = ranked.join(small_side(need.select("sid", "blocks")), "sid").where("block_no < blocks").select("slot", "sid", "block_no")
    got = runs.groupBy("sid").agg(F.sum("n").alias("got"))
    short = need.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < blocks")
    late = short.select("sid", F.explode(F.expr("sequence(got, blocks - 1)")).alias("block_no"))
    return kept.unionByName(late.select((F.lit(slots) + F.col("block_no")).alias("slot"), "sid", "block_no"))


def mix_fragments(docs: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, sid, at, doc_id, pass, first, words): which words of which document each slot of the mix takes."""
    ends = sources.select("sid", "source_size", F.round("target").cast("long").alias("take"))
    d = docs.where("size > 0").join(small_side(ends), "sid").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("take") - 1) / F.col("source_size"))))))
    d = d.withColumn("start", F.col("pass") * F.col("source_size") + F.col("at")).withColumn("end", F.least(F.col("start") + F.col("size"), "take")).where("start < end")
    d = d.withColumn("block_no", F.explode(F.expr(f"sequence(start div {block}, (end - 1) div {block})")))
    lo, hi = F.greatest("start", F.col("block_no") * block), F.least("end", (F.col("block_no") + 1) * block)
    d = d.select("sid", "at", "doc_id", "pass", "block_no", (lo - F.col("start")).alias("first"), (hi - lo).alias("words"))
    return d.join(schedule(sources, block), ["sid", "block_no"]).select("slot", "sid", "at", "doc_id", "pass", "first", "words")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot, n_slots, source) of every row of docs: the words that the
    mix takes of it, the first slot that takes some, and how many do."""
    where, sources = placed(docs, id_col, text_col, source_col, weights, share, cap)
    where = table(where, "mixing-placed")
    taken = mix_fragments(where, sources).groupBy(F.col("sid").alias("s"), F.col("at").alias("a")).agg(F.sum("words").alias("words"), F.min("slot").alias("first_slot"), F.count("*").alias("n_slots"))
    out = where.join(taken, (F.col("sid") == F.col("s")) & (F.col("at") == F.col("a")) & (F.col("size") > 0), "left").join(small_side(sources.select("sid", "source_size", "target")), "sid")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), "first_slot", F.coalesce("n_slots", F.lit(0)).alias("n_slots"), "source")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The rows of docs, whole, as often as the mix begins to take them, in the order of the slots that begin to; a source
    passes its target by less than one document a pass. Word-less documents have no words to take and go."""
    where, sources = placed(docs, id_col, text_col, source_col, weights, share, cap)
    where = table(where, "mixing-placed")
    starts = mix_fragments(where, sources).where("first = 0").groupBy(F.col("sid").alias("s"), F.col("at").alias("a")).agg(F.collect_list("slot").alias("slots"))  # a slot a pass
    taken = where.where("size > 0").join(starts, (F.col("sid") == F.col("s")) & (F.col("at") == F.col("a")), "left")
    # Rows that share id, source and text are alike in all that places them.
    plan = taken.groupBy(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("t").alias("m_t")).agg(F.count("*").alias("m_rows"), F.array_sort(F.collect_list(F.struct("at", "slots"))).alias("m_slots"))
    plan = table(plan, "mixing-plan")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    inner = docs.select(row, F.col(id_col).alias("i"), F.col(source_col).alias("s"), F.xxhash64(F.col(text_col)).alias("t"))
    met = inner.join(plan, F.col("i").eqNullSafe(F.col("m_id")) & F.col("s").eqNullSafe(F.col("m_source")) & (F.col("t") == F.col("m_t")))
    out = met.where("m_rows = 1").select("row", F.explode(F.col("m_slots")[0]["slots"]).alias("slot"))
    if plan.where("m_rows > 1").head(1):
        nth = F.row_number().over(W.partitionBy("i", "s", "t").orderBy(F.xxhash64("row")))
        again = met.where("m_rows > 1").withColumn("nth", nth)
        out = out.unionByName(again.select("row", F.explode(F.element_at("m_slots", F.col("nth"))["slots"]).alias("slot")))
    return out.repartitionByRange("slot").sortWithinPartitions("slot").select("row.*")
