"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each source has a target number of words.  A document of a source with target
share f = target / words is taken floor(f) times, and once more with
probability p = f - floor(f), where the extra copies of a source are drawn
together: two documents with fractional probabilities trade probable words (a
random direction, with odds that keep every expectation) until one of them is
decided.  The words expected of the pair never change, so the words taken of a
source end within one document of its target.

The trades form a reduction tree: blocks of about ``fan`` documents, chosen by
hash, each trade down to one undecided document; those meet in blocks again,
until one is left in each source and is drawn by its own probability.  No block
depends on the size of a source, and every level is written to the shared
folder.  All choices hash the document and the seed, so reruns agree.

Defined results: a null text has size 0 and is never copied; sources are
ordered by code point with null last, and null is a source; repeated rows are
drawn each by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

#: A word: a run of characters other than space and the controls 0x09 to 0x0D.
WORD = "[^\\x20\\x09-\\x0D]+"

_UNIT = "struct<doc_id:bigint,copy:bigint,size:bigint>"

#: Trades along a block.  The carrier (u, m) is undecided with m probable words of u.size; e is the next document.
#: up: the carrier gains least(its room, e.m); down: it loses least(m, e's room).  The odds are inverse to the amounts.
_TRADE = f"""
aggregate(units,
  cast(named_struct('u', null, 'm', 0D, 'out', array()) as struct<u:{_UNIT},m:double,out:array<struct<u:{_UNIT},x:int>>>),
  (a, e) -> case
    when a.u is null then named_struct('u', e.u, 'm', e.m, 'out', a.out)
    when e.draw * (least(a.u.size - a.m, e.m) + least(a.m, e.u.size - e.m)) < least(a.m, e.u.size - e.m) then
      case when a.u.size - a.m <= e.m
        then named_struct('u', e.u, 'm', e.m - (a.u.size - a.m), 'out', concat(a.out, array(named_struct('u', a.u, 'x', 1))))
        else named_struct('u', a.u, 'm', a.m + e.m, 'out', concat(a.out, array(named_struct('u', e.u, 'x', 0)))) end
    else
      case when a.m <= e.u.size - e.m
        then named_struct('u', e.u, 'm', e.m + a.m, 'out', concat(a.out, array(named_struct('u', a.u, 'x', 0))))
        else named_struct('u', a.u, 'm', a.m - (e.u.size - e.m), 'out', concat(a.out, array(named_struct('u', e.u, 'x', 1)))) end
  end)
"""


def draw(*columns) -> F.Column:
    """A number from 0 to 1 that depends on the columns alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 53)) / F.lit(float(1 << 53))


def source_targets(sized: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """One row for each source: source, sid, n, source_size, target.

    Sources in code point order weigh as `weights` repeats.  Targets share all
    words by weight; one above `most` times its source's size stops there and
    the rest share what it leaves: with sources in order of the weight at which
    they stop, the level of the first that doesn't stop is the level of all.
    The windows run over one row for each source, which map-side sums have made.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    picked = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("sid", F.row_number().over(rank) - 1)
    ranked = ranked.withColumn("weight", F.element_at(picked, (F.col("sid") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level).withColumn("stop", F.col("cap") / F.col("weight"))
    ranked = ranked.withColumn("level", F.first(F.when(F.col("level") <= F.col("stop"), F.col("level")), ignorenulls=True).over(whole))
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return ranked.select("source", "sid", "n", "source_size", target.alias("target"))


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def mixture(docs: DataFrame, *, weights: tuple[float, ...] = (1, 2, 3), most: float = 3, fan: int = 64, seed: int = 1) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken, source, copies, nth.

    taken = copies * size.  nth numbers rows of equal doc_id, source and size from 1.
    """
    sized = materialise(sizes(docs), "sizes")
    sources = materialise(source_targets(sized, weights, most), "sources")
    units = sized.groupBy("doc_id", "source", "size").count()
    units = units.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count")))).drop("count")
    share = F.col("target") / F.col("source_size")
    planned = units.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    planned = planned.withColumn("base", F.coalesce(F.floor(share), F.lit(0)).cast("long")).withColumn("m", F.coalesce(share - F.floor(share), F.lit(0.0)) * F.col("size"))
    planned = materialise(planned, "planned")
    trading = planned.where("m > 0").select("sid", "n", F.expr("named_struct('doc_id', doc_id, 'copy', nth, 'size', size)").alias("u"), "m")
    largest = sources.agg(F.max("n")).first()[0] or 0
    decided, level, width = None, 0, fan
    while True:
        block = F.pmod(F.xxhash64("u", F.lit(seed), F.lit(level)), F.greatest(F.ceil(F.col("n") / width), F.lit(1)))
        members = F.struct(F.xxhash64("u", F.lit(seed + 1), F.lit(level)).alias("h"), "u", "m", draw("u", F.lit(seed + 2), F.lit(level)).alias("draw"))
        blocks = trading.groupBy("sid", "n", block.alias("block")).agg(F.array_sort(F.collect_list(members)).alias("units"))
        blocks = materialise(blocks.select("sid", "n", F.expr(_TRADE).alias("r")), f"level{level}")
        out = blocks.select("sid", F.inline("r.out"))
        decided = out if decided is None else decided.unionByName(out)
        trading = blocks.select("sid", "n", F.col("r.u").alias("u"), F.col("r.m").alias("m"))
        if width >= largest:
            break
        level, width = level + 1, width * fan
    last = trading.select("sid", "u", (draw("u", F.lit(seed + 3), F.lit(-1)) * F.col("u.size") < F.col("m")).cast("int").alias("x"))
    extra = decided.unionByName(last).select(F.col("sid").alias("of"), F.col("u.doc_id").alias("d"), F.col("u.copy").alias("c"), F.col("u.size").alias("w"), "x")
    same = F.col("sid").eqNullSafe(F.col("of")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("nth") == F.col("c")) & (F.col("size") == F.col("w"))
    copies = F.col("base") + F.coalesce("x", F.lit(0))
    return planned.join(extra, same, "left").select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), "source", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).alias("copies"), "nth")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as many times as the mixture takes it; all columns of docs."""
    names = docs.columns
    plan = materialise(mixture(docs, **options), "mixture")
    rows = docs.select(F.struct(*names).alias("_row"), F.col("text"), F.col("doc_id").cast("long").alias("_d"), F.col("source").cast("string").alias("_s"))
    rows = rows.select("_row", "_d", "_s", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_w"))
    if plan.where("nth > 1").isEmpty():
        rows = rows.withColumn("_n", F.lit(1).cast("long"))
    else:  # rows of one doc_id are told apart by their text's hash; equal ones are alike
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_d", "_s", "_w").orderBy(F.xxhash64("_row"))).cast("long"))
    same = F.col("_d").eqNullSafe(F.col("doc_id")) & F.col("_s").eqNullSafe(F.col("source")) & (F.col("_w") == F.col("size")) & (F.col("_n") == F.col("nth"))
    return rows.join(plan.where("copies > 0"), same).select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_c")).select("_row.*")
