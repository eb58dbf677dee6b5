"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations alone.

Every document of a source, in a shuffled order that is the same on each run, gets a virtual finish
time: the source's tokens so far, this document included, divided by the source's target.  A second
and third round over a source go on counting.  All (document, round) rows in the order of their
finish times, cut where the total budget is used up, are the mix; each source then holds its target
to within one document.

The cut is found without one long window: sums over steps of finish times, then over finer steps of
the step in which the budget ends, until that one holds few rows.  The documents of the mix are
range-sorted over the cluster by finish time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.llm.workspace import Workspace

#: A source is repeated at most so often, and its weight is this sequence's entry by its rank.
MOST_ROUNDS = 3
WEIGHTS = (1, 2, 3)
#: Leading hex digits of the shuffle key that split a source's running sum into slices.
SLICE_DIGITS = 3
#: A unit of finish time is cut into so many steps, each of them again, LEVELS times at most, until the
#: step in which the budget ends holds at most so many rows.
STEPS = 4096
LEVELS = 4
EDGE_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) -> also weight and target; one row per source.

    The budget, all sources' sizes, is shared by weight; a target stops at MOST_ROUNDS times its
    source's size and the excess goes to the others by weight until none is above: targets are
    least(cap, level * weight), with the level found on the sources in the order of cap / weight.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(MOST_ROUNDS))
    by_ratio = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank"))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = capped.withColumn("own_level", level).withColumn("fits", F.col("own_level") * F.col("weight") <= F.col("cap"))
    # The first source, in that order, that the level of those from it on does not overfill.
    ordered = leveled.withColumn("ratio", F.col("cap") / F.col("weight"))
    first = F.min(F.when(F.col("fits"), F.struct("ratio", "rank", "own_level"))).over(everything)
    return ordered.withColumn("level", first["own_level"]).select(
        "source", "source_size", "weight", F.sum("source_size").over(everything).alias("budget"), F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.lit(0.0)).alias("target")
    )


def _placed(docs: DataFrame, key: str, text: str, source: str, seed: str) -> DataFrame:
    # Rows without a key are shuffled by their texts.
    named = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null/"), F.xxhash64(F.col(text)).cast("string")))
    slim = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.md5(F.concat_ws("/", F.lit(seed), named).cast("binary")).alias("dice"))
    slim = slim.withColumn("slice", F.substring("dice", 1, SLICE_DIGITS))
    slices = slim.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    targets = source_targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")))
    before = F.sum("slice_size").over(W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    starts = slices.select("source", "slice", F.coalesce(before, F.lit(0)).alias("begins"))
    starts = starts.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "slice", "begins", "source_size", "target", "budget")
    own = W.partitionBy("source", "slice").orderBy("dice", "key", "size")
    same = W.partitionBy("source", "slice", "dice", "key", "size").orderBy(F.lit(0))
    running = slim.withColumn("running", F.sum("size").over(own.rowsBetween(W.unboundedPreceding, 0))).withColumn("copy", F.row_number().over(same))
    both = running.alias("a").join(starts.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.slice") == F.col("b.slice")))
    return both.select("key", "a.source", "size", "copy", "dice", (F.col("begins") + F.col("running")).alias("tokens"), "source_size", "target", "budget")


def _due(round_: Column | int) -> Column:
    """The virtual finish time of a document's copy in a round."""
    return (F.col("tokens") + F.lit(round_) * F.col("source_size")) / F.col("target")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """One slim row per document: key, source, size, copy, source_size, target, rounds, due and lap.

    ``rounds`` is how often the mix takes the document, 0 to MOST_ROUNDS; ``copy`` tells apart rows
    alike in key, source and size; ``due`` is the virtual finish time in the first round, ``lap`` what
    each further round adds.  Null texts have size 0 and are never taken; a null source is a source
    of its own, last in order; null keys are shuffled like any other; columns beyond the three named
    do not matter, whatever their names; an empty table gives an empty one.
    """
    work = Workspace(docs.sparkSession, "mix")
    placed = work.save(_placed(docs, key, text, source, seed), "placed")
    taking = (F.col("size") > 0) & (F.col("target") > 0)
    rounds = placed.filter(taking).withColumn("round", F.explode(F.array(*[F.lit(r) for r in range(MOST_ROUNDS)]))).withColumn("due", _due(F.col("round")))

    def step(level: int, due: Column) -> Column:
        return F.floor(due * float(STEPS**level))

    def ending(rows: DataFrame, level: int, used: int) -> list:
        sums = rows.groupBy(step(level, F.col("due")).alias("step")).agg(F.sum("size").alias("own"), F.count("*").alias("rows"), F.max("budget").alias("budget"))
        sums = sums.withColumn("used", F.sum("own").over(W.orderBy("step").rowsBetween(W.unboundedPreceding, 0)) - F.col("own") + used)
        return sums.filter(F.col("used") + F.col("own") > F.col("budget")).orderBy("step").limit(1).collect()

    # The budget nearly always ends by the time that sources meet their targets; where one document dominates, in a later round.
    level = 1
    found = ending(rounds.filter(F.col("due") <= 1.5), level, 0) or ending(rounds, level, 0)
    while found and found[0]["rows"] > EDGE_ROWS and level < LEVELS:
        inside = rounds.filter(step(level, F.col("due")) == found[0]["step"])
        level += 1
        found = ending(inside, level, found[0]["used"])
    # Without a cut all rounds fit the budget.  Else all rows of the steps before the cut fit; those of the step at the cut are summed in order.
    cut, used = (found[0]["step"], found[0]["used"]) if found else (None, 0)
    edge = rounds.filter(step(level, F.col("due")) == F.lit(cut).cast("long"))
    in_order = W.partitionBy(F.lit(0)).orderBy("due", F.col("source").asc_nulls_last(), "dice", "key", "size", "copy").rowsBetween(W.unboundedPreceding, 0)
    edge = edge.withColumn("sum", F.sum("size").over(in_order) + used).filter(F.col("sum") <= F.col("budget"))
    edge = edge.groupBy("key", "source", "size", "copy").agg(F.count("*").alias("more"))
    sure = F.lit(MOST_ROUNDS).cast("long") if cut is None else sum((step(level, _due(r)) < cut).cast("long") for r in range(MOST_ROUNDS))
    whole = placed.withColumn("sure", F.when(taking, sure).otherwise(0))
    keys = ("key", "source", "size", "copy")
    both = whole.alias("a").join(edge.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left")
    lap = F.try_divide(F.col("source_size"), F.col("target"))
    due = F.try_divide(F.col("tokens"), F.col("target"))
    return both.select(*[F.col(f"a.{k}").alias(k) for k in keys], "source_size", "target", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("rounds"), due.alias("due"), lap.alias("lap"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", ordered: bool = True) -> DataFrame:
    """The documents of the mix, with docs' own columns; one taken n times stands in n rows.

    ``ordered``: range-sorted over the cluster by finish time, which deals out the texts once more.
    """
    rounds = mix(docs, key, text, source, seed).filter("rounds > 0")
    sized = docs.withColumn("__size", word_count(F.col(text)))
    same = W.partitionBy(key, source, "__size").orderBy(F.xxhash64(text))
    sized = sized.withColumn("__copy", F.row_number().over(same))
    on = [F.col(f"a.{a}").eqNullSafe(F.col(f"b.{b}")) for a, b in ((key, "key"), (source, "source"), ("__size", "size"), ("__copy", "copy"))]
    both = sized.alias("a").join(rounds.alias("b"), on).withColumn("__round", F.explode(F.sequence(F.lit(1), F.col("b.rounds"))))
    both = both.orderBy(F.col("b.due") + (F.col("__round") - 1) * F.col("b.lap"), F.col("b.key"), F.col("b.copy"), "__round") if ordered else both
    return both.select(*[F.col(f"a.{c}") for c in docs.columns])
