"""Mixing sources to target weights.

Method: weighted fair queueing. Every source puts its documents in a shuffled order (by hash), a further epoch of them
behind the last up to the source's cap on repeats. A document's virtual finish time is the tokens its source has sent
once it is through, divided by the source's target share; documents leave in order of finish times until the budget is
spent. Where no source runs dry, each has then sent its share to within a document.

The budget is a total of tokens. ``available`` gives that of the whole corpus, which ``p7_mix`` uses: a scarce source
then runs dry at its cap on repeats, the others send on in proportion to their shares, and the report shows by how much
the shares deviate and how much of the corpus is used. Without a budget, ``mix`` keeps every share to the letter: it ends
at the largest total at which all sources can still reach theirs, which the scarcest source decides.

Scale. Running sums are made in two levels: per (source, epoch, slice of the hash) a sum, whose running sums over
slices are a small table bounded by the parameters, and inside each slice a window. There are as many slices as keep about ``PER_SLICE`` documents in each, however large a source is. The cut
at the budget works the same way over slices of finish time, refined until no more than ``EDGE`` documents are left in the last one, or
all of these finish at the same time, which a range sort with running sums per range puts in order; so neither a source that holds a
third of all rows nor the cut itself gathers its rows in one task.

Defined results: null, empty and zero-token documents and sources without a target are left out; a source of the targets
without documents is reported with 0; repeated rows are separate documents only if their ids differ; ties of finish time go by
source, epoch and id; empty tables give an empty mix and a report of zeros; a target given twice counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import bounded_broadcast, cut

SLICES = 1024
#: Documents of one source and epoch in a slice, and documents at the edge of the budget that one task may order.
PER_SLICE, EDGE = 100_000, 100_000


def _running(df: DataFrame, groups: list[str], value: str, order: list[str]) -> DataFrame:
    """df with ``_before`` + own running sum of value in ``_cum``: groups[:-1] share the sum, groups[-1] is the slice."""
    sums = cut(df.groupBy(*groups).agg(F.sum(value).alias("_s")), "sums")
    w = Window.partitionBy(*groups[:1]).orderBy(*groups[1:]).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*groups, F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_before"))
    own = F.sum(value).over(Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_own", own).join(before, groups).withColumn("_cum", F.col("_before") + F.col("_own")).drop("_own", "_before")


def available(sizes: DataFrame, targets: DataFrame) -> int:
    """The tokens, each document once, of the sources that have a target: the whole of what can be mixed."""
    wanted = targets.where("target_share > 0 and max_repeats > 0").select("source").distinct()
    return int(sizes.where("tokens > 0").join(bounded_broadcast(wanted), "source", "left_semi").agg(F.sum("tokens")).first()[0] or 0)


def mix(sizes: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 17, slices: int = SLICES) -> DataFrame:
    """(doc_id, source, epoch, tokens, finish) of the chosen documents; sizes(doc_id, source, tokens)."""
    wanted = targets.where("target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").cast("int").alias("repeats"))
    docs = sizes.where("tokens > 0").select("doc_id", "source", "tokens").join(bounded_broadcast(wanted), "source")
    docs = cut(docs, "documents")
    have = docs.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.first("share").alias("share"), F.first("repeats").alias("repeats")).collect()
    if not have:
        return docs.select("doc_id", "source", F.lit(0).alias("epoch"), "tokens", F.lit(0.0).alias("finish"))
    shares = sum(r["share"] for r in have)
    level = min(r["t"] * r["repeats"] / r["share"] for r in have)
    if budget is None:
        budget = int(level * shares)
    # Every repeat a source is allowed gets its finish time; those beyond the budget are cut off below.
    parts = max(slices, -(-max(r["n"] for r in have) // PER_SLICE))
    epochs = docs.withColumn("epoch", F.explode(F.expr("sequence(0, repeats - 1)")))
    h = F.xxhash64("doc_id", "epoch", F.lit(seed))
    queued = epochs.withColumn("h", h).withColumn("slice", F.floor(F.shiftrightunsigned("h", 32) * F.lit(parts) / F.lit(2**32)).cast("long"))
    sent = _running(queued, ["source", "epoch", "slice"], "tokens", ["h", "doc_id"])
    timed = cut(sent.select("doc_id", "source", "epoch", "tokens", (F.col("_cum") / F.col("share")).alias("finish")), "finish")
    last = timed.agg(F.max("finish")).first()[0]
    low, high, spent = 0.0, last * (1 + 1e-9) + 1e-9, 0
    while True:  # narrow the cut to one slice of the slice before, until what is left in it is few or all at one time
        width = (high - low) / slices
        within = timed.where((F.col("finish") >= low) & (F.col("finish") < high))
        bins = within.groupBy(F.floor((F.col("finish") - low) / width).alias("bin")).agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
        rows = sorted((r["bin"], r["t"], r["n"]) for r in bins.collect())  # about ``slices`` rows
        at = None
        for b, t, n in rows:
            if spent + t > budget:
                at = b
                break
            spent += t
        if at is None:
            return timed.where(F.col("finish") < high)
        low, high = low + at * width, low + (at + 1) * width
        if n <= EDGE or not low < low + (high - low) / slices < high:
            break
    edge = timed.where((F.col("finish") >= low) & (F.col("finish") < high))
    return timed.where(F.col("finish") < low).unionByName(_first(edge, budget - spent))


def _first(edge: DataFrame, budget: int) -> DataFrame:
    """The first of edge by finish time and tie, as many as the budget takes: ranges in order, running sums per range."""
    order = ("finish", "source", "epoch", "doc_id")
    ranged = cut(edge.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "edge")
    return _running(ranged.withColumn("_all", F.lit(0)), ["_all", "_range"], "tokens", list(order)).where(F.col("_cum") <= budget).select(*edge.columns)


def report(mixed: DataFrame, targets: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(source, target_share, actual_share, documents, most_repeats, max_repeats, tokens) for every source of the targets.

    With the sizes of the whole corpus also (available, used_share, corpus_used): the tokens the source has, the share of
    them that is in the mix at least once, and the same share for the corpus with all its sources, also those without a target."""
    out = _report(mixed, targets)
    if sizes is None:
        return out
    once = mixed.where("epoch = 0").groupBy("source").agg(F.sum("tokens").alias("_once"))
    have = sizes.where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("_have"))
    total = have.agg(F.sum("_have").alias("_total")).crossJoin(once.agg(F.sum("_once").alias("_used")))
    share = lambda part, whole: F.round(F.when(F.col(whole) > 0, F.coalesce(part, F.lit(0)) / F.col(whole)).otherwise(0.0), 6)
    every = out.join(have, "source", "left").join(once, "source", "left").crossJoin(F.broadcast(total))
    return every.select(*out.columns, F.coalesce("_have", F.lit(0)).cast("long").alias("available"), share("_once", "_have").alias("used_share"), share("_used", "_total").alias("corpus_used"))


def _report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    per_doc = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    got = per_doc.groupBy("source").agg(F.count("*").alias("documents"), F.max("n").alias("most"), F.sum("tokens").alias("tokens"))
    wanted = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = wanted.join(got, "source", "left").select("source", "target_share", "max_repeats", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("documents", "most", "tokens")))
    # One row per source of the targets: a parameter table.
    every = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    return both.withColumn("_all", every).select(
        "source", "target_share", F.round(F.when(F.col("_all") > 0, F.col("tokens") / F.col("_all")).otherwise(0.0), 6).alias("actual_share"), "documents", F.col("most").alias("most_repeats"), "max_repeats", "tokens"
    )
