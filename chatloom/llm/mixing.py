"""One mixture of sources with target shares: capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatloom.llm.tokens import TOKENIZER, with_tokens
from chatloom.session import cut_lineage

__all__ = ["source_name", "water_fill", "mix", "shares", "limits"]

BUCKETS = 65_536
#: Sources with a target, at most: their weights and sizes are read to the driver.
MOST_SOURCES = 10_000


def source_name(source: Column) -> Column:
    """Sources are compared trimmed and in lower case."""
    return F.lower(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def water_fill(sizes: dict[str, int], weights: dict[str, float], most: dict[str, int], total: float) -> dict[str, float]:
    """Tokens that each source gives to a mixture of *total* tokens.

    Every source gets its weight's share. Those that can't give it with their permitted repetitions are clamped at
    what they can, and the weight in excess is spread over the others in proportion to theirs, until all is feasible.
    If every source is clamped the mixture stays smaller. Sources without weight or tokens give nothing.
    """
    cap = {s: sizes.get(s, 0) * max(0, most.get(s, 0)) for s in weights}
    free = {s for s, w in weights.items() if w > 0 and cap[s] > 0}
    got = dict.fromkeys(weights, 0.0)
    rest = float(total)
    while free and rest > 0:
        level = rest / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level >= cap[s]}
        if not over:
            for s in free:
                got[s] = weights[s] * level
            break
        for s in over:
            got[s] = float(cap[s])
            rest -= cap[s]
        free -= over
    return got


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, n_tokens, copies``: the documents of the mixture, each with how often it is used.

    *targets* (``source, weight, max_repeats``) is a small table, refused beyond ``MOST_SOURCES`` rows; the tokens of each source in it are summed up over all
    documents. The mixture has *total_tokens*, by default as many as its sources have. A source that gives k times its
    tokens and a fraction has every document k times, and of a seeded random order of its documents those
    once more that come first, until the fraction is reached (to within one document, the last one's excess
    being no more than half of it). The order's cut is found by a histogram of hash buckets, so no task orders a source.

    Defined cases: source names are compared trimmed and in lower case; documents of other or null sources, and those
    of no tokens, are left out; targets without documents give their weight to the others; repeated targets
    count with their sums of weights and the least repeats; null weights are 0; without documents or targets no rows.
    """
    t = targets.where(F.col("source").isNotNull()).groupBy(source_name(F.col("source")).alias("s")).agg(F.sum("weight").alias("w"), F.min("max_repeats").alias("m")).limit(MOST_SOURCES + 1).collect()
    if len(t) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    weights = {r.s: float(r.w or 0.0) for r in t}
    most = {r.s: int(r.m or 0) for r in t}
    d = with_tokens(documents, tokenizer).select("doc_id", source_name(F.col("source")).alias("source"), "n_tokens")
    # The test of the tokens follows the write; before it, it would make Spark count them twice.
    d = cut_lineage(d.where(F.col("source").isin(sorted(weights)))).where(F.col("n_tokens") > 0)
    d = d.withColumn("__h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("__b", F.pmod(F.col("__h"), F.lit(BUCKETS)))
    sizes = {r.source: r.n for r in d.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    got = water_fill(sizes, weights, most, total_tokens if total_tokens is not None else sum(sizes.values()))

    def per_source(values: dict[str, float], kind: str) -> Column:
        pairs = [F.lit(x) for s, v in sorted(values.items()) for x in (s, v)]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("source")), F.lit(0)).cast(kind) if pairs else F.lit(0).cast(kind)

    whole = {s: int(got[s] // sizes[s]) for s in sizes}
    part = {s: int(round(got[s] - whole[s] * sizes[s])) if whole[s] < most[s] else 0 for s in sizes}
    need = per_source(part, "bigint")
    w = W.partitionBy("source").orderBy("__b").rowsBetween(W.unboundedPreceding, W.currentRow)
    hist = d.groupBy("source", "__b").agg(F.sum("n_tokens").alias("__in")).withColumn("__upto", F.sum("__in").over(w))
    hist = hist.withColumn("__before", F.col("__upto") - F.col("__in")).select("source", "__b", "__before", "__upto")
    d = d.join(hist, ["source", "__b"])
    sure, edge = F.col("__upto") <= need, (F.col("__before") < need) & (F.col("__upto") > need)
    # Documents of the bucket where the fraction is reached are counted one by one; the others' rank isn't needed.
    v = W.partitionBy("source", "__b", edge).orderBy("__h", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    half = F.col("__before") + F.sum("n_tokens").over(v) - F.col("n_tokens") / 2
    once_more = F.when(sure, 1).when(edge & (half <= need), 1).otherwise(0)
    copies = (per_source(whole, "int") + once_more).cast("int")
    return d.withColumn("copies", copies).where(F.col("copies") > 0).select("doc_id", "source", "n_tokens", "copies")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, tokens, documents, most_copies`` of every target, absent ones included."""
    t = targets.where(F.col("source").isNotNull()).groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("weight").alias("target_share"))
    m = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    d = t.join(m, "source", "left").fillna(0, ["tokens", "documents", "most_copies"])
    all_ = F.sum("tokens").over(W.partitionBy())  # one row per target
    return d.select("source", "target_share", F.coalesce(F.try_divide("tokens", all_), F.lit(0.0)).alias("actual_share"), "tokens", "documents", "most_copies")


def limits(mixture: DataFrame, documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, available, over, unknown`` of every target: its documents with a text, those of the mixture that are
    used more often than is allowed, and those that aren't the source's (both should be none)."""
    t = targets.where(F.col("source").isNotNull()).groupBy(source_name(F.col("source")).alias("source")).agg(F.min("max_repeats").alias("most"))
    d = documents.where(F.coalesce(F.length("text"), F.lit(0)) > 0).select("doc_id", source_name(F.col("source")).alias("source"))
    m = mixture.select("doc_id", F.col("source").alias("mixed"), "copies")
    d = d.join(m, "doc_id", "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("available"), F.max("copies").alias("copies"), F.count_if(F.col("mixed") != F.col("source")).alias("unknown")
    )
    d = t.join(d, "source", "left")
    return d.select("source", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce(F.col("copies") > F.col("most"), F.lit(False)).alias("over"), F.coalesce("unknown", F.lit(0)).alias("unknown"))
