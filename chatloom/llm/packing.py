"""Filling containers of fixed capacity with texts: vector best-fit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.tokens import TOKENIZER, with_tokens
from chatloom.session import cut_lineage

__all__ = ["best_fit", "pieces", "pack", "containers_used", "utilisation", "coverage"]

#: Documents a container may hold: one per so many tokens of its capacity.
TOKENS_PER_DOCUMENT = 16
#: Attention cost that a container may hold, as a share of the square of its tokens: what one text of 95 % of it costs.
COST_SHARE = 0.9
#: Kinds of containers, at most: their table is read to the driver.
MOST_KINDS = 1000
#: Items that are packed together; more make no better fit worth the time, fewer leave more half-filled containers.
SHARD_ITEMS = 8192


def best_fit(sizes: np.ndarray, capacity: int, max_documents: int, max_cost: float, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> np.ndarray:
    """The container number of each item, items taken from the largest to the smallest.

    A container has three capacities: tokens, documents, and attention cost (the sum of squared sizes). An item goes
    to the open container that can take it under all three and, by *rule*, has the least weighted norm of residuals
    afterwards (``norm``) or the greatest weighted dot product of residuals and demands (``dot``); ties go to the oldest.
    If none can, it opens one. An item alone may exceed the documents' or cost's capacity, never the tokens'.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    if len(sizes) and sizes.max() > capacity:
        raise ValueError("an item is larger than the capacity; cut it first")
    order = np.argsort(-sizes, kind="stable")
    smallest = int(sizes.min()) if len(sizes) else 0
    w = np.asarray(weights) / np.array([capacity, max_documents, max_cost], dtype=float) ** 2
    out = np.empty(len(sizes), dtype=np.int64)
    room = np.empty((len(sizes) + 1, 3))  # residuals of the open containers
    number = np.empty(len(sizes) + 1, dtype=np.int64)
    open_, made = 0, 0
    for i in order:
        s = float(sizes[i])
        need = np.array([s, 1.0, s * s])
        r = room[:open_]
        fits = np.flatnonzero((r[:, 0] >= s) & (r[:, 1] >= 1) & (r[:, 2] >= s * s))
        if len(fits):
            left = r[fits]
            k = fits[np.argmin(((left - need) ** 2) @ w)] if rule == "norm" else fits[np.argmax((left * need) @ w)]
        else:
            k = open_
            room[k] = (capacity, max_documents, max_cost)
            number[k] = made
            open_, made = open_ + 1, made + 1
        room[k] -= need
        out[i] = number[k]
        if room[k, 0] < max(smallest, 1) or room[k, 1] < 1:  # full: close it, keeping the others' order
            room[k : open_ - 1] = room[k + 1 : open_].copy()
            number[k : open_ - 1] = number[k + 1 : open_].copy()
            open_ -= 1
    return out


def pieces(sized: DataFrame, containers: DataFrame) -> DataFrame:
    """``container_kind, capacity, doc_id, piece, token_start, token_end``: each document for each kind of container.

    A document that fits stays whole; a longer one is cut, from its start, into pieces of the whole capacity and a
    rest. Kinds without a positive capacity take nothing. *containers* is a small table; one of more than
    ``MOST_KINDS`` rows is refused, as each document has rows for each kind anyway.
    """
    kinds = containers.where(F.col("capacity_tokens") > 0).select("container_kind", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct().limit(MOST_KINDS + 1).collect()
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    if not kinds:
        empty = F.array().cast("array<struct<container_kind:string,capacity:bigint>>")
    else:
        empty = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(int(c)).cast("bigint").alias("capacity")) for k, c in sorted(map(tuple, kinds), key=str)])
    d = sized.select("doc_id", "n_tokens", F.explode(empty).alias("k")).select("doc_id", "n_tokens", "k.*")
    last = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / F.col("capacity")) - 1).cast("int")
    d = d.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece") * F.col("capacity")
    return d.select("container_kind", "capacity", "doc_id", "piece", start.alias("token_start"), F.least(start + F.col("capacity"), F.col("n_tokens")).alias("token_end"))


def pack(documents: DataFrame, containers: DataFrame, tokenizer: str = TOKENIZER, rule: str = "norm", shard_items: int = SHARD_ITEMS, tokens_per_document: int = TOKENS_PER_DOCUMENT, cost_share: float = COST_SHARE) -> DataFrame:
    """``container_kind, container_id, doc_id, piece, token_start, token_end``: every text for each kind of container.

    Texts are measured once; only keys and sizes are shuffled. They are dealt by hash to shards of about *shard_items*
    pieces, whose number follows from the counts, and each shard is packed by :func:`best_fit` on its own: no task's
    work grows with the corpus, and each shard leaves about one container that isn't filled. Pieces that fill a
    container alone are given one without a shard.

    Defined cases: null and empty texts are items of size 0; repeated texts are items of their own; equal sizes are
    taken in the order of their keys, so the result is the same each time; no documents, no rows. ``doc_id`` must be
    unique and may be null once; other columns are ignored. A container holds at most *cost_share* of the
    square of its tokens as attention cost (the sum of the squares of its texts' sizes), so a text of nearly its size is
    left alone, and one document per *tokens_per_document* tokens; a text alone may exceed both.
    """
    kind = dict(documents.dtypes)["doc_id"]
    # Keys are text on their way through Python, where whole numbers beside nulls would become floating-point ones.
    sized = cut_lineage(with_tokens(documents, tokenizer).select(F.col("doc_id").cast("string").alias("doc_id"), "n_tokens"))
    p = pieces(sized, containers)
    whole = F.col("token_end") - F.col("token_start") == F.col("capacity")
    keys = ["container_kind", "doc_id", "piece", "token_start", "token_end"]
    full = p.where(whole).select(*keys, F.concat_ws("-", F.lit("d"), F.coalesce("doc_id", F.lit("")), F.col("piece").cast("string")).alias("container_id"))
    shards = max(1, -(-sized.count() // shard_items))
    rest = p.where(~whole).withColumn("shard", F.pmod(F.xxhash64("container_kind", "doc_id", "piece"), F.lit(shards)))

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["doc_id", "piece"], kind="stable")
        capacity = int(d["capacity"].iloc[0])
        most = max(1, capacity // tokens_per_document)
        bins = best_fit((d["token_end"] - d["token_start"]).to_numpy(), capacity, most, cost_share * float(capacity) ** 2, rule)
        ids = f"s{d['shard'].iloc[0]}-" + pd.Series(bins, index=d.index).astype(str)
        return d[keys].assign(container_id=ids)

    schema = "container_kind string, doc_id string, piece int, token_start bigint, token_end bigint, container_id string"
    packed = rest.groupBy("container_kind", "shard").applyInPandas(run, schema)
    return packed.unionByName(full).select("container_kind", "container_id", F.col("doc_id").cast(kind).alias("doc_id"), "piece", "token_start", "token_end")


def containers_used(packed: DataFrame) -> DataFrame:
    """``container_kind, container_id, n_pieces, n_tokens, attention_cost`` of each container."""
    n = F.col("token_end") - F.col("token_start")
    return packed.groupBy("container_kind", "container_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum(n).alias("n_tokens"), F.sum(n * n).alias("attention_cost"))


def utilisation(packed: DataFrame, containers: DataFrame, tokens_per_document: int = TOKENS_PER_DOCUMENT, cost_share: float = COST_SHARE) -> DataFrame:
    """``container_kind, n_containers, least_containers, filled, bound_by_documents, bound_by_cost``.

    How full, the bound that no packing beats, and how many containers are closed by their number of documents, or by
    attention cost: where a text that would fill the room left costs more than what is left of it.
    """
    c = containers.select("container_kind", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    u = containers_used(packed).join(F.broadcast(c.limit(MOST_KINDS)), "container_kind")  # a container for each kind was made of no more
    room = F.col("capacity") - F.col("n_tokens")
    documents = F.col("n_pieces") >= F.greatest(F.lit(1), F.floor(F.col("capacity") / tokens_per_document))
    cost = (room > 0) & (cost_share * F.col("capacity") * F.col("capacity") - F.col("attention_cost") < room * room)
    u = u.groupBy("container_kind", "capacity").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.count_if(documents & (room > 0)).alias("bound_by_documents"), F.count_if(cost).alias("bound_by_cost")
    )
    return u.select(
        "container_kind", "n_containers", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_containers"), (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("filled"),
        "bound_by_documents", "bound_by_cost",
    )


def coverage(packed: DataFrame) -> DataFrame:
    """``container_kind, doc_id, whole``: whether a document's pieces lie in containers once each, without gaps."""
    n = F.count(F.lit(1))
    return packed.groupBy("container_kind", "doc_id").agg(
        ((n == F.max("piece") + 1) & (F.count_distinct("piece") == n) & (F.sum(F.col("token_end") - F.col("token_start")) == F.max("token_end")) & (F.min("token_start") == 0)).alias("whole")
    )
