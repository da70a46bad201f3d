"""Runs of identical or near-identical consecutive messages: optimal segmentation by pruned dynamic programming.

The dissimilarity of a run is how far its messages are from the form that fits all of them best: the least radius over
the forms of words in its block, where two forms are apart by the share of their words that are written differently,
and infinitely where a word is another one. A segmentation costs ``near_cost`` times the dissimilarity of each run and
``penalty`` per run. The cheapest is found by dynamic programming over the last boundary; as a run's dissimilarity only
grows with its messages, starts are dropped for good once it is infinite or once a later start can't be beaten.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

__all__ = ["words_of", "same_words", "dissimilarity", "segment", "collapse_runs"]

BUCKET = 4096


def _bases() -> tuple[str, str]:
    """Letters with marks and their base letters (Latin and Cyrillic), from Unicode's decompositions."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x400, 0x460), *range(0x1E00, 0x1F00)]:
        c = chr(code).lower()
        base = unicodedata.normalize("NFD", c)[0]
        if len(c) == 1 and base != c and base.isalpha():
            pairs.append((c, base))
    pairs = sorted(set(pairs))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def words_of(content: Column) -> Column:
    """The words of a text in lower case, without marks, joined by blanks; of a text without words, the text itself.

    Null counts as empty. Apostrophes inside words, marks (composed or not) and invisible characters vanish; all
    other characters that are no letter or digit separate.
    """
    marked, base = _bases()
    text = F.coalesce(content, F.lit(""))
    low = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    low = F.regexp_replace(F.translate(low, marked, base), r"[\p{M}\p{Cf}'’ʼ`´]+", "")
    words = F.regexp_replace(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "), r"^ | $", "")
    bare = F.regexp_replace(text, r"[\s\p{Z}\p{C}]+", " ")
    return F.when(words != "", words).otherwise(F.concat(F.lit("\u0001"), F.trim(bare)))


def _squeeze(words: Column) -> Column:
    """Letters said once where they are repeated; numbers stay."""
    return F.regexp_replace(words, r"(\p{L})\1+", "$1")


def _same_word(x: Column, y: Column) -> Column:
    longer = F.greatest(F.length(x), F.length(y))
    step = F.abs(F.length(x) - F.length(y))
    slip = (longer >= 3) & (
        ((step == 1) & (F.levenshtein(x, y) == 1))
        | ((step == 0) & (F.levenshtein(x, y) == 2) & (F.array_sort(F.split(x, "")) == F.array_sort(F.split(y, ""))))
    )
    a, b = _squeeze(x), _squeeze(y)
    slip_squeezed = (F.abs(F.length(a) - F.length(b)) == 1) & (F.levenshtein(a, b) == 1) & (longer >= 4)
    return (x == y) | (~F.concat(x, y).rlike(r"\p{N}") & ((a == b) | slip | slip_squeezed))


def same_words(a: Column, b: Column) -> Column:
    """Whether two results of :func:`words_of` are the same words, differing only in how they are written.

    As many words, and each pair equal, equal but for repeated letters, or one missing, doubled or swapped letter
    apart. Words with digits must be equal.
    """
    blanks = lambda s: F.length(s) - F.length(F.translate(s, " ", ""))
    digits = lambda s: F.regexp_replace(s, r"[^\p{N} ]+", "")
    pairs = F.zip_with(F.split(a, " "), F.split(b, " "), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    # Cheap tests first: the pairwise one runs on what they leave, up to the first pair that differs. Lengths of texts
    # bound nothing, as a lost or swapped letter lets repeated ones merge.
    return F.when(a == b, True).when((blanks(a) != blanks(b)) | (digits(a) != digits(b)) | a.startswith("\u0001") | b.startswith("\u0001"), False).otherwise(F.forall(pairs, lambda p: _same_word(p["x"], p["y"])))


_TWICE = re.compile(r"([^\W\d_])\1+")
_DIGIT = re.compile(r"\d")


def _one_apart(x: str, y: str) -> bool:
    """One letter missing or doubled."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) != 1:
        return False
    i = 0
    while i < len(x) and x[i] == y[i]:
        i += 1
    return x[i:] == y[i + 1 :]


def _word_apart(x: str, y: str) -> bool:
    """:func:`_same_word` of two different words, outside the JVM."""
    if _DIGIT.search(x) or _DIGIT.search(y):
        return False
    longer = max(len(x), len(y))
    if longer >= 3:
        if _one_apart(x, y):
            return True
        if len(x) == len(y) and sorted(x) == sorted(y):
            off = [i for i in range(len(x)) if x[i] != y[i]]
            if len(off) == 2 or _shifted(x, y, off):
                return True
    a, b = _TWICE.sub(r"\1", x), _TWICE.sub(r"\1", y)
    return a == b or (longer >= 4 and _one_apart(a, b))


def _shifted(x: str, y: str, off: list[int]) -> bool:
    """Two words of the same letters, one of which stands elsewhere: an edit distance of two."""
    s, e = off[0], off[-1] + 1
    return x[s + 1 : e] == y[s : e - 1] or x[s : e - 1] == y[s + 1 : e]


def dissimilarity(a: str, b: str) -> float:
    """Share of the words of two forms that are written differently; infinite if one is another word."""
    if a == b:
        return 0.0
    x, y = a.split(" "), b.split(" ")
    if len(x) != len(y) or a[:1] == "\u0001" or b[:1] == "\u0001":
        return float("inf")
    n = 0
    for u, v in zip(x, y):
        if u != v:
            if not _word_apart(u, v):
                return float("inf")
            n += 1
    return n / len(x)


def _distances(forms: list[str]) -> np.ndarray:
    """Between all forms of a block. Many forms are compared by their letters first: a word that is written differently
    adds or takes at most two letters once repeated ones are said once."""
    k = len(forms)
    d = np.full((k, k), np.inf)
    np.fill_diagonal(d, 0.0)
    near = np.ones((k, k), dtype=bool)
    if k > 16:
        letters = sorted(set("".join(forms)))
        at = {c: i for i, c in enumerate(letters)}
        has = np.zeros((k, len(letters)), dtype=np.float32)
        for i, f in enumerate(forms):
            has[i, [at[c] for c in set(f)]] = 1.0
        only = has.sum(1)
        near = only[:, None] + only[None, :] - 2 * has @ has.T <= 2 * (forms[0].count(" ") + 1)
    for i in range(k):
        for j in np.flatnonzero(near[i, i + 1 :]) + i + 1:
            d[i, j] = d[j, i] = dissimilarity(forms[i], forms[j])
    return d


def segment(items: list[str], near_cost: float = 0.5, penalty: float = 1.0) -> list[tuple[int, str]]:
    """(start, best form) of the runs of the cheapest segmentation of a block's forms; of equals the one with longer
    first runs.

    ``best[t]`` is the least cost of the first t items. Equal neighbours are one item, as nothing parts them.
    """
    starts = [i for i in range(len(items)) if i == 0 or items[i] != items[i - 1]]
    forms = list(dict.fromkeys(items))
    at = {f: i for i, f in enumerate(forms)}
    x = [at[items[i]] for i in starts]
    d = _distances(forms)
    n = len(x)
    best, back, form = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    alive: dict[int, np.ndarray] = {}  # start -> the farthest of its items from each form
    for t in range(1, n + 1):
        alive = {s: np.maximum(r, d[x[t - 1]]) for s, r in alive.items()}
        alive[t - 1] = d[x[t - 1]]
        cost = {s: near_cost * float(r.min()) for s, r in alive.items()}
        start = min(alive, key=lambda s: (best[s] + cost[s] + penalty, s))
        best[t], back[t], form[t] = best[start] + cost[start] + penalty, start, int(alive[start].argmin())
        # Infinite for good; or, as cost(s..T) >= cost(s..t) and >= cost(t..T), a start at t is as good whatever comes.
        alive = {s: r for s, r in alive.items() if cost[s] < float("inf") and best[s] + cost[s] - near_cost <= best[t]}
    out, t = [], n
    while t > 0:
        out.append((starts[back[t]], forms[form[t]]))
        t = back[t]
    return out[::-1]


def _segments(near_cost: float, penalty: float):
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([None if x is None else [{"start": i, "form": f} for i, f in segment(list(x), near_cost, penalty)] for x in s], dtype=object)

    return run


def collapse_runs(messages: DataFrame, near_cost: float = 0.5, penalty: float = 1.0, bucket: int = BUCKET, exact: bool = False) -> DataFrame:
    """``chat_id, sender, first_seq, last_seq, content, n_events, start, end, duration_us``: one row per run.

    Neighbours are messages next to each other in ``seq`` within a chat, each ``seq`` counted once (the least
    edited copy, of these the first delivered) and missing numbers ignored; ``content`` is the first one's. A message that repeats nothing is a run of one.
    With *exact* contents are their own forms, so that only equal ones run. With a *penalty* above *near_cost* messages of the same words are never parted; below, runs whose forms differ much
    are.

    Chats are cut into buckets of *bucket* sequence numbers (places in the chat), so the largest chat is spread over
    many tasks. In a bucket, blocks of one sender with as many words and the same numbers are segmented by
    :func:`segment` where their forms differ; blocks of one form are a run. Only the first and last run of each bucket
    meet again per chat, to be joined across the border if their best forms are the same words: two rows per bucket.

    Defined cases: null ``chat_id`` or ``seq`` is left out; a null sender equals none, a blank one only itself; null
    and empty contents are equal; contents without words are equal if they are so up to white space; times may be null (then
    start, end and duration are over the others, or null); other columns are ignored.
    """
    m = messages.where(F.col("chat_id").isNotNull() & F.col("seq").isNotNull()).select(
        "chat_id", "seq", "sender", "content", F.unix_micros("timestamp").alias("us"), "edited", "batch_no", "row_id", F.floor(F.col("seq") / bucket).alias("__b")
    )
    form = F.concat(F.lit("\u0001"), F.coalesce("content", F.lit(""))) if exact else words_of(F.col("content"))
    m = m.withColumn("__w", form).repartition("chat_id", "__b")
    copy = W.partitionBy("chat_id", "__b", "seq").orderBy(F.col("edited").asc_nulls_first(), "batch_no", "row_id")
    m = m.withColumn("__copy", F.row_number().over(copy)).where("__copy = 1").drop("__copy", "edited", "batch_no", "row_id")
    # What parts messages whatever their forms: the sender, the number of words, the numbers among them.
    blanks = F.length("__w") - F.length(F.translate("__w", " ", ""))
    numbers = F.when(F.col("__w").rlike(r"\p{N}"), F.regexp_replace("__w", r"[^\p{N} ]+", "")).otherwise("")
    m = m.withColumn("__sig", F.when(F.col("__w").startswith("\u0001"), F.col("__w")).otherwise(F.concat_ws("|", blanks.cast("string"), numbers)))
    w = W.partitionBy("chat_id", "__b").orderBy("seq")
    m = m.withColumns({"__s0": F.lag("sender").over(w), "__g0": F.lag("__sig").over(w), "__next": F.lead("seq").over(w), "__prev": F.lag("seq").over(w)})
    m = m.withColumn("__cut", F.when((F.col("sender") == F.col("__s0")) & (F.col("__sig") == F.col("__g0")), 0).otherwise(1))
    m = m.withColumn("__block", F.sum("__cut").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    blocks = m.groupBy("chat_id", "__b", "__block").agg(
        F.array_sort(F.collect_list(F.struct("seq", "__w", "us"))).alias("__i"),
        F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("__c"),
        F.max("sender").alias("sender"),
        F.bool_or(F.col("__prev").isNull()).alias("__head"),
        F.bool_or(F.col("__next").isNull()).alias("__tail"),
    )
    forms = F.transform("__i", lambda x: x["__w"])
    one = F.array(F.struct(F.lit(0).alias("start"), forms[0].alias("form")))
    cut = F.pandas_udf(_segments(near_cost, penalty), "array<struct<start:int,form:string>>")
    blocks = blocks.withColumn("__s", cut(F.when((F.size("__i") > 1) & (F.size(F.array_distinct(forms)) > 1), forms)))
    blocks = blocks.withColumn("__s", F.coalesce("__s", one))
    runs = blocks.select("*", F.posexplode("__s").alias("__k", "__x")).withColumn("__upto", F.coalesce(F.try_element_at("__s", F.col("__k") + 2)["start"], F.size("__i")))
    own = F.slice("__i", F.col("__x.start") + 1, F.col("__upto") - F.col("__x.start"))
    first, last = F.col("__head") & (F.col("__x.start") == 0), F.col("__tail") & (F.col("__upto") == F.size("__i"))
    runs = runs.select(
        "chat_id", "sender", F.col("__x.form").alias("__form"), (first | last).alias("__edge"), first.alias("__first"), own.alias("__i"),
        F.element_at("__c", F.col("__x.start") + 1)["content"].alias("content"),
    ).select(
        "chat_id", "sender", "__form", "__edge", "__first", "content", F.col("__i")[0]["seq"].alias("first_seq"), F.element_at("__i", -1)["seq"].alias("last_seq"),
        F.size("__i").cast("bigint").alias("n_events"), F.array_min(F.transform("__i", lambda x: x["us"])).alias("start"), F.array_max(F.transform("__i", lambda x: x["us"])).alias("end"),
    )
    # Runs inside a bucket stay where they are (a group each); those at borders meet in one group per chat.
    runs = runs.withColumn("__g", F.when(~F.col("__edge"), F.col("first_seq")))
    c = W.partitionBy("chat_id", "__g").orderBy("first_seq")
    joins = F.col("__first") & (F.col("sender") == F.lag("sender").over(c)) & same_words(F.col("__form"), F.lag("__form").over(c))
    runs = runs.withColumn("__join", F.when(joins & (F.lit(penalty) >= near_cost), 0).otherwise(1))
    runs = runs.withColumn("__n", F.sum("__join").over(c.rowsBetween(W.unboundedPreceding, W.currentRow)))
    out = runs.groupBy("chat_id", "__g", "__n").agg(
        F.min_by("sender", "first_seq").alias("sender"),
        F.min_by("content", "first_seq").alias("content"),
        F.min("first_seq").alias("first_seq"),
        F.max("last_seq").alias("last_seq"),
        F.sum("n_events").alias("n_events"),
        F.min("start").alias("start_us"),
        F.max("end").alias("end_us"),
    )
    return out.select(
        "chat_id", "sender", "first_seq", "last_seq", "content", "n_events",
        F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("end_us").alias("end"), (F.col("end_us") - F.col("start_us")).alias("duration_us"),
    )
