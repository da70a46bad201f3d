"""Text statistics of documents and the text type they point to.

Statistics come from regular expressions inside the JVM, over whole texts. Each statistic is cut by thresholds, and each
of its ranges is a noisy labelling function: it speaks for one type. Thresholds and what they speak for come from a
bounded sample of labelled documents; how far each can be trusted is learnt by expectation-maximisation from the
agreements of all of them over all documents, and the posterior of the types is an expression of a row's ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.session import cut_lineage

__all__ = ["STATISTICS", "text_statistics", "Thresholds", "find_thresholds", "with_ranges", "fit_accuracies", "text_types", "classify"]

KINDS = ["prose", "list", "table", "junk"]
#: The statistics that are cut by thresholds, each on its own.
STATISTICS = [
    "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "letter_share", "distinct_tokens", "distinct_share", "tokens_per_line",
    "bullet_share", "short_share", "leader_share", "listed_share", "row_share", "field_share", "tabular_share", "separator_rate", "long_share",
    "solid_share", "consonant_share", "hex_share", "garbled_share",
]
#: Labelled documents that thresholds are found on, at most; those of the smallest hashes are taken.
MOST_LABELS = 2000
#: Words of the table of common words, at most: the condition on them goes into the plan.
MOST_WORDS = 20_000
#: What a labelling function is believed at first to be right in, and the weight of all labelled documents together in
#: the learning, as a share of all documents.
BELIEF, LABELLED_WEIGHT = 0.8, 0.1

_GAP = r"[^\p{L}\p{M}\p{N}'’]+"
# Line shapes. A "short item" has at most seven words. Groups repeat a bounded number of times only: Java matches
# repeated groups by recursion, and a line may have millions of words.
_ITEM = r"(?:[^\s]+[ \t]+){0,6}[^\s]+"
_BULLET = rf"(?m)^[ \t]*(?:[-*•·–—▪◦+]|\[[ xX✓]?\]|\(?\d{{1,4}}[.)]|\(?\p{{L}}[.)])[ \t]+{_ITEM}[ \t]*$"
_SHORT = r"(?m)^[ \t]*\p{L}(?:[^\s:|;\t]+[ \t]){0,5}[^\s:|;\t]*[^\s:.!?…|;\t][ \t]*$"
_LEADER = r"(?m)^[^\n.]{1,90}[ .]\.{4,}[ .]*\d+[ \t]*$"
_CELLS = r"[^\s]+(?: [^\s]+){0,5}"
_ROW = (
    r"(?m)^(?:[^\t\n]{0,200}\t[^\t\n]{0,200}\t[^\n]*|[ \t]*\|[^\n]*\|[ \t]*|[^|\n]{1,60}\|[^|\n]{0,60}\|[^\n]*"
    r"|[^,\s][^,.\n]{0,40},(?! )[^,\n]{0,40},(?! )[^\n]*|[^;\n]{1,40};(?! )[^;\n]{0,40};(?! )[^\n]*"
    rf"|[ ]*{_CELLS} {{2,}}{_CELLS} {{2,}}[^\s][^\n]*)$"
)
_FIELD = r"(?m)^[ \t]*[\p{L}_][\p{L}\p{N}_-]{0,24}(?: [\p{L}\p{N}_-]{1,20})?[ \t]*[:=][ \t]*(?:(?:[^\s]+[ \t]+){0,5}[^\s]+)?[ \t]*$"
_LONG = r"(?m)^(?:[^\s]+[ \t]+){7}[^\s][^\n]*$"


def _share(text: Column, pattern: str, whole: Column) -> Column:
    """Share of the characters that stand in matches."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / whole


def text_statistics(documents: DataFrame, common: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """One row per document: its key, the published statistics, and the shares that the votes use.

    ``word_count``, ``mean_word_length``, ``symbol_ratio`` (characters that are no letter, digit or white space),
    ``punctuated_lines`` (share of non-blank lines that end in a sentence mark), ``common_words`` (share of words
    that are common in the document's language; in any, where the language is unknown).

    *common* is a small table of words, read once to the driver for the condition; one of more than ``MOST_WORDS`` is
    refused. Defined cases: null or empty
    text has 0 words and null means and ratios; languages are compared trimmed and in lower case; texts of any length
    are read whole; other columns are ignored.
    """
    known: dict[str, list[str]] = {}
    rows = common.select("lang", "word").dropna().distinct().limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} common words")
    for r in rows:
        known.setdefault(r[0], []).append(r[1].lower())
    t, words = F.col("__t"), F.col("__words")
    d = documents.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"), F.lower(F.trim(F.col(f"`{lang}`"))).alias("__lang"))
    # Joiners of emoji are marks, which words may hold; they go first.
    d = d.withColumn("__low", F.translate(F.lower("__t"), "\ufe0f\u200d", ""))
    d = d.withColumn("__words", F.array_remove(F.split("__low", _GAP), ""))
    hits = lambda ws: F.size(F.filter(words, lambda w: w.isin(sorted(set(ws))))) if ws else F.lit(0)
    found = reduce(lambda c, kv: c.when(F.col("__lang") == kv[0], hits(kv[1])), known.items(), F.when(F.lit(False), F.lit(0)))
    d = d.withColumns({"word_count": F.size(words), "__joined": F.array_join(words, ""), "__hits": found.otherwise(hits([w for ws in known.values() for w in ws])), "__distinct": F.size(F.array_distinct(words))})
    d = d.withColumns(
        {
            "__letters": F.length(F.translate("__joined", "'’", "")),
            "__alpha": F.length(F.translate("__joined", "'’0123456789", "")),
            "__solid": F.length(F.regexp_replace(t, r"[\s\p{Z}]+", "")),
            "__dots": F.length(t) - F.length(F.regexp_replace(t, r"\.{4,}", "")),
            "__chars": F.length(t),
            "__lines": F.regexp_count(t, F.lit(r"(?m)^.*\S.*$")),
            "__ended": F.regexp_count(t, F.lit(r"(?m)[.!?…。»”\"')][ \t]*$")),
        }
    )
    whole = F.greatest(F.col("__chars"), F.lit(1))
    n = F.greatest(F.col("word_count"), F.lit(1))
    d = d.select(
        "doc_id",
        "word_count",
        F.when(F.col("word_count") > 0, F.col("__letters") / F.col("word_count")).alias("mean_word_length"),
        F.when(F.col("__chars") > 0, F.greatest(F.lit(0), F.col("__solid") - F.col("__letters")) / F.col("__chars")).alias("symbol_ratio"),
        F.when(F.col("__lines") > 0, F.least(F.lit(1.0), F.col("__ended") / F.col("__lines"))).alias("punctuated_lines"),
        F.when(F.col("word_count") > 0, F.least(F.lit(1.0), F.col("__hits") / F.col("word_count"))).alias("common_words"),
        F.col("__chars").alias("n_chars"),
        F.col("__lines").alias("n_lines"),
        (F.col("__alpha") / F.greatest(F.col("__solid") - F.col("__dots"), F.lit(1))).alias("letter_share"),
        F.col("__distinct").alias("distinct_tokens"),
        F.col("word_count").alias("n_tokens"),
        _share(t, _BULLET, whole).alias("bullet_share"),
        _share(t, _SHORT, whole).alias("short_share"),
        _share(t, _LEADER, whole).alias("leader_share"),
        _share(t, _ROW, whole).alias("row_share"),
        _share(t, _FIELD, whole).alias("field_share"),
        (F.regexp_count(t, F.lit(r"[,;] ")) / n).alias("separator_rate"),
        _share(t, _LONG, whole).alias("long_share"),
        _share(t, r"(?<![^\s|,;])(?!https?://)[^\s|,;]{36,}", whole).alias("solid_share"),
        (F.regexp_count("__low", F.lit(r"[bcdfghjklmnpqrstvwxz]{5,}")) / n).alias("consonant_share"),
        (F.regexp_count(t, F.lit(r"\b(?=[a-f]{0,40}[0-9])[0-9a-f]{6,40}\b")) / n).alias("hex_share"),
        _share(t, r"[ÃÂÐÑâ][-¿‚-›€™Œ-ž‹›ƒ]*", whole).alias("garbled_share"),
    )
    return d.withColumns(
        {
            "distinct_share": F.col("distinct_tokens") / F.greatest(F.col("word_count"), F.lit(1)),
            "tokens_per_line": F.col("word_count") / F.greatest(F.col("n_lines"), F.lit(1)),
            "listed_share": F.col("bullet_share") + F.col("leader_share") + F.col("short_share"),
            "tabular_share": F.col("row_share") + F.col("field_share"),
        }
    )


@dataclass(frozen=True)
class Thresholds:
    """Thresholds by statistic, the share of each type in the sample, and by statistic what a type's documents of the
    sample count in each range; ``n`` is the size of the sample."""

    cuts: dict[str, list[float]]
    share: np.ndarray
    counts: dict[str, np.ndarray]
    n: int


def _entropy(y: np.ndarray) -> float:
    p = np.bincount(y, minlength=len(KINDS)) / max(len(y), 1)
    p = p[p > 0]
    return float(-(p * np.log(p)).sum())


def _cuts(v: np.ndarray, y: np.ndarray, depth: int, least: int) -> list[float]:
    """Thresholds that tell most about the type, found by halving again and again; none where there is little to tell."""
    if depth == 0 or len(v) < 2 * least:
        return []
    u = np.unique(np.quantile(v, np.linspace(0, 1, 65)))
    best, at = 0.01, None
    for q in (u[:-1] + u[1:]) / 2:
        high = v > q
        n = int(high.sum())
        if least <= n <= len(v) - least:
            gain = _entropy(y) - (n * _entropy(y[high]) + (len(v) - n) * _entropy(y[~high])) / len(v)
            if gain > best:
                best, at = gain, float(q)
    if at is None:
        return []
    return [*_cuts(v[v <= at], y[v <= at], depth - 1, least), at, *_cuts(v[v > at], y[v > at], depth - 1, least)]


def find_thresholds(stats: DataFrame, labels: DataFrame, most: int = MOST_LABELS, depth: int = 4, least: int | None = None) -> Thresholds:
    """Thresholds of each statistic by itself, from at most *most* labelled documents (``doc_id, kind``).

    Of more labels those with the smallest hash of their key are read. Labels of unknown kinds or documents are left out;
    of a document labelled twice the first kind in the alphabet counts. A range holds *least* labelled documents or more:
    8, or one in 25 of a sample of fewer than 200.
    """
    known = labels.where(F.col("kind").isin(KINDS) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("kind").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = stats.join(F.broadcast(known), "doc_id").select("label", *STATISTICS).toPandas()  # at most *most* rows
    y = np.array([KINDS.index(k) for k in rows["label"]], dtype=np.int64)
    least = least or max(1, min(8, len(y) // 25))
    cuts, counts = {}, {}
    for c in STATISTICS:
        v = rows[c].astype(float).fillna(0.0).to_numpy()
        if found := _cuts(v, y, depth, least):
            cuts[c] = found
            counts[c] = np.zeros((len(KINDS), len(found) + 1))
            np.add.at(counts[c], (y, np.searchsorted(found, v, side="left")), 1.0)
    return Thresholds(cuts, (np.bincount(y, minlength=len(KINDS)) + 1) / (len(y) + len(KINDS)), counts, len(y))


def with_ranges(stats: DataFrame, thresholds: Thresholds) -> DataFrame:
    """Adds ``r_<statistic>``, the range that the statistic's value lies in; null counts as 0."""
    value = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return stats.withColumns({f"r_{c}": reduce(lambda a, q: a + (value(c) > q).cast("int"), cuts, F.lit(0)).cast("tinyint") for c, cuts in thresholds.cuts.items()})


def _expect(names: list[str], prior: np.ndarray, rates: list[np.ndarray]):
    """The expectation step over patterns of ranges with their numbers: sums by type, and by type, statistic and range."""
    log_prior, logs = np.log(prior), [np.log(r) for r in rates]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mass, counts = np.zeros(len(prior)), [np.zeros_like(r) for r in rates]
        for d in parts:
            ranges, n = [d[c].to_numpy().astype(int) for c in names], d["n"].to_numpy().astype(float)
            log = log_prior + sum(lg[:, r].T for lg, r in zip(logs, ranges))
            post = np.exp(log - log.max(1, keepdims=True))
            post *= (n / post.sum(1))[:, None]
            mass += post.sum(0)
            for c, r in zip(counts, ranges):
                for k in range(len(prior)):
                    c[k] += np.bincount(r, weights=post[:, k], minlength=c.shape[1])
        flat = np.concatenate([mass, *[c.ravel() for c in counts]])
        yield pd.DataFrame({"at": np.arange(len(flat)), "x": flat})

    return run


def fit_accuracies(patterns: DataFrame, thresholds: Thresholds, rounds: int = 20) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Prior of the types and, by statistic, the probability of each range given the type: EM over all documents.

    *patterns* has a row per pattern of ranges with its number ``n`` of documents. At first every labelling function is
    believed alike (``BELIEF``) to be right in what it speaks for; from there only the functions' agreements decide, with
    the labelled documents of the sample kept at their labels at a weight of ``LABELLED_WEIGHT`` of all documents.
    To the driver come sums by type and range, some hundreds of numbers a round, whatever the number of documents.
    Rounds end when the types' shares stand still. ``rounds=0`` gives the start, that is, a vote of equals.
    """
    names = [f"r_{c}" for c in thresholds.cuts]
    prior, rates = thresholds.share, []
    for c, n in thresholds.counts.items():
        speaks = (n / np.maximum(n.sum(0), 1) / prior[:, None]).argmax(0)
        r = np.where(speaks[None, :] == np.arange(len(KINDS))[:, None], BELIEF, 1 - BELIEF)
        rates.append(r / r.sum(1, keepdims=True))
    start = [r.copy() for r in rates]
    sizes = np.cumsum([len(KINDS), *[r.size for r in rates]])
    for _ in range(rounds if names else 0):
        got = patterns.select(*names, "n").mapInPandas(_expect(names, prior, rates), "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
        flat = np.zeros(sizes[-1])
        for r in got:
            flat[r["at"]] = r["x"]
        mass = flat[: len(KINDS)]
        if not mass.sum():
            break
        weight = LABELLED_WEIGHT * mass.sum() / max(thresholds.n, 1)
        rates = []
        for i, c in enumerate(thresholds.cuts):
            x = flat[sizes[i] : sizes[i + 1]].reshape(start[i].shape) + weight * thresholds.counts[c] + 2 * start[i]
            rates.append(x / x.sum(1, keepdims=True))
        last, prior = prior, (mass + 1) / (mass.sum() + len(KINDS))
        if np.abs(prior - last).max() < 1e-5:
            break
    return prior, dict(zip(thresholds.cuts, rates))


def text_types(ranged: DataFrame, model: tuple[np.ndarray, dict[str, np.ndarray]]) -> DataFrame:
    """Adds ``kind``, the most probable type, and ``posterior``, its probability.

    A sum of log probabilities per type, in Arrow batches of ranges (a few bytes a document); ties go to the earlier of
    prose, list, table, junk. Where the model has no thresholds, as without labels, all documents get the type of the
    greatest prior.
    """
    prior, rates = model
    names, log_prior, logs = [f"r_{c}" for c in rates], np.log(prior), [np.log(r) for r in rates.values()]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            log = log_prior + sum((lg[:, d[c].to_numpy().astype(int)].T for c, lg in zip(names, logs)), np.zeros((len(d), 1)))
            best = log.argmax(1)
            total = np.exp(log - log.max(1, keepdims=True)).sum(1)
            yield pd.DataFrame({"kind": np.array(KINDS, dtype=object)[best], "posterior": 1 / total})

    # Not deterministic for the optimizer: a filter on the type would else be pushed below and evaluate it twice.
    typed = F.pandas_udf(run, "kind string, posterior double").asNondeterministic()
    given = F.struct(*[F.col(c) for c in names]) if names else F.struct(F.lit(0).alias("none"))
    return ranged.withColumn("__t", typed(given)).select(*ranged.columns, "__t.kind", "__t.posterior")


def classify(documents: DataFrame, common: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, rounds: int = 20) -> DataFrame:
    """Statistics, ranges, type and posterior of every document; the statistics are written once, as are the patterns.

    Defined cases: see :func:`text_statistics`; without labels every document is prose.
    """
    stats = cut_lineage(text_statistics(documents, common))
    thresholds = find_thresholds(stats, labels, most_labels)
    ranged = with_ranges(stats, thresholds)
    patterns = cut_lineage(ranged.groupBy(*[f"r_{c}" for c in thresholds.cuts]).agg(F.count(F.lit(1)).alias("n"))) if thresholds.cuts else ranged
    return text_types(ranged, fit_accuracies(patterns, thresholds, rounds))
