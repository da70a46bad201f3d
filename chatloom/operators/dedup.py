"""At-least-once deliveries: exactly one copy of each identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatloom.session import cut_lineage, fresh

__all__ = ["number_id", "frequencies", "deduplicate", "repeated_ids"]

U64_MAX = 18_446_744_073_709_551_615


def number_id(text: Column) -> Column:
    """The unsigned 64-bit number a text id denotes, as DECIMAL(20,0), else null.

    Blanks around it, a plus sign, leading zeros and decimal digits of other scripts (full-width, Arabic) are only
    ways of writing; fractions, exponents, negative and larger numbers and other text are no ids.
    """
    plain = F.translate(F.regexp_replace(text, r"^[\s ​﻿]+|[\s ​﻿]+$", ""), "０１２３４５６７８９٠١٢٣٤٥٦٧٨٩", "01234567890123456789")
    digits = F.regexp_replace(F.when(plain.rlike(r"^\+?[0-9]+$"), plain), r"^\+?0*(?=[0-9])", "")
    n = F.when(F.length(digits) <= 20, digits).try_cast("decimal(20,0)")
    return F.when(n <= F.lit(str(U64_MAX)).cast("decimal(20,0)"), n)


def frequencies(df: DataFrame, keys: list[str], out: str = "copies") -> DataFrame:
    """Rows per non-null key; counts are combined before the shuffle, so a hot key costs a row per task."""
    usable = [F.col(f"`{k}`").isNotNull() for k in keys]
    cond = usable[0]
    for u in usable[1:]:
        cond = cond & u
    return df.where(cond).groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias(out))


def repeated_ids(df: DataFrame, keys: list[str], out: str = "copies") -> DataFrame:
    """The keys that more than one row has, with their number of rows."""
    return frequencies(df, keys, out).where(F.col(out) > 1)


#: Marked keys, at most, that are broadcast; more are joined by shuffle.
FEW_MARKED = 100_000


def deduplicate(df: DataFrame, keys: list[str], order: list[Column], stored: DataFrame | None = None, mark: str | None = None) -> DataFrame:
    """One row per key: the first in *order*, which should end in a unique column.

    Identifiers are split by their frequency, which is counted over the keys alone, those of stored and of new messages
    together. Keys that come again or are stored are marked; rows meet the marks in one join. As long as there are no
    more than ``FEW_MARKED`` marks (they are written and counted first) they are broadcast, so that singletons pass
    without a shuffle; beyond that the join shuffles. Only rows of repeated identifiers are ranked, and since just the
    first rank is asked for, Spark cuts each group within the map tasks before it shuffles (``WindowGroupLimit``): a key
    that a third of the rows have sends one row per task. Both results are united.

    Defined cases: rows with a null in any key column are left alone, all of them. Ties in *order* leave one row,
    whichever Spark meets first. With *stored* (earlier results) identifiers kept there win over those of *df* and the
    result holds only what is new. *mark* adds a column of that name with the number of rows that *df* has of the key
    (1 for rows without a key). Empty input gives an empty result; other columns stay.
    """
    (copies, known, rank) = fresh(df, "copies", "known", "rank")
    key = [F.col(f"`{k}`") for k in keys]
    counted = frequencies(df, keys, copies).withColumn(known, F.lit(False))
    if stored is not None:
        old = frequencies(stored, keys, copies).withColumns({copies: F.lit(0).cast("bigint"), known: F.lit(True)})
        counted = counted.unionByName(old).groupBy(*key).agg(F.sum(copies).alias(copies), F.bool_or(known).alias(known)).where(F.col(copies) > 0)
    marks = cut_lineage(counted.where((F.col(copies) > 1) | F.col(known)))
    if marks.count() <= FEW_MARKED:
        marks = F.broadcast(marks)
    seen = df.join(marks, [*keys], "left")
    many = lambda c: [*df.columns, *([c.alias(mark)] if mark else [])]
    single = seen.where(F.col(copies).isNull()).select(*many(F.lit(1).cast("bigint")))
    groups = df.join(marks.where(~F.col(known)) if stored is not None else marks, [*keys])
    first = groups.withColumn(rank, F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col(rank) == 1)
    return single.unionByName(first.select(*many(F.col(copies))))
