"""What each filter of a cascade removes in every order, by relations of failing ids.

Every filter has one table of the rows that fail it, written once in buckets of the row number. Survivors of every set of
filters come from left-anti joins: the rows that survive a set of earlier filters, less those that fail the next one. What
a filter removes after a set of others is a left-semi join of that set's survivors with its own table; what it would have
removed but for them is the rest of that table. As all tables share their buckets, none of these joins shuffles, and a
set of filters is worked on once, however many orders begin with it: n filters make 2^n sets, not n! orders.

A document is a row: repeated rows count each, and a row of its own is what the ids stand for. Null texts are empty; a
null part is the empty string. A null doc_id has no labels and is no copy of anything, nor is anything a copy of it;
conflicting labels of one id count as the larger. Texts of any length are read whole. A table without rows has no parts
and so no result. Extra columns do not matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsight.llm.ordering import shuffle_width
from jobsight.session import shared_dir, stored

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words, distinct words in percent of words, capitals in percent of characters.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 3


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def too_short(text: Column) -> Column:
    return F.size(words(text)) < MIN_WORDS


def too_repetitive(text: Column) -> Column:
    return 100 * F.size(F.array_distinct(words(text))) < MIN_DISTINCT * F.size(words(text))


def too_loud(text: Column) -> Column:
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return 100 * capitals.cast("long") > MAX_CAPITALS * F.length(text)


def has_signs(text: Column) -> Column:
    return text.rlike("[#$%&*|]")


#: A filter by its letter: a condition on the text, or None for "the text of a smaller doc_id".
FILTERS: dict[str, Callable[[Column], Column] | None] = {"A": too_short, "B": too_repetitive, "C": too_loud, "D": has_signs, "E": None}


class _Buckets:
    """Tables of rows in the same buckets of the row number, so that they meet without a shuffle."""

    def __init__(self, like: DataFrame):
        self._spark, self._width, self._names = like.sparkSession, shuffle_width(like), []

    def keep(self, rows: DataFrame) -> str:
        """``rows`` as a table."""
        name = f"audit_{uuid.uuid4().hex}"
        rows = rows.repartition(self._width, "row").write.option("path", shared_dir(self._spark, "audit"))
        rows.format("parquet").bucketBy(self._width, "row").sortBy("row").saveAsTable(name)
        self._names.append(name)
        return name

    def add(self, rows: DataFrame, name: str) -> None:
        """More rows for a table; they come from these tables and lie in their buckets already."""
        rows.write.format("parquet").bucketBy(self._width, "row").sortBy("row").mode("append").saveAsTable(name)

    def read(self, name: str) -> DataFrame:
        return self._spark.table(name)

    def forget(self) -> None:
        """The names go; the files stay with the folder of the job."""
        for name in self._names:
            self._spark.sql(f"DROP TABLE IF EXISTS {name}")


def judged(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable | None] = FILTERS) -> DataFrame:
    """Per row: row, part, good, toxic and ``fails_X`` of every filter X. Texts are read once and go no further."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = {f"fails_{f}": test(text) for f, test in filters.items() if test is not None}
    base = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("same"), *[c.alias(n) for n, c in own.items()])
    base = stored(base.withColumn("row", F.monotonically_increasing_id()), "audit")
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = base.join(marks, "doc_id", "left")
    first = base.groupBy("same").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = rows.join(first, "same", "left")
    copies = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    fails = [F.col(f"fails_{f}") if test is not None else copies.alias(f"fails_{f}") for f, test in filters.items()]
    number = [F.coalesce(F.col(c), F.lit(False)).cast("int").alias(c) for c in ("good", "toxic")]
    return later.select("row", "part", *number, *fails)


def subsets(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable | None] = FILTERS) -> tuple[DataFrame, DataFrame]:
    """(part, before, kept), the survivors of every set ``before`` of filters, and (part, before, filter, removed,
    good_lost, toxic_lost), what each filter removes from them. Both have a row for every count that is not zero."""
    letters = "".join(filters)
    rows = stored(judged(docs, labels, filters), "audit")
    tables = _Buckets(docs)
    fails = {f: tables.keep(rows.filter(f"fails_{f}").select("row")) for f in letters}
    survivors = tables.keep(rows.select("row", "part", "good", "toxic", F.lit("").alias("before")))
    for f in letters:
        # What survived every set of the filters so far survives these sets with one filter more.
        left = tables.read(survivors).join(tables.read(fails[f]), "row", "left_anti")
        tables.add(left.withColumn("before", F.concat("before", F.lit(f))), survivors)
    kept = tables.read(survivors).groupBy("part", "before").agg(F.count(F.lit(1)).alias("kept"))
    removed, sums = [], [F.count(F.lit(1)).alias("removed"), F.sum("good").alias("good_lost"), F.sum("toxic").alias("toxic_lost")]
    for f in letters:
        gone = tables.read(survivors).filter(~F.col("before").contains(f)).join(tables.read(fails[f]), "row", "left_semi")
        removed.append(gone.groupBy("part", "before").agg(*sums).withColumn("filter", F.lit(f)))
    out = stored(kept, "audit"), stored(_union(removed), "audit")
    tables.forget()
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable | None] = FILTERS) -> DataFrame:
    """Per part, order of the filters and step: what is kept, removed, redundant, and the filter's share over all orders."""
    kept, removed = subsets(docs, labels, filters)
    letters, n = "".join(filters), len(filters)
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(letters)])).alias("filter_order")
    steps = kept.filter("before = ''").select("part", orders)
    steps = steps.select("part", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))

    def as_set(length: Column) -> Column:
        taken = F.substring("filter_order", F.lit(1), length)
        # A set of filters is written in the order in which they are given.
        return F.concat(*[F.when(taken.contains(f), f).otherwise("") for f in letters])

    steps = steps.withColumns({"filter": F.substring("filter_order", F.col("step"), F.lit(1)), "before": as_set(F.col("step") - 1), "after": as_set(F.col("step"))})
    alone = removed.filter("before = ''").select("part", "filter", F.col("removed").alias("fails"))
    only = removed.filter(F.length("before") == n - 1).select("part", "filter", F.col("removed").alias("unique_fails"))
    shown = steps.join(kept.withColumnRenamed("before", "after"), ["part", "after"], "left")
    shown = shown.join(removed, ["part", "before", "filter"], "left").join(alone, ["part", "filter"], "left").join(only, ["part", "filter"], "left")
    shown = shown.fillna(0, ["kept", "removed", "good_lost", "toxic_lost", "fails", "unique_fails"])
    shares = shown.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return shown.join(shares, ["part", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
