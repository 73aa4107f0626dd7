"""Pages by a budget of tokens, estimated from the rows' JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.tables import running_total, settled, unused

# Fixed values of the estimate: characters of a token and a margin; characters of a page's own JSON around its rows.
CHARS, MARGIN, FRAME = 3.5, 1.1, 12
#: Tables of so many rows or fewer are one page.
SMALL = 10
#: Call paths are paged by rows: so many tokens each.
PATH_TOKENS = 100


def json_length(*columns: str) -> Column:
    """Characters of a row as compact JSON, nulls included."""
    return F.length(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def token_count(chars: Column) -> Column:
    """Tokens of that many characters of JSON, 1 at least."""
    return F.greatest(F.lit(1), F.floor(chars / CHARS * MARGIN)).cast("long")


def hint_tokens(chars: Column) -> Column:
    """The shorter estimate for hints: a quarter of the characters."""
    return F.floor(chars / 4).cast("long")


def most_chars(budget: int) -> int:
    """The longest JSON that is estimated at ``budget`` tokens or fewer."""
    n = int((budget + 1) * CHARS / MARGIN) + 2
    while int(n / CHARS * MARGIN) > budget:
        n -= 1
    return n


#: Rows of a key that pass through one task; a key with more is paged by jumps.
STREAM_ROWS = 1_000_000


def pages(rows: DataFrame, partition: str, order: list[str], chars: str, budget: int, most: int = STREAM_ROWS) -> DataFrame:
    """``rows`` with ``page`` (from 0 in each partition): a page holds as many rows as its budget allows, one at least.

    Give thin rows (keys and ``chars``, the length of a row's JSON). Where a page starts hangs on the page before: keys of up to ``most`` rows stream
    through a task in order, larger ones are many tasks' (``pages_by_jumps``); the pages are the same.
    """
    own = unused(rows, "own")
    large = rows.groupBy(F.col(partition).alias(own)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(own)
    if not large.take(1):
        return _streamed(rows, partition, order, chars, budget)
    large = settled(large)
    same = F.col(partition).eqNullSafe(F.col(own))
    few, many = rows.join(large, same, "left_anti"), rows.join(large, same, "left_semi")
    return _streamed(few, partition, order, chars, budget).unionByName(pages_by_jumps(many, partition, order, chars, budget))


def pages_by_jumps(rows: DataFrame, partition: str, order: list[str], chars: str, budget: int) -> DataFrame:
    """The pages of ``pages`` by pointer doubling, without a loop over rows and with no key in one task.

    Running lengths are found by ranges (``running_total``). A row's pointer leads to the row at which the next page would start if one started
    here: the row that covers the length at which this page is full. Rows and lengths meet within stretches of one page's length. From the first row on,
    pages are marked in rounds of jumps twice as long each time. Ties in ``order`` take any order.
    """
    span = most_chars(budget) + 1 - FRAME  # what a page's rows may take, a comma after each
    key, before, until = (unused(rows, x) for x in ("of", "before", "until"))
    placed = settled(running_total(rows, partition, [F.col(c) for c in order], F.col(chars).cast("long") + 1, before))
    stretch = lambda c: F.floor(c / span)
    name = F.coalesce(F.concat(F.lit("="), F.col(partition).cast("string")), F.lit("")).alias(key)  # null is a key like any other
    thin = placed.select(name, F.col(before).alias("id"), (F.col(before) + F.col(chars) + 1).alias(until))
    found = lambda c: F.last(c, ignorenulls=True).over(Window.partitionBy(key, "stretch").orderBy("value", "kind").rowsBetween(Window.unboundedPreceding, 0))
    nothing = F.lit(None).cast("long")
    # a row stands in its own stretch and, if it goes on, at the head of the next; no page reaches further
    held = thin.select(key, stretch(F.col("id")).alias("stretch"), F.col("id").alias("value"), F.lit(0).alias("kind"), F.struct("id", F.col(until).alias("until")).alias("row"), nothing.alias("asks"), nothing.alias("end"))
    heads = held.where(stretch(F.col("row.until") - 1) > F.col("stretch")).withColumn("stretch", F.col("stretch") + 1)
    asked = thin.select(key, stretch(F.col("id") + span).alias("stretch"), (F.col("id") + span).alias("value"), F.lit(1).alias("kind"), F.lit(None).cast("struct<id:bigint,until:bigint>").alias("row"), F.col("id").alias("asks"), F.col(until).alias("end"))
    met = held.unionByName(heads).unionByName(asked).withColumn("row", found("row")).where("kind = 1")
    # a row longer than a page is one by itself; past the last row there is no page
    onward = F.when(F.col("row.id") == F.col("asks"), F.col("end")).when(F.col("value") < F.col("row.until"), F.col("row.id"))
    jump = settled(met.select(key, "asks", onward.alias("to")).where("to is not null"))
    marks = new = settled(placed.select(name).distinct().select(key, F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("page")))
    length = 1
    while True:
        new = settled(marks.join(jump.withColumnRenamed("asks", "id"), [key, "id"]).select(key, F.col("to").alias("id"), (F.col("page") + length).alias("page")))
        if not new.take(1):
            break
        marks = settled(marks.unionByName(new))
        jump = settled(jump.withColumnRenamed("to", "mid").join(jump.withColumnRenamed("asks", "mid"), [key, "mid"]).select(key, "asks", "to"))
        length *= 2
    # each row's page is that of the last mark before it, in its stretch or at its head
    body = placed.select(name, stretch(F.col(before)).alias("stretch"), F.col(before).alias("value"), F.lit(1).alias("kind"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), nothing.alias("page"))
    begun = marks.select(key, stretch(F.col("id")).alias("stretch"), F.col("id").alias("value"), F.lit(0).alias("kind"), F.lit(None).cast(body.schema["row"].dataType).alias("row"), "page")
    paged = body.unionByName(begun).unionByName(begun.withColumn("stretch", F.col("stretch") + 1)).withColumn("page", found("page"))
    return paged.where("kind = 1").select("row.*", "page")


def _streamed(rows: DataFrame, partition: str, order: list[str], chars: str, budget: int) -> DataFrame:
    room = most_chars(budget)

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, page, used = object(), 0, 0
        for b in batches:
            out = []
            for k, n in zip(b.column(partition).to_pylist(), b.column(chars).to_pylist(), strict=True):
                if k != current:
                    current, page, used = k, 0, FRAME + n
                elif used + 1 + n > room:  # a comma and the row
                    page, used = page + 1, FRAME + n
                else:
                    used += 1 + n
                out.append(page)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "page"])

    schema = rows.withColumn("page", F.lit(0).cast("long")).schema
    return rows.repartition(partition).sortWithinPartitions(partition, *order).mapInArrow(paged, schema)


def page_after(rows: DataFrame, order: str, chars: str, budget: int, cursor: object = None) -> DataFrame:
    """The page after a cursor (a value of ``order``; an unknown one or none: the first page).

    No more rows than the budget's characters can be on it, so only that many are ranked, and these are few.
    """
    known = cursor is not None and bool(rows.where(F.col(order) == F.lit(cursor)).take(1))
    after = rows.where(F.col(order) > F.lit(cursor)) if known else rows
    near = after.orderBy(order).limit(most_chars(budget))
    own = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)  # of the rows just limited
    counted = near.withColumn("_chars", F.sum(F.col(chars) + 1).over(own) - 1 + FRAME).withColumn("_nth", F.row_number().over(Window.orderBy(order)))
    return counted.where((F.col("_chars") <= most_chars(budget)) | (F.col("_nth") == 1)).drop("_chars", "_nth")


def page_summary(paged: DataFrame, partition: str, order: str) -> DataFrame:
    """For each page the uniform fields of a response: ``total, page_size, next_cursor, has_more``."""
    per_page = paged.groupBy(partition, "page").agg(F.count(F.lit(1)).alias("page_size"), F.max(order).alias("last"))
    own = Window.partitionBy(partition)  # a row for each page
    last = F.col("page") == F.max("page").over(own)
    return per_page.select(partition, "page", F.sum("page_size").over(own).alias("total"), "page_size", F.when(~last, F.col("last")).alias("next_cursor"), (~last).alias("has_more"))


def next_page(rows: DataFrame, key: str, cursor: object, size: int) -> DataFrame:
    """Keyset paging by rows: the first ``size`` rows after the cursor; no cursor starts at the beginning."""
    after = rows if cursor is None else rows.where(F.col(key) > F.lit(cursor))
    return after.orderBy(key).limit(size)


def path_page(rows: DataFrame, order: list[str], page: int, max_tokens: int) -> DataFrame:
    """Page ``page`` (from 1) of call paths: ``max_tokens`` over 100 rows each, one at least."""
    size = max(1, max_tokens // PATH_TOKENS)
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)
