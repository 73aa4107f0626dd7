"""Expression semantics over the driver's tables, each with SQL written from the language's rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import expressions as X
from tessera.operators.metrics import r6
from tessera.plans.registry import query, table


@query("""SELECT event_id, value = user_id AS mixed, (CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = user_id AS flag_number,
    coalesce(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) = user_id, false) AS text_number, false AS int_float, event_type = 'click' AS same_kind,
    NOT (event_type = 'click') AS unequal, false AS null_number FROM events""")
def expr_equality(spark, d):
    """``==``, ``!=`` and ``===`` by the types of both sides."""
    rows = table(spark, d, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1)).withColumn("bad", F.col("event_type") == "error")
    v = {c: X.Value.of(rows, c) for c in ("value", "user_id", "k", "bad", "event_type")}
    click, null = X.Value.literal("click"), X.Value.literal(None)
    return rows.select(
        "event_id", X.loose_equals(v["value"], v["user_id"]).alias("mixed"), X.loose_equals(v["bad"], v["user_id"]).alias("flag_number"),
        X.loose_equals(v["k"], v["user_id"]).alias("text_number"), X.strict_equals(v["value"], v["user_id"]).alias("int_float"), X.strict_equals(v["event_type"], click).alias("same_kind"),
        (~X.loose_equals(v["event_type"], click)).alias("unequal"), X.loose_equals(v["user_id"], null).alias("null_number"),
    )


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'True' ELSE 'False' END || event_type AS flag_text, event_type || 'None' AS null_text, user_id + 1.0::DOUBLE AS flag_number,
    value < 50 AS below, false AS text_below, user_id >= 0 AS above_null, (value = 0) AS negated, -value AS minus, CASE WHEN user_id <> 0 THEN 'some' ELSE 'none' END AS picked FROM events""")
def expr_arithmetic(spark, d):
    """``+`` of unlike types, comparisons as numbers, ``!``, unary minus and ``? :``."""
    rows = table(spark, d, "events").withColumn("bad", F.col("event_type") == "error")
    v = {c: X.Value.of(rows, c) for c in ("value", "user_id", "bad", "event_type")}
    null, true, fifty = X.Value.literal(None), X.Value.literal(True), X.Value.literal("50")
    return rows.select(
        "event_id", X.plus(v["bad"], v["event_type"]).alias("flag_text"), X.plus(v["event_type"], null).alias("null_text"), X.plus(v["user_id"], true).alias("flag_number"),
        X.compare(v["value"], "<", fifty).alias("below"), X.compare(v["event_type"], "<", v["value"]).alias("text_below"), X.compare(v["user_id"], ">=", null).alias("above_null"),
        X.negation(v["value"]).alias("negated"), (-X.number(v["value"])).alias("minus"), X.ternary(v["user_id"], F.lit("some"), F.lit("none")).alias("picked"),
    )


@query("""SELECT p_partkey, trim(upper(p_name)) AS upper, lower(p_type) AS lower, ends_with(p_name, 'ring') AS ends, p_name[1] AS first_char, length(p_name) AS chars, len(string_split(p_name, ' '))::INT AS words,
    string_split(p_name, ' ')[2] AS second, NULL::VARCHAR AS beyond FROM part""")
def expr_strings(spark, d):
    """Methods and positions of texts."""
    rows = table(spark, d, "part").withColumn("padded", F.concat(F.lit("\t "), F.upper("p_name"), F.lit("\n")))
    name = X.Value.of(rows, "p_name")
    words = X.Value(X.split_text(F.col("p_name"), " "), "list")
    return rows.select(
        "p_partkey", X.trimmed(F.col("padded")).alias("upper"), F.lower("p_type").alias("lower"), F.col("p_name").endswith("ring").alias("ends"), X.element(name, F.lit(0)).alias("first_char"),
        X.length(name).alias("chars"), X.length(words).alias("words"), X.element(words, F.lit(1)).alias("second"), X.element(words, F.lit(-1)).alias("beyond"),
    )


@query("""WITH o AS (SELECT l_orderkey, list({'part': l_partkey, 'flag': CASE WHEN l_discount > 0.05 THEN 'x' ELSE '' END} ORDER BY l_linenumber, l_partkey, l_suppkey) AS items FROM lineitem GROUP BY 1)
    SELECT l_orderkey, array_to_string(list_transform(items, lambda i: i.part::VARCHAR), ',') AS parts, len(list_filter(items, lambda i: i.flag = 'x'))::INT AS flagged,
    array_to_string(list_concat(list_transform(items, lambda i: i.part)[:2], [7]), ';') AS joined, (len(items) + 1)::INT AS pushed, items[-1].part AS popped, (len(items) - 1)::INT AS left_over,
    len(list_filter(items, lambda i: i.part = items[1].part))::INT AS same_as_first FROM o""")
def expr_lists(spark, d):
    """``map``, ``filter``, ``concat``, ``join``, ``push`` and ``pop`` over an order's items."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_discount") > 0.05, "x").otherwise("").alias("flag"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    items = F.col("items")
    parts = X.mapped(items, "l_partkey")
    left, last = X.popped(items)
    return rows.select(
        "l_orderkey", X.joined(parts).alias("parts"), F.size(X.filtered(items, "flag")).alias("flagged"), X.joined(X.concatenated(X.sliced(parts, 0, 2), X.Value.literal(7)), ";").alias("joined"),
        X.pushed(parts, F.lit(7).cast("long"))[1].alias("pushed"), last["l_partkey"].alias("popped"), F.size(left).alias("left_over"), F.size(X.filtered(parts, equal=F.get(parts, F.lit(0)))).alias("same_as_first"),
    )


@query("""SELECT event_id, floor(value + 0.5)::BIGINT AS rounded, ceil(value)::BIGINT AS up, greatest(value, user_id::DOUBLE) AS most, abs(value - 50) AS distance, json_extract(props, '$.k')::BIGINT AS k,
    '{"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS json, 'event ' || event_id || ' of ' || user_id AS label, CASE WHEN (event_id % 3) = 0 THEN -1.0::DOUBLE ELSE value END AS recovered FROM events""")
def expr_functions(spark, d):
    """``Math``, ``JSON``, template literals and fallbacks of computed fields."""
    rows = table(spark, d, "events")
    failed = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    return rows.select(
        "event_id", X.rounded(F.col("value")).alias("rounded"), F.ceil("value").alias("up"), F.greatest("value", F.col("user_id").cast("double")).alias("most"), F.abs(F.col("value") - 50).alias("distance"),
        X.parsed(F.col("props"), "k long")["k"].alias("k"), X.stringified(F.struct("user_id", "event_type")).alias("json"), F.concat(F.lit("event "), F.col("event_id"), F.lit(" of "), F.col("user_id")).alias("label"),
        X.recovered(failed, "use_fallback", F.lit(-1.0)).alias("recovered"),
    )


@query("""SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS keys, count(DISTINCT event_type)::INT AS entries, bool_or(event_type = 'error' AND n > 2) AS some FROM
    (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1""")
def expr_objects(spark, d):
    """``Object.keys``, ``Object.entries`` and ``some`` over a map of counts."""
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))  # an entry for each type of event
    return maps.select("user_id", X.joined(F.sort_array(X.keys_of(F.col("m")))).alias("keys"), F.size(X.entries_of(F.col("m"))).alias("entries"), F.exists(X.entries_of(F.col("m")), lambda e: (e["key"] == "error") & (e["value"] > 2)).alias("some"))


@query("""SELECT event_id, event_type = 'click' AS equal, props IS NOT NULL AS given, value > 50 AS above, user_id < 10 AS below, event_type <> '' AS true FROM events""")
def expr_conditions(spark, d):
    """The second, smaller condition language."""
    c = F.col
    return table(spark, d, "events").select(
        "event_id", X.condition(c("event_type"), "==", "click").alias("equal"), X.condition(c("props"), "!= null").alias("given"), X.condition(c("value"), ">", 50).alias("above"),
        X.condition(c("user_id"), "<", 10).alias("below"), X.condition(c("event_type"), "").alias("true"),
    )


@query("""SELECT event_id, round(greatest(100, least(1000.0::DOUBLE * power(2.0::DOUBLE, event_id % 8), 30000)), 6) AS delay FROM events""")
def retry_delays(spark, d):
    from tessera.operators.analytics import retry_delay

    return table(spark, d, "events").select("event_id", r6(retry_delay(F.col("event_id") % 8, 1000, 2, 30_000)).alias("delay"))
