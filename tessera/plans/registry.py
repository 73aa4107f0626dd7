"""The engine's own operators as registered queries over the driver's tables, each with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import expressions as X
from tessera.functions import text as T
from tessera.operators import graph, metrics, relations, sessions
from tessera.operators.metrics import r6
from tessera.plans.cascade import with_computed
from tessera.streaming.rollups import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def failed():
    return F.col("event_type") == "error"


ROLLUP = """SELECT date_trunc('{unit}', ts)::TIMESTAMP AS bucket, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS successes, count(*) FILTER (WHERE event_type = 'error') AS failures,
    round(sum(value), 6) AS total, round(max(value), 6) AS largest, round(min(value), 6) AS smallest FROM events GROUP BY 1"""


@query(ROLLUP.format(unit="hour"))
def metrics_hourly(spark, d):
    return metrics.rollup_by(table(spark, d, "events"), "hour", "ts", "value", failed()).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(ROLLUP.format(unit="day"))
def metrics_daily(spark, d):
    return metrics.rollup_by(table(spark, d, "events"), "day", "ts", "value", failed()).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("""SELECT user_id, count(*) AS n, round(count(*) / 240.0::DOUBLE, 6) AS per_hour FROM events
    WHERE event_type = 'error' AND ts >= (SELECT max(ts) FROM events WHERE event_type = 'error') - INTERVAL 240 HOUR GROUP BY 1 HAVING count(*) >= 3""")
def error_patterns(spark, d):
    errors = table(spark, d, "events").where(failed())
    return metrics.recurring_patterns(errors, ["user_id"], "ts", hours=240)


@query("""SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) FILTER (WHERE value < 50) AS low, count(*) FILTER (WHERE value >= 50) AS high FROM events WHERE event_type = 'error' GROUP BY 1""")
def error_trends(spark, d):
    errors = table(spark, d, "events").where(failed())
    return errors.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count_if(F.col("value") < 50).alias("low"), F.count_if(F.col("value") >= 50).alias("high"))


@query("""SELECT 'error:' || props[1:100] AS signature, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent
    FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, signature LIMIT 10""")
def error_top(spark, d):
    return metrics.top_signatures(table(spark, d, "events").where(failed()), F.concat(F.lit("error:"), F.substring("props", 1, 100)), 10)


@query("""SELECT user_id::VARCHAR AS user_id, event_type, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (WHERE event_type <> 'error') / count(*), 6) AS success_rate FROM events GROUP BY ROLLUP (user_id, event_type)""")
def success_rate_rollup(spark, d):
    return metrics.success_rates(table(spark, d, "events"), ["user_id", "event_type"], failed()).withColumn("user_id", F.col("user_id").cast("string"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::DOUBLE AS i FROM events)
    SELECT user_id, round(max(value), 6) AS peak, round(avg(value), 6) AS average, round(min(value), 6) AS lowest,
    round(regr_slope(value, i) / avg(value), 6) AS growth, round(stddev_pop(value), 6) AS volatility FROM e GROUP BY 1""")
def resource_trend(spark, d):
    return metrics.trend(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")


@query("""SELECT event_type, CASE WHEN value >= 90 THEN 'critical' WHEN value >= 75 THEN 'high' ELSE 'medium' END AS severity, count(*) AS n, round(max(value), 6) AS worst
    FROM events WHERE value >= 50 GROUP BY 1, 2""")
def bottlenecks(spark, d):
    return metrics.bottlenecks(table(spark, d, "events"), "event_type", "value", ((90, "critical"), (75, "high"), (50, "medium")))


@query("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(min(value), 6) AS low, round(max(value), 6) AS high,
    round(stddev_samp(value), 6) AS deviation, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def bench_stats(spark, d):
    return metrics.value_statistics(table(spark, d, "events"), "event_type", "value")


@query(f"""WITH b AS (SELECT unnest([{", ".join(f"{b}.0::DOUBLE" for b in metrics.BUCKETS)}, NULL]) AS le)
    SELECT event_type, le, count(*) FILTER (WHERE le IS NULL AND value IS NOT NULL OR value <= le) AS n FROM events CROSS JOIN b GROUP BY ALL""")
def histogram_cumulative(spark, d):
    return metrics.cumulative_histogram(table(spark, d, "events"), "event_type", "value")


# The 14 signs of code, written out for SQL.
_SIGNS = ("function[ \\t\\n\\r\\f\\v]+[0-9A-Za-z_]+", "const[ \\t\\n\\r\\f\\v]+[0-9A-Za-z_]+", "import[ \\t\\n\\r\\f\\v]+.*from", "export[ \\t\\n\\r\\f\\v]+", "class[ \\t\\n\\r\\f\\v]+[0-9A-Za-z_]+", "interface[ \\t\\n\\r\\f\\v]+[0-9A-Za-z_]+",
    "type[ \\t\\n\\r\\f\\v]+[0-9A-Za-z_]+", "[{][ \\t\\n\\r\\f\\v]*[^}]*[}]")


def _code_sql(c: str) -> str:
    by_pattern = [f"coalesce(regexp_matches({c}, '{p}'), false)::INT" for p in (s.replace("\\\\", "\\") for s in _SIGNS)]
    any_bracket = " OR ".join(f"contains({c}, '{x}')" for x in "[](){}")
    by_text = [f"coalesce(contains({c}, '{x}'), false)::INT" for x in ("=>", "==", "!=", "//", "/*")]
    return "(" + " + ".join([*by_pattern, f"coalesce({any_bracket}, false)::INT", *by_text]) + ")"


@query(f"""SELECT doc_id, floor(floor(length(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', ' ', 'g')) ) / 4.0::DOUBLE) * CASE WHEN {_code_sql("text")} >= 3 THEN 1.2::DOUBLE ELSE 0.9::DOUBLE END)::BIGINT AS tokens FROM documents""")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT page_id, ({_code_sql('html')})::INT AS indicators, {_code_sql('html')} >= 3 AS code FROM pages")
def is_code(spark, d):
    return table(spark, d, "pages").select("page_id", T.code_indicators(F.col("html")).alias("indicators"), T.is_code(F.col("html")).alias("code"))


@query("""SELECT doc_id, running::BIGINT AS running FROM (SELECT doc_id, sum(n_chars // 4) OVER (PARTITION BY lang ORDER BY quality DESC, doc_id ROWS UNBOUNDED PRECEDING) AS running
    FROM documents JOIN labels USING (doc_id)) WHERE running <= 50000""")
def budget_prefix(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return sessions.budget_prefix(rows, "lang", [F.desc("quality"), F.col("doc_id")], F.floor(F.col("n_chars") / 4), 50_000).select("doc_id", "running")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) <= 2")
def last_n(spark, d):
    return sessions.last_rows(table(spark, d, "conversations"), "conv_id", [F.desc("turn"), F.col("role"), F.col("text")], 2).select("conv_id", "turn", "role")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS visits FROM events")
def visit_count(spark, d):
    return sessions.visits_so_far(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "visits")


@query("""SELECT event_id, CASE WHEN n <= 5 THEN 'exploration' WHEN n <= 20 THEN 'development' ELSE 'refinement' END AS phase
    FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events)""")
def session_phase(spark, d):
    n = F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, d, "events").select("event_id", F.when(n <= 5, "exploration").when(n <= 20, "development").otherwise("refinement").alias("phase"))


@query("""WITH f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 3600000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM f)
    SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY 1, 2""")
def session_windows(spark, d):
    return sessions.gap_sessions(table(spark, d, "events"), "user_id", "ts", "event_id", 3600)


@query("""SELECT p_brand, p_type, count(p_partkey) AS n, sum(p_size)::BIGINT AS tokens, min(p_partkey) AS first_rule, CASE WHEN count(p_partkey) <= 3 THEN 'small' ELSE 'large' END AS kind FROM part GROUP BY 1, 2""")
def group_rules(spark, d):
    return relations.rule_groups(table(spark, d, "part"), ["p_brand", "p_type"], "p_partkey", F.col("p_size").cast("long"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '(?:href|src)=\"([^\"]*)\"', 1)) AS target FROM pages")
def link_extract(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(T.links(F.col("html"))).alias("target"))


@query("SELECT page_id, url FROM pages WHERE starts_with(url, 'https://') AND regexp_matches(string_split(substring(url, 9), '/')[-1], '[13579]')")
def path_filter_glob(spark, d):
    return table(spark, d, "pages").where(F.col("url").rlike(T.glob_regex("https://**/*{1,3,5,7,9}*"))).select("page_id", "url")


@query("""WITH a AS (SELECT o_custkey, max(o_totalprice) AS before FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' GROUP BY 1),
    b AS (SELECT o_custkey, max(o_totalprice) AS after FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1)
    SELECT o_custkey, before, after, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' ELSE 'modified' END AS change
    FROM a FULL JOIN b USING (o_custkey) WHERE before IS DISTINCT FROM after""")
def diff_full_outer(spark, d):
    orders = table(spark, d, "orders")
    old = orders.where("o_orderdate < timestamp_ntz'1995-01-01'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("v"))
    new = orders.where("o_orderdate >= timestamp_ntz'1995-01-01'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("v"))
    return relations.snapshot_diff(old, new, "o_custkey", "v")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def orders_with_returns(spark, d):
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return table(spark, d, "orders").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_orderpriority")


def _hierarchy(spark, d):
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    nation, customer, supplier = (table(spark, d, t) for t in ("nation", "customer", "supplier"))
    return (
        nation.select(node("r", "n_regionkey").alias("src"), node("n", "n_nationkey").alias("dst"))
        .unionByName(customer.select(node("n", "c_nationkey").alias("src"), node("c", "c_custkey").alias("dst")))
        .unionByName(supplier.select(node("n", "s_nationkey").alias("src"), node("s", "s_suppkey").alias("dst")))
    )


@query("""WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
    UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier), c AS (SELECT src, dst, 1 AS hops FROM e UNION SELECT c.src, e.dst, hops + 1 FROM c JOIN e ON e.src = c.dst WHERE hops < 3)
    SELECT src, dst, min(hops) AS hops FROM c GROUP BY 1, 2""")
def hierarchy_closure(spark, d):
    return graph.closure(_hierarchy(spark, d), 3)


def _transitions(spark, d):
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select(F.col("event_type").alias("src"), after.alias("dst")).where("dst is not null")


_TRANSITIONS = "SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events"


@query(f"SELECT src, dst, count(*) AS n FROM ({_TRANSITIONS}) WHERE dst IS NOT NULL GROUP BY 1, 2")
def transition_edges(spark, d):
    return _transitions(spark, d).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH e AS (SELECT DISTINCT src, dst FROM ({_TRANSITIONS}) WHERE dst IS NOT NULL AND src <> dst) SELECT a.src AS a, a.dst AS b FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def transition_cycles(spark, d):
    return graph.two_cycles(_transitions(spark, d))


@query("""SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END)::BIGINT AS increments, arg_max(props, (ts, event_id)) AS last_set, count(*) AS appended FROM events GROUP BY 1""")
def state_fold(spark, d):
    """An update log folded per key: increments add, the last set wins, appends are counted."""
    return table(spark, d, "events").groupBy("user_id").agg(F.sum(F.when(failed(), 0).otherwise(1)).alias("increments"), F.max_by("props", F.struct("ts", "event_id")).alias("last_set"), F.count(F.lit(1)).alias("appended"))


@query("""SELECT c_custkey, round(c_acctbal / 1000, 6) AS score, CASE WHEN c_acctbal / 1000 >= 5 THEN 'A' WHEN c_acctbal > 0 THEN 'B' ELSE 'C' END AS grade,
    c_name || ':' || CASE WHEN c_acctbal / 1000 >= 5 THEN 'A' WHEN c_acctbal > 0 THEN 'B' ELSE 'C' END AS summary FROM customer""")
def computed_cascade(spark, d):
    fields = {
        "summary": (("grade",), "c_name || ':' || grade"),
        "grade": (("raw",), "case when raw >= 5 then 'A' when raw > 0 then 'B' else 'C' end"),
        "raw": ((), "c_acctbal / 1000"),
        "score": (("raw",), "round(raw, 6)"),
    }
    return with_computed(table(spark, d, "customer"), fields).select("c_custkey", "score", "grade", "summary")


@query("""SELECT event_id, CASE WHEN value <> 0 AND NOT isnan(value) THEN event_type ELSE 'none' END AS both_or, CASE WHEN event_type <> '' THEN event_type ELSE props END AS either,
    (user_id - (-7) * floor(user_id / (-7.0)))::BIGINT AS signed_mod FROM events""")
def expr_operands(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select(
        "event_id", X.both(F.lit("none"), F.col("event_type"), X.truthy_number(v)).alias("both_or"),
        X.either(F.col("event_type"), F.col("props"), X.truthy_string(F.col("event_type"))).alias("either"), X.modulo(F.col("user_id"), F.lit(-7)).cast("long").alias("signed_mod"),
    )


@query("""SELECT o_orderkey, list_sum(list(l_quantity))::DOUBLE AS quantity, count(*) AS items, max(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS discounted FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def fanout(spark, d):
    """A parent's items processed in parallel and gathered per parent."""
    joined = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("items"), F.max(F.when(F.col("l_discount") > 0.05, 1).otherwise(0)).alias("discounted"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS started, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_event_counts(spark, d):
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(events, "ts", "event_type").withColumn("started", F.col("started").cast("timestamp_ntz"))


@query("SELECT r_name, n_name, count(c_custkey) AS customers, round(coalesce(sum(c_acctbal), 0), 2) AS balance FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def workspace_rollup(spark, d):
    nation = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return nation.join(table(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("r_name", "n_name").agg(F.count("c_custkey").alias("customers"), F.round(F.coalesce(F.sum("c_acctbal"), F.lit(0)), 2).alias("balance"))
