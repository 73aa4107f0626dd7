"""Lookups, listings, recovery rules and symbols over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import lookups as L
from tessera.operators import paging
from tessera.plans.code_queries import _P, code_files
from tessera.plans.check_queries import branching
from tessera.plans.registry import failed, query, table
from tessera.sources import symbols as S


@query("SELECT event_id, event_type, value FROM events WHERE user_id = 3")
def events_of_user(spark, d):
    return L.by_id(table(spark, d, "events"), "user_id", 3).select("event_id", "event_type", "value")


@query("""SELECT user_id, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000.0::DOUBLE, 6) AS duration_ms, round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 6) AS growth FROM events GROUP BY 1""")
def value_spans(spark, d):
    return L.spans(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", "ts")


@query("SELECT r_regionkey, r_name FROM region")
def small_page(spark, d):
    """A table of few rows is one page, whatever the cursor."""
    rows = table(spark, d, "region").withColumn("chars", paging.json_length("r_regionkey", "r_name"))
    return L.page_or_all(rows, "r_regionkey", "chars", 5, cursor=2).select("r_regionkey", "r_name")


@query("SELECT o_custkey, round(CASE WHEN count(*) = 0 THEN 0 ELSE 100.0::DOUBLE * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) END, 6) AS done FROM orders GROUP BY 1")
def completion_rates(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(L.completion(F.count(F.lit(1)), F.count_if(F.col("o_orderstatus") == "F")).alias("done"))


#: The type of step that an event of the table stands for.
STEPS = {"click": "user_input", "view": "conditional", "purchase": "mcp_call", "signup": "shell_command"}


@query("""WITH s AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'user_input' WHEN 'view' THEN 'conditional' WHEN 'purchase' THEN 'mcp_call' WHEN 'signup' THEN 'shell_command' ELSE 'other' END AS step FROM events)
    SELECT event_id, step, CASE step WHEN 'user_input' THEN 'continue' WHEN 'mcp_call' THEN 'retry' WHEN 'shell_command' THEN 'retry' ELSE 'fail' END AS strategy,
    CASE step WHEN 'mcp_call' THEN 3 WHEN 'shell_command' THEN 2 ELSE 0 END AS retries, CASE step WHEN 'mcp_call' THEN 500 WHEN 'shell_command' THEN 1000 ELSE 0 END AS delay_ms FROM s""")
def default_handlers(spark, d):
    """Each failed step's default handling by its type."""
    step = F.lit("other")
    for name, kind in STEPS.items():
        step = F.when(F.col("event_type") == name, kind).otherwise(step)
    return table(spark, d, "events").select("event_id", step.alias("step")).select("event_id", "step", L.default_handler(F.col("step")).alias("h")).select("event_id", "step", "h.*")


@query("""SELECT event_id, CASE WHEN event_type = 'error' AND value >= 80 THEN 'restart' WHEN event_type = 'error' THEN 'retry' WHEN event_type = 'view' AND value >= 50 THEN 'skip' ELSE 'escalate' END AS action FROM events""")
def recovery_rules(spark, d):
    rules = spark.createDataFrame([("error", 80.0, 1, "restart"), ("error", 0.0, 2, "retry"), ("view", 50.0, 1, "skip")], "kind string, least double, priority int, action string")
    return L.recovery_plan(table(spark, d, "events").select("event_id", "event_type", "value"), rules, "event_type", "value").select("event_id", "action")


@query("""SELECT user_id, CASE arg_max(event_type, (ts, event_id)) WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'running' WHEN 'view' THEN 'running' ELSE 'paused' END AS status, count(*) AS events FROM events GROUP BY 1""")
def workflow_statuses(spark, d):
    kind = F.col("event_type")
    return L.statuses(table(spark, d, "events"), "user_id", ["ts", "event_id"], kind.isin("click", "view"), kind == "purchase", failed())


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 90) AS slow FROM events GROUP BY 1")
def derived_counters(spark, d):
    return L.counters(table(spark, d, "events"), "user_id", {"errors": failed(), "slow": F.col("value") > 90})


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'state' WHEN 'view' THEN 'context' END AS target, CASE event_type WHEN 'click' THEN 'a.b' WHEN 'view' THEN 'c' END AS field FROM events""")
def update_routes(spark, d):
    kind = F.col("event_type")
    path = F.when(kind == "click", "this.a.b").when(kind == "view", "global.c").otherwise("computed.d")
    return L.routed_updates(table(spark, d, "events").select("event_id", path.alias("path")), "path").select("event_id", "target", "field")


@query("SELECT p_partkey, p_brand, (p_size % 3)::DOUBLE AS score FROM part WHERE p_size % 3 > 0 AND p_retailprice > 1000")
def scored_hints(spark, d):
    """Hints of the standards that score."""
    part = table(spark, d, "part")
    scored = part.select("p_partkey", (F.col("p_size") % 3).cast("double").alias("score"))
    return L.best_hints(scored, part.where("p_retailprice > 1000").select("p_partkey", "p_brand"), "p_partkey").select("p_partkey", "p_brand", "score")


@query("SELECT c_custkey, (length(c_name) // 4 + length(c_mktsegment) // 4)::BIGINT AS tokens FROM customer")
def content_tokens(spark, d):
    """Tokens of all texts in nested JSON."""
    json = F.to_json(F.struct("c_custkey", F.struct("c_name", F.array("c_mktsegment").alias("tags")).alias("inner")))
    return table(spark, d, "customer").select("c_custkey", L.text_tokens(json).alias("tokens"))


_SYMBOLS = f"""WITH p AS ({_P}) SELECT file, 'Part' || k AS name, 'class' AS kind, 11 AS line_no, 2::BIGINT AS uses FROM p
    UNION ALL SELECT file, 'run' || near, 'function', 12, count(*) OVER (PARTITION BY near) FROM p UNION ALL SELECT file, 'free' || near, 'function', 19, 0 FROM p"""


@query(_SYMBOLS)
def symbol_table(spark, d):
    """Classes and functions with the number of their uses."""
    return S.symbol_uses(code_files(spark, d), "path", "text")


@query(f"SELECT file, name, line_no FROM ({_SYMBOLS}) WHERE kind = 'class' AND name = 'Part7'")
def symbol_lookup(spark, d):
    return S.lookup(S.symbols(code_files(spark, d), "path", "text"), name="Part7", kind="class").select("file", "name", "line_no")


@query("SELECT 'f' || p_partkey AS file, 'outer' || p_partkey AS name, 1 AS line_no, 2 AS parameters, 17 AS lines, 9 AS calls, 0 AS returns FROM part")
def function_details(spark, d):
    """Parameters, length, calls and returns of each function."""
    return S.function_details(branching(spark, d), "path", "text")


@query("""SELECT p_partkey, true AS is_async, p_size % 2 = 0 AS awaits, p_size % 2 = 1 AS promises, p_size % 2 AS n, CASE WHEN p_size % 2 = 0 THEN 'key' ELSE 'fn' END AS dynamic, round(least(1.0, 0.95 + CASE WHEN p_size % 2 = 0 THEN 0.1 ELSE 0 END), 6)::DOUBLE AS confidence FROM part""")
def async_flags(spark, d):
    """Asynchronous patterns, dynamic calls and adjusted confidences."""
    even = F.col("p_size") % 2 == 0
    text = F.when(even, "async function f() { await g(); table[key](1); }").otherwise("async () => new Promise(fn.bind(x)).then(y => y)")
    p = S.async_patterns(text)
    return table(spark, d, "part").select("p_partkey", p["is_async"].alias("is_async"), p["awaits"].alias("awaits"), p["promises"].alias("promises"), (F.lit(1) - p["n_awaits"]).alias("n"), F.array_join(S.dynamic_calls(text), ",").alias("dynamic"), S.confidence(F.lit(0.95), even).alias("confidence"))


@query(f"""WITH p AS ({_P}) SELECT file AS path, 'export class Part' || k || ' extends Base' || near || ' {{' || chr(10) || '  run' || near || '(a, b) {{' || chr(10) || '// ...' AS example FROM p""")
def code_examples(spark, d):
    """Short examples of files."""
    return code_files(spark, d).select("path", S.example_of(F.regexp_replace("text", r"(?m)^const late[^\n]*\n", ""), 2).alias("example"))


@query("""SELECT 'p' || n_nationkey AS project, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE 'p' || (n_nationkey - n_nationkey % 5) END AS depends_on FROM nation""")
def workspace_projects(spark, d):
    """Projects and what they depend on, by their configuration files."""
    k = F.col("n_nationkey")
    json = F.when(k % 5 == 0, F.format_string('{"name":"p%d"}', k)).otherwise(F.format_string('{"name":"p%d","references":[{"path":"../w%d"}]}', k, k - k % 5))
    return S.workspaces(table(spark, d, "nation").select(F.format_string("w%d/tsconfig.json", k).alias("path"), json.alias("text")), "path", "text")


@query("""WITH m AS (SELECT event_id, 'workflow ' || user_id || ' stopped: step ' || event_type || ' of workflow x' || user_id || repeat(' because ' || event_type, (event_id % 90)::BIGINT) AS long FROM events),
    b AS (SELECT event_id, replace(replace(long, 'workflow ' || user_id, 'workflow'), 'step ' || event_type, 'step') AS t FROM m JOIN events USING (event_id))
    SELECT event_id, CASE WHEN length(t) > 500 THEN t[1:497] || '...' ELSE t END AS message FROM b""")
def concise_errors(spark, d):
    """Messages of errors in short: ids that are known go, long texts are cut."""
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    text = F.concat(F.lit("workflow "), user, F.lit(" stopped: step "), kind, F.lit(" of workflow x"), user, F.repeat(F.concat(F.lit(" because "), kind), (F.col("event_id") % 90).cast("int")))
    return table(spark, d, "events").select("event_id", L.concise_error(text, F.col("user_id"), kind).alias("message"))
