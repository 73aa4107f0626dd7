"""More of the engine's operators over the driver's tables: retrieval, reliability, paths, loops, expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import expressions as X
from tessera.functions.templates import render, shortened
from tessera.operators import paths, reliability, retrieval
from tessera.operators.metrics import r6
from tessera.operators.tables import new_folder
from tessera.plans.registry import _TRANSITIONS, _hierarchy, _transitions, failed, query, table
from tessera.sources import code
from tessera.streaming import session_state

_STANDARDS = """SELECT DISTINCT lang AS category, ['ref=', 'www'] AS tags, ['*//blog.*', '?' || lang] AS globs,
    CASE lang WHEN 'en' THEN 'required' WHEN 'de' THEN 'important' ELSE 'recommended' END AS priority FROM documents WHERE lang IS NOT NULL"""


@query(f"""WITH s AS ({_STANDARDS}), p AS (SELECT page_id, url, string_split_regex(lower(url), '/+') AS parts FROM pages),
    x AS (SELECT page_id, url, parts[:len(parts) - 1] AS folders, s.* FROM p CROSS JOIN s),
    y AS (SELECT page_id, category, CASE WHEN list_contains(folders, category) OR list_has_any(folders, tags) THEN 1.0 WHEN url GLOB globs[1] OR url GLOB globs[2] OR string_split(url, '/')[-1] GLOB globs[2] THEN 0.8
        WHEN len(list_filter(folders, lambda f: contains(f, category))) > 0 THEN 0.6 WHEN contains(lower(url), tags[1]) OR contains(lower(url), tags[2]) THEN 0.4 ELSE 0 END::DOUBLE
        * CASE priority WHEN 'required' THEN 1.2 WHEN 'important' THEN 1.1 ELSE 1.0 END::DOUBLE AS score FROM x)
    SELECT page_id, category, round(score, 6) AS score FROM y WHERE score > 0""")
def relevance_score(spark, d):
    langs = table(spark, d, "documents").select(F.col("lang").alias("category")).where("category is not null").distinct()
    standards = langs.select(
        "category", F.array(F.lit("ref="), F.lit("www")).alias("tags"), F.array(F.lit("*//blog.*"), F.concat(F.lit("?"), "category")).alias("globs"),
        F.when(F.col("category") == "en", "required").when(F.col("category") == "de", "important").otherwise("recommended").alias("priority"),
    )
    return retrieval.relevant_standards(table(spark, d, "pages").select("page_id", "url"), standards, "url").select("page_id", "category", r6(F.col("score")).alias("score"))


@query("""WITH RECURSIVE o AS (SELECT doc_id, lang, n_chars // 4 AS tokens, row_number() OVER (PARTITION BY lang ORDER BY quality DESC, doc_id) AS i FROM documents JOIN labels USING (doc_id)),
    w AS (SELECT lang, 0::BIGINT AS i, 0::BIGINT AS total, -1::BIGINT AS doc_id, false AS taken FROM (SELECT DISTINCT lang FROM o)
        UNION ALL SELECT o.lang, o.i, CASE WHEN total + tokens <= 5000 THEN total + tokens ELSE total END, o.doc_id, total + tokens <= 5000 FROM w JOIN o ON o.lang IS NOT DISTINCT FROM w.lang AND o.i = w.i + 1)
    SELECT doc_id, lang FROM w WHERE taken""")
def budget_skip(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", F.floor(F.col("n_chars") / 4).alias("tokens")).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return retrieval.budget_skip(rows, "lang", [F.desc("quality"), F.col("doc_id")], "tokens", 5_000).select("doc_id", "lang")


@query("""WITH s AS (SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles FROM conversations GROUP BY 1),
    p AS (SELECT conv_id, CASE WHEN turns < 3 THEN 'exploration' WHEN turns > 6 THEN 'refinement' ELSE 'development' END AS phase, CASE WHEN roles = 3 THEN 'expert' WHEN roles = 1 THEN 'basic' ELSE 'intermediate' END AS level FROM s)
    SELECT conv_id, greatest(least(floor(floor(10000 * CASE phase WHEN 'exploration' THEN 1.2 WHEN 'refinement' THEN 0.8 ELSE 1.0 END::DOUBLE) * CASE level WHEN 'expert' THEN 0.7 WHEN 'basic' THEN 1.3 ELSE 1.0 END::DOUBLE), 20000), 5000)::BIGINT AS budget FROM p""")
def session_token_budget(spark, d):
    s = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("role").alias("roles"))
    phase = F.when(F.col("turns") < 3, "exploration").when(F.col("turns") > 6, "refinement").otherwise("development")
    level = F.when(F.col("roles") == 3, "expert").when(F.col("roles") == 1, "basic").otherwise("intermediate")
    return s.select("conv_id", retrieval.session_budget(F.lit(10_000), phase, level).alias("budget"))


@query("""WITH m AS (SELECT *, count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
    c AS (SELECT event_id, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS failures FROM m)
    SELECT event_id, failures, CASE WHEN failures >= 2 THEN 'open' ELSE 'closed' END AS state FROM c""")
def circuit_breaker(spark, d):
    return reliability.circuit_states(table(spark, d, "events"), "user_id", ["ts", "event_id"], failed(), 2).select("event_id", "failures", "state")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts, event_id) <= 3")
def alert_rate_limit(spark, d):
    return reliability.limited_alerts(table(spark, d, "events").where(failed()), ["event_type"], "ts", "event_id", "day", 3).select("event_id", "event_type")


@query("""WITH b AS (SELECT *, min(CASE WHEN event_type <> 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS back FROM events)
    SELECT user_id, count(*) AS failures, count(back) AS recovered, round(avg((epoch_us(back) - epoch_us(ts)) / 60000000.0::DOUBLE), 6) AS minutes FROM b WHERE event_type = 'error' GROUP BY 1""")
def recovery_time(spark, d):
    return reliability.recovery_minutes(table(spark, d, "events"), "user_id", "ts", "event_id", failed())


@query("""SELECT count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (WHERE event_type = 'error') / nullif(count(*), 0), 6) AS failure_rate, round(avg(value), 6) AS average, round(max(value), 6) AS largest, round(min(value), 6) AS smallest
    FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""")
def metrics_trailing(spark, d):
    return reliability.trailing(table(spark, d, "events"), "ts", "value", failed(), 24)


@query("""WITH l AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)
    SELECT event_type, v[least(floor(len(v) * 0.5::DOUBLE)::BIGINT + 1, len(v))] AS p50, v[least(floor(len(v) * 0.95::DOUBLE)::BIGINT + 1, len(v))] AS p95 FROM l""")
def cache_percentiles(spark, d):
    return reliability.nearest_percentiles(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query("""WITH a AS (SELECT event_type, avg(value) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS b, avg(value) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS c FROM events GROUP BY 1)
    SELECT event_type, round(b, 6) AS baseline, round(c, 6) AS current, round(100 * (c - b) / nullif(b, 0), 6) AS change_percent FROM a""")
def baseline_comparison(spark, d):
    return reliability.against_baseline(table(spark, d, "events"), "event_type", "value", F.expr("ts >= timestamp_ntz'2024-01-16'"))


@query("""WITH m AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS stop FROM events) SELECT event_id, user_id FROM m WHERE stop = 0""")
def loop_break(spark, d):
    return reliability.until_flag(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase").select("event_id", "user_id")


@query("""SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS index, unnest(list_transform(string_split(text, chr(10)), lambda s: length(s))) AS length FROM documents WHERE text IS NOT NULL""")
def foreach_line(spark, d):
    """Each line of each text with its position, all of them."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("index", "line")).select("doc_id", "index", F.length("line").alias("length"))


_PATHS = f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({_TRANSITIONS}) WHERE dst IS NOT NULL),
    p AS (SELECT [src, dst] AS path FROM e WHERE src <> dst UNION ALL SELECT list_append(path, e.dst) FROM p JOIN e ON e.src = path[-1] WHERE NOT list_contains(path, e.dst) AND len(path) < {{nodes}})"""


@query(_PATHS.format(nodes=4) + " SELECT array_to_string(path, '>') AS path, len(path) AS nodes FROM p")
def transition_paths(spark, d):
    found = paths.simple_paths(_transitions(spark, d).distinct(), 3)
    return found.select(F.array_join("path", ">").alias("path"), F.size("path").alias("nodes"))


@query(_PATHS.format(nodes=4) + """, c AS (SELECT path FROM p JOIN e ON e.src = path[-1] AND e.dst = path[1] WHERE path[1] = list_min(path) UNION ALL SELECT [src] FROM e WHERE src = dst)
    SELECT array_to_string(path, '>') AS cycle, len(path) AS length, CASE WHEN len(path) = 2 THEN 'warning' ELSE 'error' END AS severity FROM c""")
def transition_all_cycles(spark, d):
    return paths.cycles(_transitions(spark, d).distinct(), 4)


@query("""WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
    l AS (SELECT DISTINCT src AS node, 0 AS level FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, level + 1 FROM l JOIN e ON e.src = l.node) SELECT node, max(level) AS level FROM l GROUP BY 1""")
def topo_levels(spark, d):
    return paths.topo_levels(_hierarchy(spark, d), 3)


@query("""SELECT c_custkey, c_name || ' in ' || c_nationkey || ': <tier>' AS label, c_custkey AS key FROM customer""")
def template_render(spark, d):
    fields = {"name": F.col("c_name"), "nation": F.col("c_nationkey"), "key": F.col("c_custkey")}
    return table(spark, d, "customer").select("c_custkey", render("{{ name }} in {{nation}}: {{tier}}", fields).alias("label"), render("{{key}}", fields).alias("key"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substring(text, 1, 97) || '...' ELSE text END AS summary FROM documents")
def state_summary(spark, d):
    return table(spark, d, "documents").select("doc_id", shortened(F.col("text")).alias("summary"))


@query("""WITH k AS (SELECT event_id, value, regexp_extract(props, '([0-9]+)', 1) AS s FROM events)
    SELECT event_id, coalesce(TRY_CAST(s AS DOUBLE), 0) < value AS below, event_id / nullif(TRY_CAST(s AS DOUBLE), 0) IS NULL AS unbounded, s || event_id AS joined FROM k""")
def expr_numbers(spark, d):
    """Comparison of text and number as numbers, division by zero, ``+`` of text and number."""
    s = F.regexp_extract("props", "([0-9]+)", 1)
    quotient = X.divide(F.col("event_id"), X.to_number(s))
    return table(spark, d, "events").select("event_id", X.less(X.to_number(s), F.col("value")).alias("below"), quotient.isin(float("inf"), float("-inf")).alias("unbounded"), F.concat(s, F.col("event_id").cast("string")).alias("joined"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w, p_name FROM part)
    SELECT p_partkey, contains(p_name, 'widget') AS includes, starts_with(p_name, 'cold') AS starts, array_to_string(w[2:], ',') AS rest, list_contains(w, 'bolt') AS has, len(list_filter(w, lambda x: length(x) > 4)) AS long_words, upper(w[1]) AS head FROM w""")
def expr_arrays(spark, d):
    w = F.split("p_name", " ")
    return table(spark, d, "part").select(
        "p_partkey", F.col("p_name").contains("widget").alias("includes"), F.col("p_name").startswith("cold").alias("starts"), F.array_join(X.sliced(w, 1), ",").alias("rest"),
        F.array_contains(w, "bolt").alias("has"), F.size(F.filter(w, lambda x: F.length(x) > 4)).alias("long_words"), F.upper(F.get(w, F.lit(0))).alias("head"),
    )


@query("""WITH s AS (SELECT page_id, string_split(html, chr(10)) AS v FROM pages), l AS (SELECT page_id, unnest(range(1, len(v) + 1)) AS line_no, unnest(v) AS line FROM s)
    SELECT page_id AS file, line_no, CASE WHEN contains(line, '.track(') THEN 'call' ELSE 'usage' END AS kind, CASE WHEN contains(line, '.track(') THEN 0.8 ELSE 0.7 END::DOUBLE AS confidence FROM l WHERE regexp_matches(line, '(^|[^A-Za-z0-9_$])track([^A-Za-z0-9_$]|$)')""")
def find_references(spark, d):
    """Where pages' scripts call a function."""
    return code.references(table(spark, d, "pages"), "page_id", "html", "track").select("file", "line_no", "kind", "confidence")


@query("SELECT CASE WHEN n_chars < 1024 THEN 'small' WHEN n_chars < 102400 THEN 'medium' ELSE 'large' END AS size, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def size_distribution(spark, d):
    size = F.when(F.col("n_chars") < 1024, "small").when(F.col("n_chars") < 102_400, "medium").otherwise("large")
    return table(spark, d, "documents").groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT user_id, arg_min(props, (ts, event_id)) AS first_write, arg_max(props, (ts, event_id)) AS last_write, count(*) AS version FROM events GROUP BY 1")
def conflict_resolution(spark, d):
    """Writes to a key, resolved by first and by last writer."""
    at = F.struct("ts", "event_id")
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("props", at).alias("first_write"), F.max_by("props", at).alias("last_write"), F.count(F.lit(1)).alias("version"))


@query("""WITH f AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_type, CASE WHEN epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER w > 86400000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS nth FROM f)
    SELECT user_id, min(ms) AS began_ms, max(ms) AS last_ms, count(*) AS n, count(DISTINCT event_type) AS kinds FROM s GROUP BY user_id, nth""")
def stream_sessions(spark, d):
    """Sessions of a day's silence, kept as keyed state of a stream over the events until its end."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, session_state.PROVIDER)
    try:
        events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
        states = session_state.session_states(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "event_type", idle_ms=86_400_000, late="1 day")
        told = session_state.drained(spark, states, new_folder(spark, "sessions"))
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    last = told.groupBy("key", "began_ms").agg(F.max("last_ms").alias("last_ms"), F.max("n").alias("n"), F.max("kinds").alias("kinds"))
    return last.withColumnRenamed("key", "user_id")
