"""State reads, update logs, versions, loops and pages over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import nested_state, paging, state
from tessera.plans.registry import query, table


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS "k.missing", NULL::VARCHAR AS absent FROM events""")
def state_paths(spark, d):
    """Nested reads of a JSON state; missing paths are null."""
    return state.project_paths(table(spark, d, "events"), ["event_id"], "props", ["k", "k.missing", "absent"])


@query("""SELECT c_custkey, c_name AS name, CASE WHEN c_acctbal > 0 THEN 'computed' ELSE c_mktsegment END AS segment, CASE WHEN c_acctbal > 0 THEN 2 ELSE 1 END::INT AS fields FROM customer""")
def state_flat_view(spark, d):
    """Three tiers as one map: computed over inputs over state."""
    pair = lambda k, v: F.create_map(F.lit(k), v)
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    computed = F.when(F.col("c_acctbal") > 0, F.create_map(F.lit("segment"), F.lit("computed"), F.lit("name"), F.col("c_name"))).otherwise(empty)
    view = state.flat_view(pair("segment", F.col("c_mktsegment")), empty, computed)
    return table(spark, d, "customer").select("c_custkey", F.coalesce(view["name"], F.col("c_name")).alias("name"), view["segment"].alias("segment"), F.size(view).alias("fields"))


_LOG = """SELECT user_id, event_id, ts, CASE event_type WHEN 'click' THEN 'state.count' WHEN 'view' THEN 'this.last' WHEN 'purchase' THEN 'inputs.items' WHEN 'signup' THEN 'raw.profile' ELSE 'computed.x' END AS path,
    CASE event_type WHEN 'click' THEN (CASE WHEN event_id % 7 = 0 THEN 'set' ELSE 'increment' END) WHEN 'view' THEN 'set' WHEN 'purchase' THEN 'append' WHEN 'signup' THEN 'merge' ELSE 'set' END AS op,
    CASE WHEN event_type = 'signup' THEN 'f' || event_id % 5 END AS field, CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN NULL ELSE event_id::DOUBLE END AS number, event_type AS text FROM events"""


def _log(spark, d):
    kind = F.col("event_type")
    is_ = lambda name: kind == name
    path = F.when(is_("click"), "state.count").when(is_("view"), "this.last").when(is_("purchase"), "inputs.items").when(is_("signup"), "raw.profile").otherwise("computed.x")
    op = F.when(is_("click"), F.when(F.col("event_id") % 7 == 0, "set").otherwise("increment")).when(is_("purchase"), "append").when(is_("signup"), "merge").otherwise("set")
    number = F.when(~(is_("click") & (F.col("event_id") % 2 == 0)), F.col("event_id").cast("double"))
    return table(spark, d, "events").select("user_id", "event_id", "ts", path.alias("path"), op.alias("op"), F.when(is_("signup"), F.concat(F.lit("f"), F.col("event_id") % 5)).alias("field"), number.alias("number"), kind.alias("text"))


@query(f"""WITH l AS (SELECT * REPLACE (CASE WHEN path = 'this.last' THEN 'state.last' WHEN path = 'raw.profile' THEN 'inputs.profile' ELSE path END AS path) FROM ({_LOG}) WHERE path NOT LIKE 'computed%'),
    s AS (SELECT user_id, path, max((ts, event_id)) AS since FROM l WHERE op = 'set' GROUP BY ALL), v AS (SELECT l.* FROM l LEFT JOIN s USING (user_id, path) WHERE since IS NULL OR (ts, event_id) >= since)
    SELECT user_id, path, NULL AS field, sum(CASE WHEN op = 'set' THEN number WHEN op = 'increment' THEN coalesce(number, 1) END) AS number, max(CASE WHEN op = 'set' THEN text END) AS text, count(*) FILTER (WHERE op = 'append') AS items
    FROM v WHERE op <> 'merge' GROUP BY 1, 2
    UNION ALL SELECT user_id, path, field, arg_max(number, (ts, event_id)), arg_max(text, (ts, event_id)), 0 FROM v WHERE op = 'merge' GROUP BY 1, 2, 3""")
def state_updates(spark, d):
    """An update log folded: set, increment, append and merge; updates of tiers that can't be written are left out."""
    log = _log(spark, d).where(state.writable(F.col("path"))).withColumn("path", state.normal_path(F.col("path")))
    return state.fold_updates(log, "user_id", ["ts", "event_id"])


@query("""WITH b AS (SELECT user_id, date_trunc('day', ts) AS day, bool_and(event_type <> 'error') AS ok FROM events GROUP BY ALL) SELECT event_id FROM events JOIN b ON b.user_id = events.user_id AND day = date_trunc('day', ts) WHERE ok""")
def state_atomic(spark, d):
    """Batches of updates (a user's day) that apply whole or not at all."""
    rows = table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts")).withColumn("path", F.when(F.col("event_type") == "error", "computed.x").otherwise("state.x"))
    return state.atomic_batches(rows, ["user_id", "day"], state.writable(F.col("path"))).select("event_id")


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_id % 4 END AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    w AS (SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS version, NULL::BIGINT AS event_id, false AS accepted FROM (SELECT DISTINCT user_id FROM events)
      UNION ALL SELECT o.user_id, o.i, version + CASE WHEN e IS NULL OR e = version THEN 1 ELSE 0 END, o.event_id, e IS NULL OR e = version FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)
    SELECT event_id, accepted, version FROM w WHERE i > 0""")
def state_versions(spark, d):
    """Optimistic locking: which updates are accepted, and the version after each."""
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") != "view", F.col("event_id") % 4).alias("expected"))
    return state.accepted_updates(rows, "user_id", ["ts", "event_id"], "expected").select("event_id", "accepted", "version")


@query("""WITH h AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events)
    SELECT * FROM h UNION ALL SELECT h.user_id, h.value, (SELECT max(version) FROM h x WHERE x.user_id = h.user_id) + 1 FROM h WHERE version = 3 AND (SELECT max(version) FROM h x WHERE x.user_id = h.user_id) > 3""")
def state_restore(spark, d):
    """History with the state of version 3 put back as a new version."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return state.restored(table(spark, d, "events").select("user_id", "value", nth.alias("version")), "user_id", "version", 3)


@query("""SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN 'local' END, CASE WHEN n_nationkey % 2 = 0 THEN 'loop' END, n_name) AS found FROM nation""")
def scope_lookup(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", state.scoped(F.when(k % 3 == 0, "local"), F.when(k % 2 == 0, "loop"), F.col("n_name")).alias("found"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'credit' ELSE 'debit' END AS branch, abs(c_acctbal) AS amount FROM customer""")
def conditional_steps(spark, d):
    """Rows routed by a condition to one of two steps."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    yes = lambda r: r.select("c_custkey", F.lit("credit").alias("branch"), F.col("c_acctbal").alias("amount"))
    no = lambda r: r.select("c_custkey", F.lit("debit").alias("branch"), (-F.col("c_acctbal")).alias("amount"))
    return state.routed(c, F.col("c_acctbal") > 0, yes, no)


@query("""WITH RECURSIVE w AS (SELECT event_id, value, 0::BIGINT AS iterations FROM events UNION ALL SELECT event_id, value / 2, iterations + 1 FROM w WHERE value >= 1)
    SELECT event_id, min(value) AS value, max(iterations) AS iterations FROM w GROUP BY 1""")
def while_halving(spark, d):
    """A while loop over rows: each is halved until it is below 1."""
    rows = table(spark, d, "events").select("event_id", "value")
    return state.while_loop(rows, F.col("value") >= 1, lambda r: r.withColumn("value", F.col("value") / 2))


@query("""SELECT o_orderkey, o_custkey AS customer, o_orderpriority AS "order.priority", o_totalprice AS "order.price", coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, 'none') AS "order.status", NULL::VARCHAR AS note FROM orders""")
def child_workflow(spark, d):
    """A child's inputs by mapping and by name, its results under its own name, and both flattened to dotted names."""
    parent = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("status"))
    child = state.with_defaults(state.child_inputs(parent, {"customer": "cust"}, ["customer", "priority", "price", "status", "note"], ["o_orderkey"]), {"status": "none"})
    inner = state.namespaced(child, "order", ["o_orderkey", "customer", "note"])
    return state.flattened(inner)


_CHARS = """length(to_json({'doc_id': doc_id, 'lang': lang, 'source': source, 'n_chars': n_chars})::VARCHAR)"""


@query(f"""WITH RECURSIVE o AS (SELECT doc_id, source, {_CHARS} AS chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
    w AS (SELECT source, 0::BIGINT AS i, -1::BIGINT AS page, 0::BIGINT AS used, NULL::BIGINT AS doc_id FROM (SELECT DISTINCT source FROM o)
      UNION ALL SELECT o.source, o.i, CASE WHEN page < 0 OR floor((used + 1 + chars) / 3.5::DOUBLE * 1.1::DOUBLE) > 500 THEN page + 1 ELSE page END,
        CASE WHEN page < 0 OR floor((used + 1 + chars) / 3.5::DOUBLE * 1.1::DOUBLE) > 500 THEN 12 + chars ELSE used + 1 + chars END, o.doc_id FROM w JOIN o ON o.source IS NOT DISTINCT FROM w.source AND o.i = w.i + 1)
    SELECT doc_id, source, page FROM w WHERE i > 0""")
def cursor_page(spark, d):
    """All pages of each source by a budget of JSON tokens, one row at least on each."""
    docs = table(spark, d, "documents").withColumn("chars", paging.json_length("doc_id", "lang", "source", "n_chars"))
    return paging.pages(docs.select("doc_id", "source", "chars"), "source", ["doc_id"], "chars", 500).select("doc_id", "source", "page")


@query(f"""WITH RECURSIVE o AS (SELECT doc_id, {_CHARS} AS chars, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
    w AS (SELECT 0::BIGINT AS i, -1::BIGINT AS page, 0::BIGINT AS used, NULL::BIGINT AS doc_id
      UNION ALL SELECT o.i, CASE WHEN page < 0 OR floor((used + 1 + chars) / 3.5::DOUBLE * 1.1::DOUBLE) > 2000 THEN page + 1 ELSE page END,
        CASE WHEN page < 0 OR floor((used + 1 + chars) / 3.5::DOUBLE * 1.1::DOUBLE) > 2000 THEN 12 + chars ELSE used + 1 + chars END, o.doc_id FROM w JOIN o ON o.i = w.i + 1)
    SELECT doc_id, page FROM w WHERE i > 0""")
def pages_of_one_key(spark, d):
    """All documents as the pages of one response, by jumps: no task holds them all."""
    docs = table(spark, d, "documents").withColumn("chars", paging.json_length("doc_id", "lang", "source", "n_chars"))
    return paging.pages_by_jumps(docs.select("doc_id", F.lit("all").alias("response"), "chars"), "response", ["doc_id"], "chars", 2000).select("doc_id", "page")


@query(f"""WITH o AS (SELECT doc_id, {_CHARS} AS chars FROM documents WHERE doc_id > 10), r AS (SELECT doc_id, sum(chars + 1) OVER (ORDER BY doc_id) - 1 + 12 AS used, row_number() OVER (ORDER BY doc_id) AS n FROM o)
    SELECT doc_id FROM r WHERE n = 1 OR floor(used / 3.5::DOUBLE * 1.1::DOUBLE) <= 700""")
def page_after_cursor(spark, d):
    """The page after a cursor, as large as 700 tokens allow."""
    docs = table(spark, d, "documents").withColumn("chars", paging.json_length("doc_id", "lang", "source", "n_chars"))
    return paging.page_after(docs.select("doc_id", "chars"), "doc_id", "chars", 700, cursor=10).select("doc_id")


@query("""WITH p AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 8 AS page FROM events), q AS (SELECT user_id, page, count(*) AS page_size, max(event_id) AS last FROM p GROUP BY ALL)
    SELECT user_id, page, sum(page_size) OVER w::BIGINT AS total, page_size, CASE WHEN page < max(page) OVER w THEN last END AS next_cursor, page < max(page) OVER w AS has_more FROM q WINDOW w AS (PARTITION BY user_id)""")
def page_summaries(spark, d):
    """The uniform fields of each page's response: total, size, next cursor, more or not."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long") - 1
    return paging.page_summary(table(spark, d, "events").select("user_id", "event_id", F.floor(nth / 8).alias("page")), "user_id", "event_id")


@query("SELECT event_id, user_id FROM events ORDER BY ts, event_id LIMIT 50 OFFSET 100")
def path_page(spark, d):
    """Page 3 of rows that count a hundred tokens each."""
    return paging.path_page(table(spark, d, "events"), ["ts", "event_id"], 3, 5_000).select("event_id", "user_id")


@query(f"""SELECT doc_id, greatest(1, floor({_CHARS} / 3.5::DOUBLE * 1.1::DOUBLE))::BIGINT AS tokens, ({_CHARS} // 4)::BIGINT AS hint_tokens FROM documents""")
def json_tokens(spark, d):
    chars = paging.json_length("doc_id", "lang", "source", "n_chars")
    return table(spark, d, "documents").select("doc_id", paging.token_count(chars).alias("tokens"), paging.hint_tokens(chars).alias("hint_tokens"))


@query("""SELECT user_id, nullif(count(*) FILTER (WHERE event_type = 'click'), 0) AS clicks, nullif(count(*) FILTER (WHERE event_type = 'view'), 0) AS views,
    arg_min(event_id, (ts, event_id)) FILTER (WHERE event_type = 'view') AS first_view, arg_max(event_id, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS purchase,
    arg_max('u' || user_id, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS owner, arg_max(event_id, (ts, event_id)) FILTER (WHERE event_type = 'signup') AS signup,
    arg_max(event_id, (ts, event_id)) FILTER (WHERE event_type = 'error') AS error, nullif(count(*) FILTER (WHERE event_type = 'error'), 0) AS errors FROM events GROUP BY 1""")
def nested_updates(spark, d):
    """A log of set, increment, append and merge below paths that don't exist yet, folded to a document for each user and read by path."""
    kind, i = F.col("event_type"), F.col("event_id").cast("string")
    events = table(spark, d, "events")
    row = lambda when, path, op, value: events.where(kind == when).select("user_id", "ts", "event_id", F.lit(path).alias("path"), F.lit(op).alias("op"), value.alias("value"))
    log = row("click", "state.counters.clicks", "increment", F.lit(None).cast("string")).unionByName(row("view", "state.seen.views", "append", i))
    log = log.unionByName(row("purchase", "state.last.purchase", "set", F.concat(F.lit('{"id": '), i, F.lit(', "by": {"name": "u'), F.col("user_id").cast("string"), F.lit('"}}'))))
    log = log.unionByName(row("signup", "this.profile", "merge", F.concat(F.lit('{"signup": '), i, F.lit("}")))).unionByName(row("error", "state.last", "merge", F.concat(F.lit('{"error": '), i, F.lit("}"))))
    log = log.unionByName(row("error", "state.counters.errors", "increment", F.lit("1")))
    state = nested_state.fold_nested(log, "user_id", ["ts", "event_id"])
    read = lambda path, as_: nested_state.read(F.col("state"), path, as_)
    views = F.size(read("state.seen.views", "array<bigint>"))
    return state.select(
        "user_id", read("state.counters.clicks", "bigint").alias("clicks"), F.when(views > 0, views.cast("long")).alias("views"), read("state.seen.views.0", "bigint").alias("first_view"), read("state.last.purchase.id", "bigint").alias("purchase"),
        read("state.last.purchase.by.name", "string").alias("owner"), read("this.profile.signup", "bigint").alias("signup"), read("state.last.error", "bigint").alias("error"), read("state.counters.errors", "bigint").alias("errors"),
    )
