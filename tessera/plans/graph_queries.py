"""Graphs of any shape: components, witnesses and reach kept up by differences.

Parts that follow one another within an order, the second in small quantity, make a graph with one large component, small ones and tails.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import components, concurrency, graph, migration, reach
from tessera.plans.registry import query, table


def part_graph(spark, d):
    """``src, dst``: from a part to the next one of its order that is bought three times or less."""
    nth = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    lines = table(spark, d, "lineitem").select("l_partkey", "l_quantity", F.lag("l_partkey").over(nth).alias("src"))
    return lines.where("l_quantity <= 3 and src is not null").select("src", F.col("l_partkey").alias("dst"))


_PARTS = """e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS dst, l_quantity, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS src FROM lineitem) WHERE l_quantity <= 3 AND src IS NOT NULL),
    n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst),
    c AS (SELECT node, coalesce(least(node, min(there.dst)), node) AS component FROM n LEFT JOIN (SELECT a.src, a.dst FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src) there ON there.src = node GROUP BY node),
    s AS (SELECT node, component, count(*) OVER (PARTITION BY component) AS nodes FROM c)"""


@query(f"WITH RECURSIVE {_PARTS} SELECT node, component, nodes FROM s")
def strong_components(spark, d):
    """Each part's component."""
    return components.strong_components(part_graph(spark, d))


@query(f"""WITH RECURSIVE {_PARTS}, i AS (SELECT s.component, s.nodes, e.src, e.dst FROM e JOIN s ON s.node = e.src JOIN s t ON t.node = e.dst AND t.component = s.component),
    w AS (SELECT component, dst AS place, 1 AS hops FROM i WHERE src = component UNION SELECT w.component, i.dst, hops + 1 FROM w JOIN i ON i.src = w.place AND i.component = w.component WHERE w.place <> w.component AND hops < 100)
    SELECT component, any_value(nodes) AS nodes, min(hops)::BIGINT AS length, CASE WHEN any_value(nodes) <= 2 THEN 'warning' ELSE 'error' END AS severity
    FROM w JOIN (SELECT DISTINCT component, nodes FROM s) USING (component) WHERE place = component GROUP BY 1""")
def component_cycles(spark, d):
    """Components that hold a cycle, with the length of a shortest one through their smallest part."""
    return components.component_summary(part_graph(spark, d))


def _owners(spark, d):
    """``src, dst, kind``: orders to customers, customers to nations, nations to regions; customers in debt are dealt to the next nation."""
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    orders, customer, nation = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    kept = orders.select(node("o", "o_orderkey").alias("src"), node("c", "o_custkey").alias("dst"), F.lit("kept").alias("kind"))
    kept = kept.unionByName(nation.select(node("n", "n_nationkey").alias("src"), node("r", "n_regionkey").alias("dst"), F.lit("kept").alias("kind")))
    debt = F.col("c_acctbal") < -500
    home = customer.select(node("c", "c_custkey").alias("src"), node("n", "c_nationkey").alias("dst"), F.when(debt, "removed").otherwise("kept").alias("kind"))
    moved = customer.where(debt).select(node("c", "c_custkey").alias("src"), F.concat(F.lit("n"), ((F.col("c_nationkey") + 1) % 25).cast("string")).alias("dst"), F.lit("added").alias("kind"))
    return kept.unionByName(home).unionByName(moved)


_OWNERS = """e AS (SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'kept' AS kind FROM orders UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'kept' FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, CASE WHEN c_acctbal < -500 THEN 'removed' ELSE 'kept' END FROM customer UNION ALL SELECT 'c' || c_custkey, 'n' || (c_nationkey + 1) % 25, 'added' FROM customer WHERE c_acctbal < -500),
    a AS (SELECT DISTINCT src, dst FROM e WHERE kind <> 'added'), b AS (SELECT DISTINCT src, dst FROM e WHERE kind <> 'removed'),
    ra AS (SELECT src, dst FROM a UNION SELECT ra.src, a.dst FROM ra JOIN a ON a.src = ra.dst), rb AS (SELECT src, dst FROM b UNION SELECT rb.src, b.dst FROM rb JOIN b ON b.src = rb.dst)"""


def _changes(spark, d):
    edges = _owners(spark, d)
    old = edges.where("kind <> 'added'")
    kept = graph.closure(old).select("src", "dst")
    return kept, reach.reach_changes(kept, old, edges.where("kind = 'added'"), edges.where("kind = 'removed'"))


@query(f"""WITH RECURSIVE {_OWNERS} SELECT coalesce(ra.src, rb.src) AS src, coalesce(ra.dst, rb.dst) AS dst, CASE WHEN ra.src IS NULL THEN 'added' ELSE 'removed' END AS change
    FROM ra FULL JOIN rb ON ra.src = rb.src AND ra.dst = rb.dst WHERE ra.src IS NULL OR rb.src IS NULL""")
def reach_changes(spark, d):
    """What a batch of removed and added edges changes in who reaches whom."""
    return _changes(spark, d)[1]


@query(f"WITH RECURSIVE {_OWNERS} SELECT dst, count(*) AS dependents FROM rb GROUP BY 1")
def reach_after(spark, d):
    """Dependents of each node after the batch, from the kept reach and its changes."""
    return reach.applied(*_changes(spark, d)).groupBy("dst").agg(F.count(F.lit(1)).alias("dependents"))


@query("""WITH o AS (SELECT event_type AS kind, ts AS b, ts + to_microseconds((value * 60000000)::BIGINT) AS e FROM events WHERE value IS NOT NULL),
    m AS (SELECT kind, t, sum(s) AS s FROM (SELECT kind, b AS t, 1 AS s FROM o UNION ALL SELECT kind, e, -1 FROM o) GROUP BY ALL HAVING sum(s) <> 0),
    l AS (SELECT kind, sum(s) OVER w AS level, (epoch_us(lead(t) OVER w) - epoch_us(t)) / 1000.0::DOUBLE AS ms FROM m WINDOW w AS (PARTITION BY kind ORDER BY t)), x AS (SELECT kind, level, sum(ms) AS ms FROM l GROUP BY ALL)
    SELECT kind, max(level)::BIGINT AS most, round(arg_max(ms, level), 3) AS most_ms, round(sum(ms) FILTER (WHERE level > 0), 3) AS busy_ms FROM x GROUP BY 1""")
def most_at_once(spark, d):
    """Operations of each kind that run at once; an event runs for as many minutes as its value tells."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, d, "events").where("value is not null")
    runs = events.select(F.col("event_type").alias("kind"), F.timestamp_micros(micros).alias("b"), F.timestamp_micros(micros + F.rint(F.col("value") * 60_000_000).cast("long")).alias("e"))
    return concurrency.most_at_once(runs, "kind", "b", "e")


_STEPS = """s AS (SELECT s_nationkey AS src, c_nationkey AS dst, 1 + floor(min(l_extendedprice) / 50)::BIGINT AS cost FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE s_nationkey <> c_nationkey GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_STEPS}, w AS (SELECT src, dst, cost, 1 AS n FROM s UNION SELECT w.src, s.dst, min(w.cost + s.cost), n + 1 FROM w JOIN s ON s.src = w.dst WHERE n < 8 AND s.dst <> w.src GROUP BY w.src, s.dst, n)
    SELECT src, dst, min(cost)::BIGINT AS cost, arg_min(n, (cost, n))::BIGINT AS steps FROM w GROUP BY 1, 2""")
def cheapest_ways(spark, d):
    """Cheapest ways from nation to nation; a step costs as much as the cheapest delivery between the two."""
    line, supplier, orders, customer = (table(spark, d, t) for t in ("lineitem", "supplier", "orders", "customer"))
    sent = line.join(supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(customer, F.col("c_custkey") == F.col("o_custkey")).where("s_nationkey <> c_nationkey")
    steps = sent.groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg((1 + F.floor(F.min("l_extendedprice") / 50)).alias("cost"))
    return migration.cheapest_ways(steps).select("src", "dst", "cost", (F.size("way") - 1).cast("long").alias("steps"))
