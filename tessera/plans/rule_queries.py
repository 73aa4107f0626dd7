"""Rule retrieval and session context over rules and visits derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import context as C
from tessera.operators import rules as R
from tessera.plans.registry import query, table

# parts as rules: their brand, type and size make pattern, complexity and kind
_RULES = """SELECT p_partkey AS rule_id, p_name AS rule, p_type || ' rule of ' || p_brand || ' for ' || p_name AS context, p_brand || ':' || p_type || ':' || p_size % 3 AS pattern,
    CASE p_size % 4 WHEN 0 THEN 'basic' WHEN 1 THEN 'intermediate' ELSE 'advanced' END AS complexity, CASE WHEN p_size % 2 = 0 THEN 'must' ELSE 'should' END AS rule_type, p_size::BIGINT AS small, p_size * 4 AS full FROM part"""


def rules_of(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("rule_id"), F.col("p_name").alias("rule"), F.concat_ws(" ", "p_type", F.lit("rule of"), "p_brand", F.lit("for"), "p_name").alias("context"), F.concat_ws(":", "p_brand", "p_type", size % 3).alias("pattern"),
        F.when(size % 4 == 0, "basic").when(size % 4 == 1, "intermediate").otherwise("advanced").alias("complexity"), F.when(size % 2 == 0, "must").otherwise("should").alias("rule_type"), size.cast("long").alias("small"), (size * 4).alias("full"),
    )


_HYBRID = f"""WITH r AS ({_RULES}), n AS (SELECT *, count(*) OVER (PARTITION BY pattern) AS few, count(*) OVER (PARTITION BY pattern, complexity) AS fewer FROM r),
    g AS (SELECT *, CASE WHEN few = 1 THEN 'individual' WHEN few <= 3 THEN 'pattern_group' WHEN fewer <= 3 THEN 'mixed_group' ELSE 'individual' END AS kind FROM n),
    h AS (SELECT *, CASE kind WHEN 'pattern_group' THEN pattern WHEN 'mixed_group' THEN pattern || '_' || complexity ELSE 'rule:' || rule_id END AS grp FROM g)"""


@query(f'{_HYBRID} SELECT rule_id, kind, grp AS "group" FROM h')
def rule_grouping(spark, d):
    return R.grouped(rules_of(spark, d)).select("rule_id", "kind", "group")


@query(f"""WITH r AS ({_RULES}), c AS (SELECT rule_id, complexity, array_to_string(string_split(context, ' ')[:5], ' ') AS words FROM r)
    SELECT rule_id, CASE WHEN count(*) OVER (PARTITION BY complexity) = 1 THEN 'individual' ELSE 'complexity_group' END AS by_complexity, CASE WHEN count(*) OVER (PARTITION BY words) = 1 THEN 'rule:' || rule_id ELSE words END AS by_context FROM c""")
def rule_grouping_plain(spark, d):
    by = {s: R.grouped(rules_of(spark, d), s) for s in ("complexity", "context")}
    return by["complexity"].select("rule_id", F.col("kind").alias("by_complexity")).join(by["context"].select("rule_id", F.col("group").alias("by_context")), "rule_id")


_PAYLOADS = f"""{_HYBRID}, p AS (SELECT kind, grp, count(*) AS rules, min(context) AS lo, max(context) AS hi, min(rule_id) AS first, sum(small)::BIGINT AS own FROM h GROUP BY 1, 2),
    q AS (SELECT *, substring(lo, 1, coalesce(list_max(list_filter(range(1, length(lo) + 1), lambda i: substring(lo, 1, i) = substring(hi, 1, i))), 0)) AS prefix FROM p),
    t AS (SELECT kind, grp, rules, CASE WHEN rules = 1 THEN lo WHEN contains(prefix, ' ') THEN regexp_replace(prefix, ' [^ ]*$', '') ELSE prefix END AS common_context, first,
      CASE WHEN kind = 'individual' THEN own ELSE least(50 + floor(rules * 30 * CASE kind WHEN 'pattern_group' THEN 0.8 ELSE 0.85 END::DOUBLE), own) END::BIGINT AS tokens FROM q)"""


@query(f"""{_PAYLOADS} SELECT kind, grp AS "group", rules, common_context, p_name AS best_example, tokens FROM t JOIN part ON p_partkey = first""")
def rule_payloads(spark, d):
    """Groups with their common context, best example and token estimate."""
    rules = R.grouped(rules_of(spark, d)).withColumn("none", F.lit(None).cast("string"))
    return R.group_payloads(rules, F.col("small"), "rule", "none", "none")


@query(f"""{_HYBRID}, i AS (SELECT p_partkey AS rule_id, unnest(string_split(p_name, ' ')) AS name, './' || p_brand AS module FROM part), s AS (SELECT grp, count(*) AS n FROM h GROUP BY 1)
    SELECT grp AS "group", name, module FROM h JOIN i USING (rule_id) JOIN s USING (grp) GROUP BY grp, name, module, n HAVING count(DISTINCT rule_id) = n""")
def rule_common_imports(spark, d):
    imports = table(spark, d, "part").select(F.col("p_partkey").alias("rule_id"), F.explode(F.split("p_name", " ")).alias("name"), F.concat(F.lit("./"), "p_brand").alias("module"))
    return R.common_imports(R.grouped(rules_of(spark, d)), imports)


@query("""WITH RECURSIVE o AS (SELECT p_brand, p_partkey, CASE WHEN p_size % 3 = 0 THEN 'pattern_group' ELSE 'individual' END AS kind, CASE WHEN p_size % 3 = 0 THEN 4 ELSE 1 END AS rules, p_size::BIGINT AS tokens, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
    w AS (SELECT p_brand, 0::BIGINT AS i, 0::BIGINT AS total, false AS over, 0::BIGINT AS key, 0::BIGINT AS taken_rules, 0::BIGINT AS taken_tokens, false AS partial FROM (SELECT DISTINCT p_brand FROM o)
      UNION ALL SELECT o.p_brand, o.i, total + CASE WHEN over OR (kind = 'individual' AND total + tokens > 60) THEN 0 WHEN total + tokens <= 60 THEN tokens ELSE floor(floor((60 - total) / (tokens / rules)) * (tokens / rules))::BIGINT END,
        over OR (kind <> 'individual' AND total + tokens > 60), p_partkey, CASE WHEN over OR (kind = 'individual' AND total + tokens > 60) THEN 0 WHEN total + tokens <= 60 THEN rules ELSE floor((60 - total) / (tokens / rules))::BIGINT END,
        CASE WHEN over OR (kind = 'individual' AND total + tokens > 60) THEN 0 WHEN total + tokens <= 60 THEN tokens ELSE floor(floor((60 - total) / (tokens / rules)) * (tokens / rules))::BIGINT END,
        NOT over AND kind <> 'individual' AND total + tokens > 60 FROM w JOIN o ON o.p_brand = w.p_brand AND o.i = w.i + 1)
    SELECT key AS p_partkey, taken_rules, taken_tokens, partial FROM w WHERE taken_rules > 0""")
def group_budget(spark, d):
    """Groups by budget: individuals that don't fit are skipped, the first group that doesn't is taken in part and ends it."""
    third = F.col("p_size") % 3 == 0
    groups = table(spark, d, "part").select("p_brand", "p_partkey", F.when(third, "pattern_group").otherwise("individual").alias("kind"), F.when(third, 4).otherwise(1).cast("long").alias("rules"), F.col("p_size").cast("long").alias("tokens"))
    return R.fit_groups(groups, "p_brand", ["p_partkey"], 60).select("p_partkey", "taken_rules", "taken_tokens", "partial")


@query(f"""WITH r AS ({_RULES}), u AS (SELECT pattern, count(*) AS uses FROM r WHERE rule_id % 2 = 0 GROUP BY 1), k AS (SELECT r.*, CASE WHEN uses >= 5 THEN 'expert' WHEN uses >= 3 THEN 'familiar' WHEN uses >= 1 THEN 'novice' ELSE 'new' END AS known FROM r LEFT JOIN u USING (pattern))
    SELECT rule_id, known, CASE WHEN rule_id % 5 = 0 THEN 'reference' WHEN known = 'expert' THEN 'expert' WHEN known IN ('familiar', 'novice') THEN 'familiar' ELSE 'first_time' END AS strategy,
    CASE WHEN rule_type = 'must' THEN 10 ELSE 5 END + CASE WHEN complexity = 'basic' THEN 3 ELSE 0 END + CASE known WHEN 'new' THEN 5 WHEN 'novice' THEN 2 ELSE 0 END::DOUBLE AS priority,
    CASE WHEN rule_type = 'must' AND small > 40 THEN 'minimal' WHEN complexity = 'advanced' THEN 'detailed' ELSE 'standard' END AS detail FROM k""")
def rule_compression(spark, d):
    """How well each rule's pattern is known, the way it is shown, its priority and level of detail."""
    rules = rules_of(spark, d)
    uses = rules.where("rule_id % 2 = 0").groupBy("pattern").agg(F.count(F.lit(1)).alias("uses"))
    known = rules.join(uses, "pattern", "left").withColumn("known", R.familiarity(F.col("uses")))
    task = F.when((F.col("rule_type") == "must") & (F.col("small") > 40), "debugging").otherwise("feature_development")
    return known.select(
        "rule_id", "known", R.compression(F.col("rule_id") % 5 == 0, F.col("known")).alias("strategy"), R.priority_score(F.col("rule_type"), F.col("complexity") == "basic", F.col("known")).alias("priority"),
        R.detail_level(task, F.lit("basic"), F.col("complexity"), F.lit("implementation")).alias("detail"),
    )


@query(f"""WITH r AS ({_RULES}) SELECT complexity, count(*) AS rules, sum("full")::BIGINT AS original, sum(small)::BIGINT AS compressed, round(1 - sum(small) / sum("full"), 6) AS saved FROM r GROUP BY ROLLUP (complexity)""")
def compression_stats(spark, d):
    return R.compression_stats(rules_of(spark, d), "complexity", "full", "small")


@query("""WITH v AS (SELECT event_id, event_type, props, user_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS n FROM events), x AS (SELECT event_id, event_type, n, user_id, [event_type || props, event_type, 'x'] AS falling, ['x', event_type, event_type || props] AS rising FROM v)
    SELECT event_id, CASE WHEN event_type = 'signup' THEN 'rule ' || event_id WHEN user_id % 2 = 0 THEN rising[least(n, 2) + 1] ELSE falling[least(n, 2) + 1] END AS example FROM x""")
def visit_examples(spark, d):
    """Shorter examples with each visit, for experts longer ones; signups have no example, so the rule itself is shown."""
    from tessera.operators.sessions import visits_so_far

    seen = visits_so_far(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    given = lambda x: F.when(F.col("event_type") != "signup", x)
    examples = [given(F.col("event_type")), given(F.lit("x")), given(F.concat("event_type", "props")), F.lit(" ")]
    rule = F.concat(F.lit("rule "), F.col("event_id").cast("string"))
    return seen.select("event_id", R.example_for(examples, F.col("visits"), F.col("user_id") % 2 == 0, rule).alias("example"))


@query("""SELECT rule_id, score FROM (SELECT p_partkey AS rule_id, p_retailprice * CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08) THEN 0.7 ELSE 1 END::DOUBLE AS score, p_partkey FROM part) WHERE rule_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_tax > 0.07)""")
def rules_to_show(spark, d):
    """Rules that aren't loaded, those that a linter covers with a lower score."""
    items = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "rule_id")
    rules = table(spark, d, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_retailprice").alias("score"))
    fresh = R.not_loaded(rules, items.where("l_tax > 0.07").select("rule_id").distinct(), ["rule_id"])
    return R.demoted(fresh, items.where("l_discount > 0.08"), "rule_id", "score")


@query("""SELECT p_partkey, least(30, p_size)::BIGINT AS minimal, least(150, greatest(least(30, p_size), p_size * 2))::BIGINT AS standard, least(300, greatest(least(150, greatest(least(30, p_size), p_size * 2)), p_size * 9))::BIGINT AS full,
    'part-' || lower(replace(p_type, ' ', '-')) AS standard_id FROM part""")
def rule_tokens(spark, d):
    """Capped token counts and ids from paths."""
    n = F.col("p_size")
    path = F.concat(F.lit("standards/part/"), F.replace("p_type", F.lit(" "), F.lit("/")), F.lit(".md"))
    return table(spark, d, "part").select("p_partkey", *[c.alias(k) for k, c in R.capped_tokens({"minimal": n, "standard": n * 2, "full": n * 9}).items()], R.standard_id(path, "standards").alias("standard_id"))


@query("""WITH s AS (SELECT p_brand, list_sort(list(DISTINCT p_type)) AS t FROM part GROUP BY 1) SELECT array_to_string(t, ',') AS targets, count(*) AS rules, min(p_brand) AS first_rule FROM s GROUP BY 1""")
def rules_by_targets(spark, d):
    """Rules with the same set of patterns."""
    sets = table(spark, d, "part").groupBy(F.col("p_brand").alias("rule_id")).agg(F.collect_set("p_type").alias("t"))
    return R.same_targets(sets, "t")


@query("""WITH i AS (SELECT DISTINCT p_brand AS id FROM part UNION SELECT 'Brand#1'), n AS (SELECT DISTINCT p_brand || '/' || p_type AS name FROM part) SELECT name, arg_max(id, length(id)) AS standard FROM n JOIN i ON starts_with(name, id) GROUP BY 1""")
def rule_standards(spark, d):
    """Each rule's standard: the longest id that its name begins with."""
    part = table(spark, d, "part")
    ids = part.select(F.col("p_brand").alias("standard")).union(spark.createDataFrame([("Brand#1",)], "standard string"))
    return R.by_prefix(part.select(F.concat_ws("/", "p_brand", "p_type").alias("name")).distinct(), "name", ids, "standard")


@query("""SELECT p_partkey, p_name AS rule, coalesce(CASE WHEN p_size > 25 THEN p_type END, 'general') AS context, 'should' AS rule_type, 'basic' AS complexity FROM part""")
def converted_hints(spark, d):
    """Old hints in the new shape, defaults for what they lack."""
    old = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("rule"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("context"))
    return R.converted_hints(old, {"context": "general", "rule_type": "should", "complexity": "basic"})


@query("""SELECT p_brand, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY 1""")
def import_map(spark, d):
    """One import statement for each module, the first."""
    return R.merged_imports(table(spark, d, "part"), "p_brand", "p_name", "p_partkey")


@query("""WITH s AS (SELECT *, sum(p_size) OVER (PARTITION BY p_brand) - 300 AS excess, coalesce(sum(p_size - least(5, p_size)) OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS saved FROM part)
    SELECT p_partkey, CASE WHEN saved < excess THEN least(5, p_size) ELSE p_size END::INT AS final FROM s""")
def largest_first(spark, d):
    """Largest texts shrink first until the group fits."""
    rows = table(spark, d, "part").select("p_brand", "p_partkey", "p_size", F.lit(5).alias("least"))
    return R.reduced_to(rows, "p_brand", "p_partkey", "p_size", "least", 300).select("p_partkey", "final")


# events as visits to files: their type and key name the file
_VISITS = """SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 'src/app/api/route.ts' WHEN 'click' THEN 'src/components/b' || event_id % 4 || '.tsx' WHEN 'view' THEN 'lib/utils/f' || event_id % 3 || '.ts' WHEN 'purchase' THEN 'db/schema/migration.sql' ELSE 'src/debug/log.js' END AS file FROM events"""


def visits_of(spark, d):
    kind, k = F.col("event_type"), F.col("event_id")
    file = (
        F.when(kind == "error", "src/app/api/route.ts").when(kind == "click", F.concat(F.lit("src/components/b"), k % 4, F.lit(".tsx"))).when(kind == "view", F.concat(F.lit("lib/utils/f"), k % 3, F.lit(".ts")))
        .when(kind == "purchase", "db/schema/migration.sql").otherwise("src/debug/log.js")
    )
    return table(spark, d, "events").select("user_id", "ts", "event_id", file.alias("file"))


_PATTERNS = f"""WITH v AS ({_VISITS}), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM v),
    f AS (SELECT user_id, max(n) >= 3 AS refactoring FROM (SELECT user_id, file, count(*) AS n FROM k WHERE nth <= 20 GROUP BY ALL) GROUP BY 1),
    b AS (SELECT user_id, (count(DISTINCT file) = 1 AND count(*) > 1) OR bool_or(contains(lower(file), 'error') OR contains(lower(file), 'debug')) AS debugging FROM k WHERE nth <= 3 GROUP BY 1)"""


@query(f"{_PATTERNS} SELECT user_id, refactoring, debugging FROM f JOIN b USING (user_id)")
def visit_patterns(spark, d):
    return C.visit_patterns(visits_of(spark, d), "user_id", "file", ["ts", "event_id"])


@query(f"""{_PATTERNS}, s AS (SELECT user_id, count(*) AS files, bool_or(nth <= 6 AND file LIKE '%.sql') AS has_sql, bool_or(nth <= 6 AND file = 'src/app/api/route.ts') AS has_api, bool_or(file LIKE '%.tsx') AS has_tsx, bool_or(file LIKE '%.ts' OR file LIKE '%.tsx') AS has_ts, bool_or(file LIKE '%app/%') AS has_app FROM k WHERE nth <= 20 GROUP BY 1)
    SELECT user_id, CASE WHEN has_api THEN 'api_development' WHEN has_sql THEN 'database' WHEN refactoring THEN 'refactoring' WHEN debugging THEN 'debugging' ELSE 'feature_development' END AS task,
    CASE WHEN files < 3 THEN 'basic' WHEN files < 10 THEN 'intermediate' WHEN files < 20 THEN 'advanced' ELSE 'expert' END AS level, CASE WHEN files < 3 THEN 'exploration' ELSE 'learning' END AS phase,
    has_tsx AS react, has_app AS nextjs, has_ts AS typescript, false AS tailwind, false AS prisma, has_app AS api_routes, has_app AS server_components, false AS client_components FROM s JOIN f USING (user_id) JOIN b USING (user_id)""")
def session_context(spark, d):
    """Task, level, phase and technologies of each session, by the files it has visited."""
    return C.session_context(visits_of(spark, d), "user_id", "file", ["ts", "event_id"])


@query(f"""WITH v AS ({_VISITS}), x AS (SELECT user_id, ts, event_id, string_split(file, '/') AS p, unnest(range(1, len(string_split(file, '/')))) AS depth FROM v),
    c AS (SELECT user_id, array_to_string(p[:depth], '/') AS area, count(*) AS hits, min((ts, event_id, depth)) AS first FROM x GROUP BY ALL) SELECT user_id, area, hits FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY hits DESC, first) = 1""")
def working_area(spark, d):
    return C.working_area(visits_of(spark, d), "user_id", "file", ["ts", "event_id"])


@query(f"""SELECT event_id, CASE WHEN file LIKE '%.tsx' THEN 'presentation' WHEN file LIKE '%/api/%' THEN 'api' WHEN file LIKE '%/utils/%' THEN 'utility' ELSE 'business_logic' END AS layer, CASE WHEN file LIKE '%/app/%' THEN 'app' END AS router,
    file LIKE '%/api/%' AS is_api, NOT (file LIKE '%.tsx' AND event_id % 2 = 0) AS is_server, CASE WHEN file LIKE '%route.ts' THEN 'api_route' ELSE 'component' END AS route, CASE WHEN file LIKE '%/api/%' THEN 'api' WHEN event_id % 2 = 0 THEN 'csr' ELSE 'ssr' END AS rendering FROM ({_VISITS})""")
def route_context(spark, d):
    """Layer and route of each visited file."""
    head = F.when(F.col("event_id") % 2 == 0, "'use client'")
    found = visits_of(spark, d).select("event_id", C.layer(F.col("file")).alias("layer"), C.route_context(F.col("file"), head).alias("c"))
    return found.select("event_id", "layer", "c.*")
