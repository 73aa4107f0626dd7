"""Validation, blocks of code, graphs and tool reports over texts that are derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.templates import render
from tessera.operators import graph, paths, state, validation
from tessera.operators.tables import spread
from tessera.plans.code_queries import _P, code_files
from tessera.plans.registry import _hierarchy, _transitions, query, table
from tessera.plans.workflow_queries import _PATHS
from tessera.sources import blocks, code, diagnostics, reports


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'segment:allowed' END, CASE WHEN length(c_name) > 17 AND c_custkey % 2 = 0 THEN 'name:max' END, CASE WHEN c_custkey % 3 = 0 THEN 'phone:required' END,
    CASE WHEN c_acctbal <= 0 THEN 'balance:check' END], lambda x: x IS NOT NULL), ',') AS broken FROM customer""")
def response_validation(spark, d):
    """Rules that a response breaks: required, length, allowed values and a check of its own."""
    rows = table(spark, d, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("segment"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("short").alias("name"), F.when(F.col("c_custkey") % 3 != 0, "1").alias("phone"), F.col("c_acctbal").alias("balance"),
    )
    rules = {"segment": {"allowed": ["BUILDING", "MACHINERY"], "type": "string"}, "name": {"max": 17, "min": 1, "pattern": "."}, "phone": {"required": True, "type": "int"}, "balance": {"check": lambda c: c > 0}}
    return rows.select("c_custkey", F.array_join(validation.violations(rules), ",").alias("broken"))


@query("""SELECT p_partkey, p_size::DOUBLE AS number, p_size % 2 = 0 AS flag, CASE p_size % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'red' WHEN 2 THEN 'blue' END AS choice FROM part""")
def input_conversion(spark, d):
    """Inputs as numbers, booleans and choices; what isn't one is null."""
    k = F.col("p_size") % 4
    flag = F.when(F.col("p_size") % 2 == 0, F.when(k == 0, " Yes").otherwise("1")).otherwise("off")
    choice = F.when(k == 0, "red").when(k == 1, "1").when(k == 2, "2").otherwise("green")
    return table(spark, d, "part").select("p_partkey", validation.converted_input(F.concat(F.lit(" "), "p_size"), "number").alias("number"), validation.converted_input(flag, "boolean").alias("flag"), validation.converted_input(choice, "choice", ("red", "blue")).alias("choice"))


@query("""SELECT event_id, hit FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS hit, event_type FROM events WHERE event_type IN ('error', 'click') AND value >= CASE event_type WHEN 'error' THEN 50 ELSE 90 END) WHERE hit <= CASE event_type WHEN 'error' THEN 3 ELSE 1 END""")
def breakpoints(spark, d):
    """Events at which execution stops, by step, condition and number of hits."""
    points = spark.createDataFrame([("error", 50.0, 3), ("click", 90.0, 1)], "step string, least double, max_hits int")
    hits = validation.breakpoint_hits(table(spark, d, "events"), points, "user_id", "event_type", ["ts", "event_id"], lambda: F.col("value") >= F.col("least"))
    return hits.select("event_id", F.col("hit").cast("long").alias("hit"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'same' WHEN 1 THEN 'patch' WHEN 2 THEN 'minor' WHEN 3 THEN 'major' ELSE 'downgrade' END AS step, p_size % 3 = 0 AS valid FROM part""")
def version_steps(spark, d):
    """Kinds of upgrades, and which rule files are valid."""
    k = F.col("p_size") % 5
    new = F.when(k == 0, "1.2").when(k == 1, "1.2.9").when(k == 2, "1.10.0").when(k == 3, "2.0.0").otherwise("1.1.9")
    third = F.col("p_size") % 3
    text = F.when(third == 0, "// plugins: none\nmodule.exports = { meta: {}, create() {} }").when(third == 1, "module.exports = { meta: {}, create() {}, extends: [] }").otherwise("/* meta */ module.exports = { create() {} }")
    return table(spark, d, "part").select("p_partkey", validation.version_step(F.lit("1.2.0"), new).alias("step"), validation.valid_rule_file(text).alias("valid"))


@query("""SELECT event_id, user_id % 3 = 0 OR event_type = 'view' AND user_id % 3 = 1 AS allowed FROM events""")
def permissions(spark, d):
    """Requests against a table of grants."""
    grants = spark.createDataFrame([("r0", "*"), ("r1", "view"), ("r9", "click")], "role string, action string")
    asked = table(spark, d, "events").select("event_id", F.concat(F.lit("r"), F.col("user_id") % 3).alias("role"), "event_type")
    return validation.permitted(asked, grants, "role", "event_type").select("event_id", "allowed")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'new' ELSE p_name END AS p_name FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT -1, 'added'""")
def rule_registry(spark, d):
    """Rules registered, replaced and deleted."""
    part = table(spark, d, "part").select("p_partkey", "p_name")
    fresh = part.where("p_partkey % 4 = 0").withColumn("p_name", F.lit("new")).unionByName(spark.createDataFrame([(-1, "added")], "p_partkey long, p_name string"))
    return validation.removed(validation.upserted(part, fresh, ["p_partkey"]), part.where("p_partkey % 7 = 0"), ["p_partkey"])


@query("""SELECT c_custkey, c_name || ' {{ tier }} {{ x }}' AS kept, c_name || ' basic <x>' AS filled FROM customer""")
def template_policies(spark, d):
    """Templates that keep what they don't know, or fill it from fallbacks."""
    fields = {"name": F.col("c_name"), "tier": F.lit(None).cast("string")}
    text = "{{name}} {{ tier }} {{ x }}"
    return table(spark, d, "customer").select("c_custkey", render(text, fields, missing_as="{{{{ {} }}}}").alias("kept"), render(text, fields, fallbacks={"tier": F.lit("basic")}).alias("filled"))


# a part's functions with branches: names and conditions carry its key
BODY = (
    "function outer{k}(a, b) {", "  if (a > {k}) {", "    help{k}(); log('}');", "  } else {", "    other(a);", "  }", "  switch (b) {", "    case 1: one(); break;", "    case 2: two(); break;", "    default: rest();", "  }",
    "  try {", "    risky(help{k}());", "  } catch (e) {", "    log(e); // {", "  }", "}",
)


def branching(spark, d):
    text = F.replace(F.lit("\n".join(BODY)), F.lit("{k}"), F.col("p_partkey").cast("string"))
    return spread(table(spark, d, "part").select("p_partkey"), "p_partkey").select(F.concat(F.lit("f"), "p_partkey").alias("path"), text.alias("text"))


@query("""WITH p AS (SELECT 'f' || p_partkey AS file, p_partkey::VARCHAR AS k FROM part) SELECT file, 'function' AS kind, 'outer' || k AS name, 1 AS line, 0 AS depth, 'if,help' || k || ',log,other,switch,one,two,rest,risky,help' || k || ',catch,log' AS calls FROM p
    UNION ALL SELECT file, 'if', 'a > ' || k, 2, 1, 'help' || k || ',log' FROM p UNION ALL SELECT file, 'else', NULL, 4, 1, 'other' FROM p UNION ALL SELECT file, 'switch', 'b', 7, 1, 'one,two,rest' FROM p
    UNION ALL SELECT file, 'try', NULL, 12, 1, 'risky,help' || k FROM p UNION ALL SELECT file, 'catch', 'e', 14, 1, 'log' FROM p""".replace("'if,help'", "'help'").replace(",other,switch,", ",other,").replace("',catch,log'", "',log'"))
def code_blocks(spark, d):
    """Functions and branches with what they call; brackets in texts and comments don't count."""
    f = branching(spark, d)
    return blocks.blocks(f, "path", "text").withColumn("calls", F.array_join(blocks.called_names(F.col("body")), ",")).drop("body")


@query("""WITH p AS (SELECT 'f' || p_partkey AS file FROM part), w(kind, weight) AS (VALUES ('if', 0.5), ('else', 0.5), ('switch', 0.333333), ('try', 0.8), ('catch', 0.2)) SELECT file, kind, weight::DOUBLE AS weight FROM p CROSS JOIN w""")
def branch_weights(spark, d):
    return blocks.branch_weights(blocks.blocks(branching(spark, d), "path", "text")).select("file", "kind", "weight")


@query("""WITH p AS (SELECT 'f' || p_partkey AS file, p_partkey::VARCHAR AS k FROM part) SELECT file, 'help' || k AS callee, 2 AS line, 'a > ' || k AS condition FROM p UNION ALL SELECT file, 'two', 7, 'b' FROM p UNION ALL SELECT file, 'never', NULL, NULL FROM p""")
def conditional_paths(spark, d):
    """Called functions with the first branch that calls them."""
    f = branching(spark, d)
    k = F.regexp_replace("path", "f", "")
    steps = f.select(F.col("path").alias("file"), F.explode(F.array(F.concat(F.lit("help"), k), F.lit("two"), F.lit("never"))).alias("callee"))
    found = blocks.blocks(f, "path", "text").where("kind in ('if', 'else', 'switch')")
    return blocks.first_conditions(steps, found, ["file"])


@query("""SELECT p_partkey, 'a:number:,m:Map<string, T>:,cb:(x: A, y: B) => void:,n:int:' || p_size AS params, 'false,true,false,true' AS optional, 'Pair' AS generic, 'Map<K, V>|List<T>' AS arguments FROM part""")
def signatures(spark, d):
    """Parameters of a signature and arguments of a generic type; inner brackets stay whole."""
    text = F.concat(F.lit("function f<T>(a: number, m?: Map<string, T>, cb: (x: A, y: B) => void, n: int = "), "p_size", F.lit("): void"))
    fields = F.transform(blocks.parameters(text), blocks.parameter_fields)
    shown = F.array_join(F.transform(fields, lambda p: F.concat_ws(":", p["name"], F.coalesce(p["type"], F.lit("")), F.coalesce(p["default"], F.lit("")))), ",")
    generic = blocks.generic_parts(F.lit("Pair<Map<K, V>, List<T>>"))
    return table(spark, d, "part").select("p_partkey", shown.alias("params"), F.array_join(F.transform(fields, lambda p: p["optional"].cast("string")), ",").alias("optional"), generic["name"].alias("generic"), F.array_join(generic["arguments"], "|").alias("arguments"))


@query("""WITH e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
    x AS (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) SELECT node, sum(i)::BIGINT AS predecessors, sum(o)::BIGINT AS successors FROM x GROUP BY 1""")
def graph_degrees(spark, d):
    return graph.degrees(_hierarchy(spark, d))


@query(_PATHS.format(nodes=2) + """, c AS (SELECT path[2] AS src, path[1] AS dst FROM p WHERE path[1] < path[2] AND EXISTS (SELECT 1 FROM e WHERE e.src = path[2] AND e.dst = path[1]) UNION SELECT src, dst FROM e WHERE src = dst)
    SELECT src, dst, false AS placeholder FROM e WHERE (src, dst) NOT IN (SELECT (src, dst) FROM c) UNION ALL SELECT src, '<cycle:' || dst || '>', true FROM c""")
def cycle_breaking(spark, d):
    """A graph rid of the edges that close its cycles of one or two nodes, with placeholders."""
    edges = _transitions(spark, d).distinct()
    return graph.without_cycles(edges, paths.cycles(edges, 2))


@query(_PATHS.format(nodes=4) + " SELECT max(len(path)) - 1 AS depth FROM p")
def call_depth(spark, d):
    return graph.max_depth(paths.simple_paths(_transitions(spark, d).distinct(), 3))


@query("""SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, true AS cycle FROM nation UNION ALL SELECT 'r' || n_regionkey, 'x' || n_nationkey, false FROM nation""")
def inclusion_guard(spark, d):
    """Which new inclusions would close a cycle."""
    nation = table(spark, d, "nation")
    node = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    wanted = nation.select(node("n", "n_nationkey").alias("src"), node("r", "n_regionkey").alias("dst")).union(nation.select(node("r", "n_regionkey"), node("x", "n_nationkey")))
    return graph.closes_cycle(_hierarchy(spark, d), wanted)


@query("""WITH m AS (SELECT 'n' || n_nationkey AS name, unnest(['open', 'close']) AS method, 'r' || n_regionkey AS parent, n_nationkey FROM nation) SELECT name, method, CASE WHEN method = 'close' AND n_nationkey % 2 = 0 THEN name ELSE parent END AS owner FROM m
    UNION ALL SELECT 'r' || r_regionkey, unnest(['open', 'close']), 'r' || r_regionkey FROM region""")
def method_resolution(spark, d):
    """Methods of each class: its own, else its nearest ancestor's."""
    nation = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), "n_nationkey")
    base = nation.select(F.col("parent").alias("name")).distinct().select("name", F.explode(F.array(F.lit("open"), F.lit("close"))).alias("method"))
    return graph.resolved_methods(nation.select("name", "parent"), base.union(nation.where("n_nationkey % 2 = 0").select("name", F.lit("close"))))


@query("""WITH s AS (SELECT l_orderkey, count(*) AS total, count(*) FILTER (WHERE l_returnflag <> 'R') AS passed, count(*) FILTER (WHERE l_returnflag = 'R') AS failed FROM lineitem GROUP BY 1)
    SELECT l_orderkey, total::INT AS total, passed::INT AS passed, failed::INT AS failed, failed::INT AS mocha_failed, CASE WHEN failed > 0 THEN 'first' END AS first_failure FROM s""")
def runner_reports(spark, d):
    """Runners' reports behind other output, one of them broken off."""
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") != "R").alias("p"), F.count_if(F.col("l_returnflag") == "R").alias("f"))
    head = F.format_string('warning: {x}\n{"numTotalTests":%d,"numPassedTests":%d,"numFailedTests":%d', "n", "p", "f")
    jest = F.concat(head, F.when(F.col("l_orderkey") % 2 == 0, "}").otherwise(',"testResults":[{'))
    mocha = F.concat(F.format_string('{"stats":{"tests":%d,"passes":%d,"failures":%d},"failures":[', "n", "p", "f"), F.when(F.col("f") > 0, '{"fullTitle":"first"}').otherwise(""), F.lit("]}"))
    rows = s.select("l_orderkey", jest.alias("jest"), mocha.alias("mocha"))
    other = reports.mocha_summary(rows, "mocha", keep=("l_orderkey",)).select("l_orderkey", F.col("failed").alias("mocha_failed"), "first_failure")
    return reports.jest_summary(rows, "jest", keep=("l_orderkey",)).drop("skipped").join(other, "l_orderkey")


@query("""SELECT 'export' AS kind, 'src/' || p_partkey || '.ts' AS file, p_name AS name, p_size AS line FROM part UNION ALL SELECT 'file', 'old/' || p_partkey || '.ts', NULL, NULL FROM part UNION ALL SELECT 'type', 'src/' || p_partkey || '.ts', 'T' || p_size, NULL FROM part WHERE p_size % 2 = 0""")
def unused_code(spark, d):
    """Unused files, exports and types of JSON reports."""
    types = F.when(F.col("p_size") % 2 == 0, F.format_string('{"name":"T%d"}', "p_size")).otherwise("")
    text = F.format_string('Done\n{"files":["old/%d.ts"],"issues":[{"file":"src/%d.ts","exports":[{"name":"%s","line":%d}],"types":[%s]}]}', "p_partkey", "p_partkey", "p_name", "p_size", types)
    return reports.unused_items(table(spark, d, "part").select(text.alias("value")))


@query("""SELECT p_partkey, 'file' AS kind, 'old.ts' AS file, NULL AS name, NULL::INT AS line FROM part UNION ALL SELECT p_partkey, 'export', 'a.ts', 'run', p_size FROM part UNION ALL SELECT p_partkey, 'type', 'b.ts', 'T', NULL FROM part""")
def unused_code_text(spark, d):
    """The same from reports in sections of text."""
    text = F.concat(F.lit("noise\nUnused files (1)\nold.ts\n\nUnused exports (1)\nrun   a.ts:"), "p_size", F.lit("\nUnused types (1)\nT b.ts"))
    return reports.sectioned_items(table(spark, d, "part").select("p_partkey", text.alias("value")), "p_partkey")


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS errors, count(*) FILTER (WHERE l_returnflag <> 'R') AS warnings, count(*) FILTER (WHERE l_discount > 0.05) AS fixable, count(DISTINCT l_orderkey) AS files FROM lineitem""")
def lint_totals(spark, d):
    items = table(spark, d, "lineitem").withColumn("severity", F.when(F.col("l_returnflag") == "R", "error").otherwise("warning"))
    return reports.issue_totals(items, "severity", F.col("l_discount") > 0.05, "l_orderkey")


@query(f"""WITH p AS ({_P}) SELECT 'Base' || near AS name, count(*) AS users FROM p GROUP BY near HAVING count(DISTINCT k % 3) > 1""")
def shared_types(spark, d):
    """Parents that classes of more than one project extend."""
    found = code.hierarchy(code_files(spark, d), "path", "text")
    project = F.regexp_extract("file", r"m(\d+)", 1).cast("long") % 3
    return found.groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("users"), F.count_distinct(project).alias("projects")).where("projects > 1").drop("projects")


@query("""WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount > 0.07) SELECT l_partkey AS key, 'both' AS part FROM a
    UNION ALL SELECT p_partkey, 'neither' FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)""")
def set_operations(spark, d):
    """Intersection and difference of sets of keys."""
    items = table(spark, d, "lineitem")
    both = items.where("l_returnflag = 'R'").select("l_partkey").intersect(items.where("l_discount > 0.07").select("l_partkey"))
    rest = table(spark, d, "part").select("p_partkey").subtract(items.select("l_partkey"))
    return both.select(F.col("l_partkey").alias("key"), F.lit("both").alias("part")).union(rest.select("p_partkey", F.lit("neither")))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), l AS (SELECT user_id, max(n) AS top FROM o WHERE n % 4 = 0 GROUP BY 1)
    SELECT user_id, n AS version, value FROM o JOIN l USING (user_id) WHERE n = top""")
def latest_checkpoints(spark, d):
    """The newest checkpoint (every fourth version) of each workflow, to recover from."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    history = table(spark, d, "events").select("user_id", "value", nth.alias("version")).where("version % 4 = 0")
    return state.as_of(history, "user_id", "version", 1 << 40)


def _compiler_output(spark, d):
    """Output of a compiler for each part: an error, a warning with odd spaces, and lines that are no diagnostics."""
    k, size = (F.col(c).cast("string") for c in ("p_partkey", "p_size"))
    text = F.concat(F.lit("src/m"), k, F.lit(".ts("), size, F.lit(",7): error TS23"), F.lpad(size, 2, "0"), F.lit(": "), F.col("p_name"), F.lit("\nFound 1 error.\n  lib/n"), k, F.lit(".ts(1,"), size, F.lit("):  warning TS1:  "), F.col("p_brand"), F.lit("  \n\nsrc/a.ts(x,1): error TS2: no\n"))
    return table(spark, d, "part").select(text.alias("value"))


def _linter_output(spark, d):
    """A linter's JSON report for each part, with one message that can be fixed and one that can't."""
    part = table(spark, d, "part")
    message = lambda line, severity, rule, fix: F.struct(line.cast("int").alias("line"), F.lit(3).alias("column"), F.lit(severity).alias("severity"), F.lit(rule).alias("ruleId"), F.col("p_brand").alias("message"), fix.alias("fix"))
    fixed, none = F.struct(F.lit("x").alias("text")), F.lit(None).cast("struct<text:string>")
    report = F.array(F.struct(F.concat(F.lit("src/m"), "p_partkey", F.lit(".ts")).alias("filePath"), F.array(message(F.col("p_size"), 2, "no-var", fixed), message(F.col("p_size") + 1, 1, "eqeqeq", none)).alias("messages")))
    return part.select(F.to_json(report).alias("value"))


_TSC = """SELECT 'src/m' || p_partkey || '.ts' AS file, p_size::INT AS line, 7 AS "column", 'error' AS severity, 'TS23' || lpad(p_size::VARCHAR, 2, '0') AS code, p_name AS message FROM part
    UNION ALL SELECT 'lib/n' || p_partkey || '.ts', 1, p_size::INT, 'warning', 'TS1', p_brand FROM part"""
_LINTED = """SELECT 'src/m' || p_partkey || '.ts' AS file, p_size::INT AS line, 3 AS "column", 'error' AS severity, 'no-var' AS rule, p_brand AS message, true AS fixable FROM part
    UNION ALL SELECT 'src/m' || p_partkey || '.ts', p_size::INT + 1, 3, 'warning', 'eqeqeq', p_brand, false FROM part"""


@query(_TSC)
def compiler_diagnostics(spark, d):
    return diagnostics.tsc_diagnostics(_compiler_output(spark, d))


@query(_LINTED)
def linter_issues(spark, d):
    return diagnostics.lint_issues(_linter_output(spark, d))


@query(f"""SELECT 'compiler' AS tool, * FROM ({_TSC}) UNION ALL SELECT 'linter', file, line, "column", severity, rule, message FROM ({_LINTED})""")
def all_diagnostics(spark, d):
    """Diagnostics of both tools as one table."""
    return diagnostics.all_diagnostics(compiler=diagnostics.tsc_diagnostics(_compiler_output(spark, d)), linter=diagnostics.lint_issues(_linter_output(spark, d)))


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def history_cleanup(spark, d):
    """What is left of a history of versions when all but the three newest of each workflow go."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return state.pruned(table(spark, d, "events").select("user_id", nth.alias("version"), "value"), "user_id", "version", 3)
