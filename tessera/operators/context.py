"""What a session is about: task, layer, technologies, working area, route and patterns in the order of visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns that speak for a task, two or more of which decide for it; the first task that has them counts.
TASKS = {
    "api_development": (r"/api/.*route\.(ts|js)", r"/api/.*\.ts", r"export.*GET|POST|PUT|DELETE", r"NextRequest|NextResponse"),
    "component_development": (r"\.(tsx|jsx)$", r"export.*React\.FC", r"export.*function.*Component", r"import.*React"),
    "testing": (r"\.(test|spec)\.(ts|js|tsx|jsx)$", r"describe\s*\(", r"it\s*\(", r"test\s*\(", r"expect\s*\("),
    "styling": (r"\.(css|scss|sass|less)$", r"styled-components", r"@emotion", r"tailwind", r"className="),
    "configuration": (r"(next|webpack|babel|eslint|prettier)\.config\.(js|ts)", r"package\.json", r"tsconfig\.json", r"\.env"),
    "database": (r"(prisma|mongoose|sequelize)", r"\.sql$", r"migration", r"schema"),
}
# Patterns that speak for a technology; one is enough.
TECHNOLOGIES = {
    "react": (r"\.(tsx|jsx)$", r"import.*React"), "nextjs": (r"next/", r"app/", r"pages/"), "typescript": (r"\.(ts|tsx)$",), "tailwind": (r"tailwind", r"@apply"),
    "prisma": (r"prisma/", r"@prisma"), "api_routes": (r"/api/.*route\.(ts|js)",), "server_components": (r"app/.*\.(ts|tsx)$",), "client_components": (r"'use client'", r'"use client"'),
}
# Folders and endings of a layer, first hit first; kinds of routes by file name.
LAYERS = (
    ("presentation", ("/components/",), (".tsx", ".jsx")), ("api", ("/api/", "/server/"), ()), ("utility", ("/lib/", "/utils/"), ()), ("hooks", ("/hooks/",), ()),
    ("state", ("/context/", "/store/"), ()), ("routing", ("/pages/", "/app/"), ()), ("styling", ("/styles/",), (".css", ".scss")),
)
ROUTES = (("api_route", ("route.ts", "route.js")), ("page", ("page.tsx", "page.jsx")), ("layout", ("layout.tsx", "layout.jsx")), ("loading", ("loading.tsx", "loading.jsx")), ("error", ("error.tsx", "error.jsx")), ("not_found", ("not-found.tsx", "not-found.jsx")))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def layer(path: Column) -> Column:
    """The architectural layer of a path."""
    out = F.lit("business_logic")
    for name, folders, endings in reversed(LAYERS):
        out = F.when(_any([path.contains(f) for f in folders] + [path.endswith(e) for e in endings]), name).otherwise(out)
    return out


def route_type(path: Column) -> Column:
    out = F.lit("component")
    for name, parts in reversed(ROUTES):
        out = F.when(_any([path.contains(p) for p in parts]), name).otherwise(out)
    return out


def route_context(path: Column, head: Column) -> Column:
    """Router, API flag, server component, route type and rendering of a path; ``head`` is the beginning of its text."""
    client = F.coalesce(head.contains("'use client'") | head.contains('"use client"'), F.lit(False))
    return F.struct(
        F.when(path.contains("/app/"), "app").when(path.contains("/pages/"), "pages").alias("router"), path.contains("/api/").alias("is_api"),
        F.when(path.endswith(".tsx") | path.endswith(".jsx"), ~client).otherwise(True).alias("is_server"), route_type(path).alias("route"),
        F.when(path.contains("/api/"), "api").when(client, "csr").otherwise("ssr").alias("rendering"),
    )


def last_visits(visits: DataFrame, session: str, order: list[str], n: int) -> DataFrame:
    """The last ``n`` visits of each session, ``nth`` from the newest."""
    own = Window.partitionBy(session).orderBy(*[F.desc(c) for c in order])
    return visits.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= n)


def visit_patterns(visits: DataFrame, session: str, file: str, order: list[str], history: int = 20) -> DataFrame:
    """Per session: ``refactoring`` (a file three times in its history) and ``debugging`` (the last three files are one, or are named after errors)."""
    kept = last_visits(visits.select(session, file, *order), session, order, history)
    times = kept.groupBy(session, file).agg(F.count(F.lit(1)).alias("n")).groupBy(session).agg((F.max("n") >= 3).alias("refactoring"))
    named = F.lower(file).contains("error") | F.lower(file).contains("debug")
    newest = kept.where("nth <= 3").groupBy(F.col(session).alias("of")).agg((((F.count_distinct(file) == 1) & (F.count(F.lit(1)) > 1)) | F.bool_or(named)).alias("debugging"))
    return times.join(newest, F.col(session).eqNullSafe(F.col("of"))).drop("of")


def session_context(visits: DataFrame, session: str, file: str, order: list[str], patterns: DataFrame | None = None) -> DataFrame:
    """Per session: task type, complexity level, phase and a flag for each technology.

    ``patterns`` (session, number of patterns loaded as ``patterns``) adds to level and phase; 0 where absent.
    """
    kept = last_visits(visits.select(session, file, *order), session, order, 20)
    recent, c = F.col("nth") <= 6, F.col(file)
    hits = [F.bool_or(recent & c.rlike(f"(?i){p}")).cast("int").alias(f"{t}_{i}") for t, ps in TASKS.items() for i, p in enumerate(ps)]
    tech = [F.bool_or(_any([c.rlike(f"(?i){p}") for p in ps])).alias(t) for t, ps in TECHNOLOGIES.items()]
    stats = kept.groupBy(session).agg(F.count(F.lit(1)).alias("files"), *hits, *tech)
    found = visit_patterns(visits, session, file, order).withColumnRenamed(session, "who")
    stats = stats.join(found, F.col(session).eqNullSafe(F.col("who"))).drop("who")
    if patterns is not None:
        stats = stats.join(patterns.withColumnRenamed(session, "who"), F.col(session) == F.col("who"), "left").drop("who")
    n = F.coalesce(F.col("patterns"), F.lit(0)) if patterns is not None else F.lit(0)
    f = F.col("files")
    task = F.when(F.col("refactoring"), "refactoring").when(F.col("debugging"), "debugging").otherwise("feature_development")
    for t, ps in reversed(TASKS.items()):
        task = F.when(sum((F.col(f"{t}_{i}") for i in range(len(ps))), F.lit(0)) >= 2, t).otherwise(task)
    level = F.when((f < 3) & (n < 2), "basic").when((f < 10) & (n < 5), "intermediate").when((f < 20) & (n < 10), "advanced").otherwise("expert")
    phase = F.when(f < 3, "exploration").when(n < 3, "learning").when(F.col("refactoring"), "refinement").when(f > 10, "development").otherwise("implementation")
    return stats.select(session, task.alias("task"), level.alias("level"), phase.alias("phase"), *TECHNOLOGIES)


def working_area(visits: DataFrame, session: str, file: str, order: list[str]) -> DataFrame:
    """Per session the folder that most of its files lie in; of several the one met first, the outer before the inner."""
    dirs = F.split(file, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(dirs) - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(dirs, F.lit(1), i), "/").alias("dir")))
    inside = visits.where(F.size(dirs) > 1).select(session, F.struct(*order).alias("at"), F.explode(prefixes).alias("p"))
    counted = inside.groupBy(session, "p.dir").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "p.depth")).alias("first"))
    best = counted.groupBy(session).agg(F.max("n").alias("most"))
    top = counted.join(best.withColumnRenamed(session, "who"), F.col(session).eqNullSafe(F.col("who")) & (F.col("n") == F.col("most")))
    return top.groupBy(session).agg(F.min_by("dir", "first").alias("area"), F.max("n").alias("hits"))
