"""Standards found by their rarest grams against every file with every standard."""

import random

from pyspark.sql import functions as F

from tessera.operators import retrieval


def test_same_pairs_as_all_against_all(spark):
    r = random.Random(5)
    words = ["src", "Api", "tests", "hooks", "ui", "a", "ab", "core", "x.y", "ß", "[z]"]
    paths = ["/".join(r.choice(words) for _ in range(r.randrange(1, 5))) + r.choice([".ts", ".tsx", ".py", "", "[1].c"]) for _ in range(120)] + [None, "", "src/Api/a.ts", "src/Api/a.ts"]
    globs = ["*.ts", "src/*", "*", "?", "**/hooks/*", "[ab]*", "*[!x].py", "no such part", "a", "*[1*", "", None, "*ß*", "S*"]
    standards = [(r.choice([*words, "", None]), [r.choice([*words, "zz", ""]) for _ in range(r.randrange(3))] if i % 5 else None, [r.choice(globs) for _ in range(r.randrange(3))] if i % 7 else None, r.choice(["required", "important", "x", None])) for i in range(60)]
    files = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "id int, p string").repartition(3)
    rules = spark.createDataFrame(standards + standards[:2], "category string, tags array<string>, globs array<string>, priority string")
    score = retrieval.relevance(F.col("p"), F.col("category"), F.col("tags"), F.col("globs"), F.col("priority"))
    shown = lambda rows: sorted(map(str, rows.collect()))
    got = retrieval.relevant_standards(files, rules, "p")
    assert shown(got) == shown(files.crossJoin(rules).withColumn("score", score).where("score > 0"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert retrieval.relevant_standards(files, rules.limit(0), "p").count() == 0


def test_rarest_gram_limits_what_is_compared(spark):
    texts = spark.createDataFrame([(f"src/common/file{i}.ts",) for i in range(200)] + [("src/common/rare.qz",)], "text string")
    needles = spark.createDataFrame([(1, ["src/common/", ".qz"]), (2, ["src/", "nowhere"]), (3, ["q"])], "id int, parts array<string>")
    got = retrieval.indexed_needles(needles, texts).collect()
    assert sorted((x.id, x.text) for x in got) == [(1, "src/common/rare.qz"), (3, "src/common/rare.qz")]
