"""Source text line by line: references, imports, exports, definitions, calls and conditions.

A line is cut into tokens (names, texts in quotes, numbers, signs) and judged by the tokens around a name, so that names in quotes
and parts of names don't count. One line is one unit, as in the reports these operators stand for.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts in quotes, names, numbers, signs.
TOKEN = r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|[A-Za-z_$][\w$]*|\d[\w.]*|=>|[^\s\w]"""
# The confidence of each kind of reference.
CONFIDENCE = {"import": 0.95, "class": 0.95, "abstract": 0.9, "extends": 0.9, "call": 0.8, "usage": 0.7, "definition": 0.9}
#: What a kind is reported as.
REPORTED = {"import": "import", "class": "declaration", "abstract": "declaration", "extends": "usage", "call": "usage", "usage": "usage", "definition": "definition"}
# The signs that make a condition complex, each counted for itself.
CONDITION_SIGNS = ("&&", "||", "!", "(", ")", "===", "!==", "<", ">", "<=", ">=")
# Words before a bracket that aren't calls.
NOT_CALLS = ("if", "for", "while", "switch", "catch", "function", "return", "typeof", "new", "await", "constructor", "super", "import", "require")
#: Names of test files: their endings.
TEST_ENDINGS = (".test.ts", ".test.tsx", ".test.js", ".test.jsx", ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx")


def tokens(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0))


def numbered_lines(files: DataFrame, file_col: str, text_col: str) -> DataFrame:
    """``file, line_no`` (from 1) and ``line``."""
    # the outer form, as Spark makes a filter of the other one's argument and cuts each text twice
    lines = files.select(F.col(file_col).alias("file"), F.posexplode_outer(F.split(text_col, "\n")).alias("at", "line"))
    return lines.where("line is not null").select("file", (F.col("at") + 1).alias("line_no"), "line")


def with_value(rows: DataFrame, name: str, value: Column, make: Callable[[Column], Column]) -> DataFrame:
    """``rows`` where ``make`` of a costly value isn't null, with it as ``name``; the value and what is made of it are computed once for each row.

    A column of its own would be copied into each place that reads it, filters above it included.
    """
    made = F.transform(F.array(value), make)
    return rows.withColumn(name, F.explode_outer(made)).where(F.col(name).isNotNull())


def meaningful(lines: DataFrame) -> DataFrame:
    """Lines that are neither blank nor a comment from their first sign on."""
    return lines.where((F.trim("line") != "") & ~F.ltrim("line").startswith("//"))


def _after(toks: Column, i: Column) -> Column:
    """The tokens after position i (0-based)."""
    return F.slice(toks, i + 2, F.size(toks))


def _next_but(rest: Column, sign: str) -> Column:
    """The token after the first ``sign``; null if there is none."""
    return F.when(F.array_contains(rest, sign), F.get(rest, F.array_position(rest, sign).cast("int")))


def _kind(toks: Column, line: Column, i: Column) -> Column:
    """What the name at position i is there."""
    at = lambda k: F.get(toks, i + k)
    before = F.slice(toks, F.lit(1), i)
    opened = F.size(before) - F.array_position(F.reverse(before), "{").cast("int")  # the last bracket before, or the size
    in_braces = F.array_contains(before, "{") & ~F.array_contains(F.slice(before, opened + 1, F.size(before)), "}")
    opener = F.when(F.get(toks, opened - 1) == "type", F.get(toks, opened - 2)).otherwise(F.get(toks, opened - 1))
    named = in_braces & (opener == "import") & (_next_but(_after(toks, i), "}") == "from")
    follows = _next_but(_after(toks, i), ")")
    defined = (at(1) == "(") & follows.isin(":", "{") & ~F.exists(before, lambda t: t.contains("."))
    return (
        F.when(named | ((at(-1) == "import") & (at(1) == "from")), "import")
        .when(at(-1) == "class", "class")
        .when((at(-1) == "abstract") & (at(1) == "("), "abstract")
        .when(at(-1) == "extends", "extends")
        .when((at(-1) == ".") & at(-2).rlike(r"[\w.]$") & (at(1) == "("), "call")
        .when(defined, "definition")
        .when((F.get(toks, F.lit(0)) != "import") & ~F.ltrim(line).startswith("//"), "usage")
    )


def references(files: DataFrame, file_col: str, text_col: str, symbol: str) -> DataFrame:
    """``file, line_no, kind, reported, confidence`` of each line that refers to the symbol, by the strongest kind on it."""
    lines = numbered_lines(files.where(F.col(text_col).contains(symbol)), file_col, text_col).where(F.col("line").contains(symbol))
    places = lambda t: F.filter(F.transform(t, lambda x, i: F.when(x == symbol, i)), lambda i: i.isNotNull())
    kinds = with_value(lines, "kinds", tokens(F.col("line")), lambda t: F.array_distinct(F.transform(places(t), lambda i: _kind(t, F.col("line"), i))))
    order = list(CONFIDENCE)[:5] + ["definition", "usage"]  # a definition isn't a usage
    kind = F.coalesce(*[F.when(F.array_contains("kinds", k), k) for k in order])
    say = lambda what: F.create_map(*[F.lit(x) for pair in what.items() for x in pair])[F.col("kind")]
    return kinds.withColumn("kind", kind).where("kind is not null").select("file", "line_no", "kind", say(REPORTED).alias("reported"), say(CONFIDENCE).alias("confidence"))


def method_references(files: DataFrame, file_col: str, text_col: str, owner: str, method: str) -> DataFrame:
    """``Class#method``: ``file, line_no, kind`` for a class's declaration, a method's definition and its calls; a line may have several."""
    found = [references(files, file_col, text_col, owner).where("kind = 'class'"), *[references(files, file_col, text_col, method).where(F.col("kind") == k) for k in ("definition", "call")]]
    return reduce(DataFrame.unionByName, [f.select("file", "line_no", "kind") for f in found])


def unquoted(text: Column) -> Column:
    """A token of text without its quotes."""
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _names(toks: Column, i: Column) -> Column:
    """The entries between the bracket at position i and the one that closes it."""
    rest = _after(toks, i)
    inner = F.slice(rest, F.lit(1), F.array_position(rest, "}").cast("int") - 1)
    return F.filter(F.transform(F.split(F.array_join(inner, " "), ","), lambda x: F.trim(x)), lambda x: x != "")


def imports(files: DataFrame, file_col: str, text_col: str) -> DataFrame:
    """``file, line_no, kind, name, names, module, type_only, is_async, external``: a row for each import, two for a mixed one.

    Kinds: ``named``, ``default``, ``namespace``, ``dynamic``, ``require`` and ``side_effect``.
    """
    lines = meaningful(numbered_lines(files, file_col, text_col)).where(F.col("line").contains("import") | F.col("line").contains("require"))
    lines = with_value(lines, "toks", tokens(F.col("line")), lambda x: x)
    t = F.col("toks")
    at = lambda k: F.get(t, F.lit(k))
    quoted = lambda x: F.coalesce(x.rlike("^['\"]"), F.lit(False))
    is_name = lambda x: F.coalesce(x.rlike(r"^[A-Za-z_$]"), F.lit(False))
    called = lambda word: F.filter(F.transform(t, lambda x, i: F.when((x == word) & (F.get(t, i + 1) == "(") & quoted(F.get(t, i + 2)) & (F.get(t, i + 3) == ")"), F.get(t, i + 2))), lambda x: x.isNotNull())
    row = lambda kind, name, names, module: F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name"), names.alias("names"), unquoted(module).alias("module"))
    none, nothing = F.lit(None), F.array().cast("array<string>")
    typed = (at(1) == "type") & (at(2) != "from") & ((at(2) == "{") | (at(3) == "from"))
    first = F.when(typed, 2).otherwise(1)
    # each is read more than once
    lines = with_value(lines, "_once", F.struct(called("import").alias("dynamic"), called("require").alias("required"), F.array_position(t, "from").cast("int").alias("from")), lambda x: x)
    dynamic, required, from_at = (F.col(f"_once.{c}") for c in ("dynamic", "required", "from"))
    module = F.get(t, from_at)
    statement = (at(0) == "import") & (from_at > 0) & quoted(module)
    head, then = F.get(t, first), F.get(t, first + 1)
    kinds = (
        F.when(F.size(dynamic) > 0, F.transform(dynamic, lambda m: row("dynamic", none, nothing, m)))
        .when(F.size(required) > 0, F.transform(required, lambda m: row("require", none, nothing, m)))
        .when((at(0) == "import") & quoted(at(1)), F.array(row("side_effect", none, nothing, at(1))))
        .when(statement & (head == "*") & (then == "as"), F.array(row("namespace", F.get(t, first + 2), nothing, module)))
        .when(statement & (head == "{"), F.array(row("named", none, _names(t, first), module)))
        .when(statement & is_name(head) & (then == ",") & (F.get(t, first + 2) == "{"), F.array(row("default", head, nothing, module), row("named", none, _names(t, first + 2), module)))
        .when(statement & is_name(head) & (then == "from"), F.array(row("default", head, nothing, module)))
    )
    found = lines.select("file", "line_no", F.coalesce(typed, F.lit(False)).alias("type_only"), F.array_contains(t, "await").alias("is_async"), F.explode_outer(kinds).alias("i")).where("i is not null")
    external = ~(F.col("i.module").startswith(".") | F.col("i.module").startswith("/"))
    return found.select("file", "line_no", "i.*", "type_only", (F.col("is_async") & (F.col("i.kind") == "dynamic")).alias("is_async"), external.alias("external"))


def without_imports(text: Column) -> Column:
    """A text rid of its import lines."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\s*(import\s|import['\"{]|(const|let|var)\s[^=]*=\s*require\()")), "\n")


def exports(files: DataFrame, file_col: str, text_col: str) -> DataFrame:
    """``file, line_no, kind, names, module``: ``named``, ``default`` and ``re_export`` (all or by name, with ``as`` the new name)."""
    lines = meaningful(numbered_lines(files, file_col, text_col)).where(F.col("line").contains("export"))
    lines = with_value(lines, "toks", tokens(F.col("line")), lambda x: x).where(F.array_contains("toks", "export"))
    t = F.col("toks")
    e = F.array_position(t, "export").cast("int")  # the place after it
    at = lambda k: F.get(t, e + k)
    from_at = F.array_position(t, "from").cast("int")
    module = F.when((from_at > 0) & F.get(t, from_at).rlike("^['\"]"), unquoted(F.get(t, from_at)))
    shown = F.transform(_names(t, e), lambda x: F.when(x.contains(" as "), F.element_at(F.split(x, " as "), -1)).otherwise(x))
    row = lambda kind, names, m: F.struct(F.lit(kind).alias("kind"), names.cast("array<string>").alias("names"), m.cast("string").alias("module"))
    found = (
        F.when((at(0) == "*") & module.isNotNull(), row("re_export", F.array(), module))
        .when((at(0) == "{") & module.isNotNull(), row("re_export", shown, module))
        .when(at(0).isin("interface", "type", "enum", "class", "const", "let", "var", "function"), row("named", F.array(at(1)), F.lit(None)))
        .when(at(0) == "{", row("named", shown, F.lit(None)))
        .when(at(0) == "default", row("default", F.array(at(1)), F.lit(None)))
    )
    return lines.select("file", "line_no", found.alias("x")).where("x is not null").select("file", "line_no", "x.*")


def hierarchy(files: DataFrame, file_col: str, text_col: str) -> DataFrame:
    """``file, line_no, name, parent`` of each class that extends another."""
    t = F.col("toks")
    pairs = F.filter(F.transform(t, lambda x, i: F.when((x == "class") & (F.get(t, i + 2) == "extends"), F.struct(F.get(t, i + 1).alias("name"), F.get(t, i + 3).alias("parent")))), lambda p: p.isNotNull())
    lines = meaningful(numbered_lines(files, file_col, text_col)).where(F.col("line").contains("extends")).withColumn("toks", tokens(F.col("line")))
    return lines.select("file", "line_no", F.explode(pairs).alias("p")).select("file", "line_no", "p.*")


def definitions(files: DataFrame, file_col: str, text_col: str) -> DataFrame:
    """``file, name, line_no`` of functions: ``function f``, ``const f = (…) =>`` and methods ``f(…) {``; of one name in a file the last counts."""
    line = F.col("line")
    lines = meaningful(numbered_lines(files, file_col, text_col)).where(line.contains("(") | line.contains("=>") | line.contains("function"))

    def name(t: Column) -> Column:
        spoken = F.when(F.array_contains(t, "function"), F.get(t, F.array_position(t, "function").cast("int")))
        bound = F.when(F.get(t, F.lit(0)).isin("const", "let", "var", "export") & F.array_contains(t, "=>"), F.get(t, F.array_position(t, "=").cast("int") - 2))
        first = F.when(F.get(t, F.lit(0)).isin("async", "public", "private", "protected", "static"), 1).otherwise(0)
        method = F.when((F.get(t, first + 1) == "(") & F.element_at(t, -1).isin("{", "}") & _next_but(_after(t, first + 1), ")").isin("{", ":"), F.get(t, first))
        return F.coalesce(spoken, bound, method)

    found = with_value(lines, "name", tokens(line), name).where(F.col("name").rlike(r"^[A-Za-z_$]") & ~F.col("name").isin(*NOT_CALLS))
    return found.groupBy("file", "name").agg(F.max("line_no").alias("line_no"))


def calls(files: DataFrame, file_col: str, text_col: str) -> DataFrame:
    """``file, line_no, name, kind`` of each call: ``direct``, ``this``, ``object`` or ``new``; keywords and definitions aren't calls."""
    lines = meaningful(numbered_lines(files, file_col, text_col)).where(F.col("line").contains("("))

    def call(t: Column, x: Column, i: Column) -> Column:
        before = F.get(t, i - 1)
        kind = F.when(before == "new", "new").when((before == ".") & (F.get(t, i - 2) == "this"), "this").when(before == ".", "object").otherwise("direct")
        names = (F.get(t, i + 1) == "(") & x.rlike(r"^[A-Za-z_$]") & ~x.isin(*NOT_CALLS) & F.coalesce(before != "function", F.lit(True))
        defined = (i <= 1) & (kind == "direct") & _next_but(_after(t, i), ")").isin("{")
        return F.when(names & ~F.coalesce(defined, F.lit(False)), F.struct(x.alias("name"), kind.alias("kind")))

    found = with_value(lines, "found", tokens(F.col("line")), lambda t: F.filter(F.transform(t, lambda x, i: call(t, x, i)), lambda c: c.isNotNull()))
    return found.select("file", "line_no", F.explode("found").alias("c")).select("file", "line_no", "c.*")


def call_edges(files: DataFrame, file_col: str, text_col: str, most: int = 50) -> DataFrame:
    """``caller, callee``: each call belongs to the nearest definition at or above its line; the first ``most`` calls of a function count, as its feature."""
    from pyspark.sql import Window

    defined = definitions(files, file_col, text_col).select("file", F.col("line_no"), F.col("name").alias("caller"), F.lit(None).cast("string").alias("callee"))
    called = calls(files, file_col, text_col).select("file", "line_no", F.lit(None).cast("string").alias("caller"), F.col("name").alias("callee"))
    own = Window.partitionBy("file").orderBy("line_no", F.col("callee").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = defined.unionByName(called).withColumn("caller", F.last("caller", ignorenulls=True).over(own)).where("callee is not null and caller is not null")
    nth = F.row_number().over(Window.partitionBy("file", "caller").orderBy("line_no", "callee"))
    return placed.withColumn("nth", nth).where(F.col("nth") <= most).select("file", "caller", "callee")


#: What may follow a module's path, in order: nothing, an ending, or a folder's index.
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def module_path(module: Column, file: Column) -> Column:
    """The path that a relative module means, without an ending; null for a module by name."""
    folder = F.regexp_replace(file, "/?[^/]*$", "")
    whole = F.when(module.startswith("/"), F.substring(module, F.lit(2), F.length(module))).otherwise(F.concat(folder, F.lit("/"), module))
    # ``..`` takes a folder away, ``.`` none
    steps = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), lambda done, s: F.when(s.isin("", "."), done).when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, s)))
    return F.when(module.rlike("^[./]"), F.array_join(steps, "/"))


def candidates(module: Column, file: Column) -> Column:
    """Paths that a relative module may stand for, in order: with each ending, then as a folder's index. Null for a module by name."""
    return F.transform(F.array(module_path(module, file)), lambda base: F.when(base.isNotNull(), F.array(*[F.concat(base, F.lit(e)) for e in ENDINGS])))[0]


def module_edges(found: DataFrame, files: DataFrame, file_col: str) -> DataFrame:
    """``src, dst, kind``: imports (of ``imports``) joined with the files they stand for, at the first candidate that is a file; others fall away."""
    based = with_value(found.select("file", "kind", "module"), "base", module_path(F.col("module"), F.col("file")), lambda x: x)
    # a file stands for its path rid of each ending that it has; so no import is copied for candidates that aren't files
    path = F.col("path")
    stands = F.array(*[F.when(path.endswith(e), F.struct(F.lit(i).alias("place"), F.substring(path, F.lit(1), F.length(path) - len(e)).alias("base"))) for i, e in enumerate(ENDINGS)])
    known = files.select(F.col(file_col).alias("path")).select("path", F.explode(stands).alias("s")).where("s is not null").select("path", "s.*")
    first = known.groupBy("base").agg(F.min_by("path", "place").alias("dst"))
    # both sides grow with the texts, more than Spark's estimate tells: neither may be broadcast
    return based.join(first.hint("merge"), "base").select(F.col("file").alias("src"), "dst", "kind").distinct()


def condition_complexity(condition: Column) -> Column:
    """0.1 and 0.1 more for each operator or bracket, overlapping ones each for itself, 1 at most."""
    hits = sum(((F.length(condition) - F.length(F.replace(condition, F.lit(s), F.lit("")))) / len(s) for s in CONDITION_SIGNS), F.lit(0.0))
    return F.least(F.round(0.1 + 0.1 * hits, 6), F.lit(1.0))


def control_flow(text: Column) -> Column:
    """A struct of flags: conditions, loops, switches, exceptions, early returns, awaits and callbacks in a function's text."""
    word = lambda w: text.rlike(rf"\b({w})\b")
    return F.struct(
        word("if|else").alias("conditions"), word("for|while|do").alias("loops"), word("switch").alias("switches"), word("try|catch|finally|throw").alias("exceptions"),
        (F.regexp_count(text, F.lit(r"\breturn\b")) > 1).alias("early_returns"), word("async|await|Promise").alias("asynchronous"), text.contains("=>").alias("callbacks"),
    )


def unsafe_glob(pattern: Column) -> Column:
    """Patterns that climb out of a folder, hold empty parts or backslashes, or are longer than 1000 characters."""
    return pattern.contains("../") | pattern.contains("/..") | pattern.contains("//") | pattern.contains("\\") | (F.length(pattern) > 1000)


def is_test_file(path: Column) -> Column:
    return F.lower(path).rlike("(" + "|".join(e.replace(".", r"\.") for e in TEST_ENDINGS) + ")$|(^|/)(__tests__|tests?)/")


def bracket_path(path: Column) -> Column:
    """``a["b"][0].c`` as ``a.b.0.c``."""
    return F.regexp_replace(F.regexp_replace(path, r"""\[['"]([^'"\]]*)['"]\]""", ".$1"), r"\[(\d+)\]", ".$1")


def change_class(before_hash: Column, after_hash: Column, before_plain: Column, after_plain: Column) -> Column:
    """``new_file``, ``deleted``, ``unchanged``, ``cosmetic`` (only comments and white space differ) or ``semantic``."""
    return (
        F.when(before_hash.isNull(), "new_file").when(after_hash.isNull(), "deleted").when(before_hash == after_hash, "unchanged")
        .when(before_plain == after_plain, "cosmetic").otherwise("semantic")
    )


def plain_source(text: Column) -> Column:
    """Source text rid of line and block comments and of white space."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/|//[^\n]*", ""), r"\s+", "")
