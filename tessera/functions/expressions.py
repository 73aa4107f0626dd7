"""JavaScript-like semantics as Spark columns.

Where the meaning hangs on a value's type, the type is the column's, known when the plan is built: one of ``null``, ``bool``,
``int``, ``float``, ``text``, ``list`` and ``object``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\s\u001c-\u001f\u0085\p{Z}]"
NAN = float("nan")


@dataclass(frozen=True)
class Value:
    """A column and the type that decides how operators treat it."""

    column: Column
    kind: str

    @staticmethod
    def of(rows: DataFrame, name: str) -> Value:
        """A column of a table."""
        t = rows.schema[name].dataType
        kinds = ((T.BooleanType, "bool"), (T.IntegralType, "int"), (T.NumericType, "float"), (T.StringType, "text"), (T.ArrayType, "list"), ((T.StructType, T.MapType), "object"), (T.NullType, "null"))
        return Value(F.col(name), next((k for c, k in kinds if isinstance(t, c)), "object"))

    @staticmethod
    def literal(x: object) -> Value:
        kind = "null" if x is None else "bool" if isinstance(x, bool) else "int" if isinstance(x, int) else "float" if isinstance(x, float) else "text"
        return Value(F.lit(x), kind)


def truthy_number(c: Column) -> Column:
    """Null, 0 and NaN are false."""
    return F.coalesce((c != 0) & ~F.isnan(c.cast("double")), F.lit(False))


def truthy_string(c: Column) -> Column:
    """Null and the empty string are false."""
    return F.coalesce(c != "", F.lit(False))


def truthy(v: Value) -> Column:
    """Null, false, 0, NaN and the empty text are false; every list and object is true."""
    if v.kind in ("int", "float"):
        return truthy_number(v.column)
    return {"null": lambda: F.lit(False), "bool": lambda: F.coalesce(v.column, F.lit(False)), "text": lambda: truthy_string(v.column)}.get(v.kind, lambda: v.column.isNotNull())()


def either(left: Column, right: Column, truthy: Column) -> Column:
    """``left || right``: an operand, not a boolean."""
    return F.when(truthy, left).otherwise(right)


def both(left: Column, right: Column, truthy: Column) -> Column:
    """``left && right``: an operand, not a boolean."""
    return F.when(truthy, right).otherwise(left)


def negation(v: Value) -> Column:
    """``!v``."""
    return ~truthy(v)


def ternary(condition: Value, yes: Column, no: Column) -> Column:
    return F.when(truthy(condition), yes).otherwise(no)


def modulo(left: Column, right: Column) -> Column:
    """Remainder with the sign of the divisor; a zero divisor is an error, a null operand counts as 0."""
    a, b = F.coalesce(left, F.lit(0)), F.coalesce(right, F.lit(0))
    return F.when(b == 0, F.raise_error(F.lit("modulo by zero")).cast("double")).otherwise(a - b * F.floor(a / b))


def to_number(text: Column) -> Column:
    """A text as a number: null and blank are 0, whole numbers and numbers with a point are themselves, all else is NaN.

    An exponent counts only behind a point; white space around a number doesn't matter, an underscore between digits neither.
    """
    bare = F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")
    number = bare.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$") | bare.rlike(r"^[+-]?([0-9]+(_[0-9]+)*\.([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?$")
    return F.when(text.isNull() | (bare == ""), F.lit(0.0)).when(number, F.replace(bare, F.lit("_"), F.lit("")).try_cast("double")).otherwise(F.lit(NAN))


def number(v: Value) -> Column:
    """Any value as a number: null is 0, true 1, a list or object NaN."""
    if v.kind == "text":
        return to_number(v.column)
    if v.kind in ("bool", "int", "float"):
        return F.coalesce(v.column.cast("double"), F.lit(0.0))
    return F.lit(0.0) if v.kind == "null" else F.when(v.column.isNull(), 0.0).otherwise(F.lit(NAN))


def text(v: Value) -> Column:
    """Any scalar as text, spelled ``True``, ``False`` and ``None``; whole numbers of kind ``float`` keep their ``.0``."""
    if v.kind == "null":
        return F.lit("None")
    spelled = F.initcap(v.column.cast("string")) if v.kind == "bool" else v.column.cast("string")
    return F.coalesce(spelled, F.lit("None"))


def less(left: Column, right: Column) -> Column:
    """``left < right`` of numbers: null counts as 0, NaN on either side is false."""
    a, b = (F.coalesce(c.cast("double"), F.lit(0.0)) for c in (left, right))
    return (a < b) & ~F.isnan(a) & ~F.isnan(b)


def compare(left: Value, op: str, right: Value) -> Column:
    """``<``, ``>``, ``<=`` and ``>=``, always of numbers; NaN on either side is false."""
    a, b = number(left), number(right)
    hit = {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
    return hit & ~F.isnan(a) & ~F.isnan(b)


def plus(left: Value, right: Value) -> Column:
    """``+``: text if either side is text, else a sum of numbers."""
    if "text" in (left.kind, right.kind):
        return F.concat(text(left), text(right))
    return number(left) + number(right)


def loose_equals(left: Value, right: Value) -> Column:
    """``==``: values of one type as they are, number and text as numbers, true and false as 1 and 0; null equals null alone."""
    a, b = left, right
    if a.kind == b.kind:
        same = a.column.eqNullSafe(b.column)
        return same & ~F.coalesce(F.isnan(a.column), F.lit(False)) if a.kind == "float" else same
    if "null" in (a.kind, b.kind):
        return a.column.isNull() & b.column.isNull()
    kinds = {a.kind, b.kind}
    if kinds <= {"int", "float", "bool"}:
        equal = a.column.cast("double") == b.column.cast("double")
    elif "text" in kinds and kinds <= {"int", "float", "bool", "text"}:
        words, other = (a, b) if a.kind == "text" else (b, a)
        bare = F.regexp_replace(words.column, rf"^{SPACE}+|{SPACE}+$", "")
        equal = F.when(bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), bare.try_cast("double") == other.column.cast("double"))
    else:
        return F.lit(False)
    return F.when(a.column.isNull() & b.column.isNull(), True).otherwise(F.coalesce(equal, F.lit(False)))


def strict_equals(left: Value, right: Value) -> Column:
    """``===``: equal and of one type; ``1 === 1.0`` is false. Null equals null."""
    both_null = left.column.isNull() & right.column.isNull()
    return both_null | loose_equals(left, right) if left.kind == right.kind else both_null


def divide(left: Column, right: Column) -> Column:
    """Quotient; by zero it is infinite, positive for a positive dividend only. A null operand counts as 0."""
    a, b = (F.coalesce(c.cast("double"), F.lit(0.0)) for c in (left, right))
    return F.when(b == 0, F.when((a > 0) & ~F.isnan(a), F.lit(float("inf"))).otherwise(F.lit(float("-inf")))).otherwise(F.try_divide(a, b))


def sliced(items: Column, start: int, end: int | None = None) -> Column:
    """``slice(start, end)`` with negative positions counted from the end."""
    n = F.size(items)
    at = lambda i: F.greatest(n + i, F.lit(0)) if i < 0 else F.least(F.lit(i), n)
    first, last = at(start), n if end is None else at(end)
    return F.slice(items, first + 1, F.greatest(last - first, F.lit(0)))


def element(v: Value, index: Column) -> Column:
    """``v[index]`` of a list or a text; null below 0, beyond the end and for other values."""
    i = index.cast("int")
    if v.kind == "text":
        return F.when((i >= 0) & (i < F.length(v.column)), F.substring(v.column, i + 1, F.lit(1)))
    return F.get(v.column, i) if v.kind == "list" else F.lit(None)


def length(v: Value) -> Column:
    """``v.length`` of a list or a text; null for others."""
    return F.length(v.column) if v.kind == "text" else F.when(v.column.isNotNull(), F.size(v.column)) if v.kind == "list" else F.lit(None)


def trimmed(c: Column) -> Column:
    """``trim()``: any white space at both ends goes."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def split_text(c: Column, delimiter: str) -> Column:
    """``split(delimiter)``; an empty delimiter is an error."""
    if not delimiter:
        raise ValueError("empty separator")
    return F.split(c, "".join("\\" + x if x in r"\.[]{}()*+-?^$|" else x for x in delimiter))


def includes(v: Value, x: Column) -> Column:
    """``includes(x)`` of a text or a list; null for a null."""
    return v.column.contains(x) if v.kind == "text" else F.when(v.column.isNotNull(), F.coalesce(F.array_contains(v.column, x), F.lit(False)))


def concatenated(items: Column, *others: Value) -> Column:
    """``concat``: lists are joined on, other values appended."""
    return F.concat(items, *[o.column if o.kind == "list" else F.array(o.column) for o in others])


def mapped(items: Column, name: str | None = None) -> Column:
    """``map(name)`` of objects: that property of each; without a name each element as text."""
    return F.transform(items, lambda x: x[name] if name else F.coalesce(x.cast("string"), F.lit("None")))


def filtered(items: Column, name: str | None = None, equal: Column | None = None) -> Column:
    """``filter(name)``: objects whose (text) property is true; ``filter(value)``: the elements that equal it."""
    return F.filter(items, lambda x: truthy_string(x[name]) if name else x.eqNullSafe(equal))


def joined(items: Column, delimiter: str = ",") -> Column:
    """``join``; nulls are spelled ``None``."""
    return F.array_join(items.cast("array<string>"), delimiter, "None")


def pushed(items: Column, x: Column) -> tuple[Column, Column]:
    """``push`` without the mutation: the longer list and its length."""
    return F.array_append(items, x), F.size(items) + 1


def popped(items: Column) -> tuple[Column, Column]:
    """``pop`` without the mutation: the shorter list and the last element, null of an empty one."""
    return F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0))), F.get(items, F.size(items) - 1)


def rounded(c: Column) -> Column:
    """``Math.round``: halves go up."""
    return F.floor(c + 0.5)


def keys_of(pairs: Column) -> Column:
    """``Object.keys`` of a map."""
    return F.map_keys(pairs)


def entries_of(pairs: Column) -> Column:
    """``Object.entries`` of a map, as pairs ``key``, ``value``."""
    return F.map_entries(pairs)


def parsed(json: Column, schema: str) -> Column:
    """``JSON.parse`` with a known shape; null where it isn't JSON."""
    return F.from_json(json, schema)


def stringified(c: Column) -> Column:
    """``JSON.stringify``, nulls kept."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def recovered(value: Column, on_error: str, fallback: Column | None = None) -> Column:
    """What a computed field shows where its expression failed (null): ``use_fallback``, ``propagate`` (an error) or ``ignore`` (null)."""
    if on_error == "use_fallback":
        return F.coalesce(value, fallback)
    if on_error == "propagate":
        return F.coalesce(value, F.raise_error(F.lit("a computed field failed")).cast("string"))
    return value


#: The operators of the second, smaller condition language, longest first.
CONDITIONS = ("!= null", "==", ">", "<")


def condition(value: Column, op: str, other: str | float | None = None) -> Column:
    """One condition of the second language: ``== text``, ``!= null``, ``> number``, ``< number``, or truth without an operator."""
    if op == "":
        return truthy_string(value.cast("string"))
    if op not in CONDITIONS:
        raise ValueError(f"unknown operator: {op}")
    if op == "!= null":
        return value.isNotNull()
    if op == "==":
        return F.coalesce(value.cast("string") == F.lit(str(other)), F.lit(False))
    n = value.try_cast("double")
    return F.coalesce(n > other if op == ">" else n < other, F.lit(False))
