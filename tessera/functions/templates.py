"""Templates with ``{{name}}`` fields, compiled to columns when the plan is built."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def render(template: str, fields: dict[str, Column], missing_as: str = "<{}>", fallbacks: dict[str, Column] | None = None) -> Column:
    """A template of one field alone keeps that field's type; otherwise text.

    A missing or null field takes its fallback, and without one shows as ``missing_as`` says: ``<name>``, or ``{{ name }}`` to stay as it is.
    """
    whole = re.fullmatch(r"\s*\{\{\s*([\w.]+)\s*\}\}\s*", template)
    if whole and whole[1] in fields:
        return fields[whole[1]]
    out = []
    for i, part in enumerate(re.split(r"\{\{\s*([\w.]+)\s*\}\}", template)):
        missing = F.lit(missing_as.format(part))
        if fallbacks and part in fallbacks:
            missing = F.coalesce(fallbacks[part].cast("string"), missing)
        out.append(F.lit(part) if i % 2 == 0 else F.coalesce(fields[part].cast("string"), missing) if part in fields else missing)
    return F.concat(*out)


def shortened(text: Column, most: int = 100) -> Column:
    """Texts longer than ``most`` characters, cut to that length with three dots at the end."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)
