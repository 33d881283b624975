"""Column expressions and name rules for text."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inheritance tags, looked for in this order.
INHERITANCE_TAGS = {
    "Autosomal dominant": "AD",
    "Autosomal recessive": "AR",
    "somatic": "som",
    "[": "misc",
    "{": "misc",
    "X-linked recessive": "XLR",
    "X-linked dominant": "XLD",
}


def term_pattern(terms: Sequence[str], regex: bool = False) -> str:
    """One case-insensitive alternation; terms are literals unless `regex`."""
    parts = [t if regex else re.escape(t) for t in terms if t != ""]
    return "(?i)(?:" + "|".join(parts) + ")"


def matches_any(column: str | Column, terms: Sequence[str], regex: bool = False) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    return col.rlike(term_pattern(terms, regex))


def tag_text(column: str | Column, tags: Mapping[str, str], other: str = "other", sep: str = ";") -> Column:
    """Tags of every substring found, in table order; `other` when none is."""
    col = F.col(column) if isinstance(column, str) else column
    found = F.concat_ws(sep, *[F.when(col.contains(part), F.lit(tag)) for part, tag in tags.items()])
    return F.when(found == "", F.lit(other)).otherwise(found)


def clean_column_name(name: str) -> str:
    """Spaces to underscores; hyphens and brackets out; double underscores merged once."""
    name = name.replace(" ", "_").replace("-", "")
    return name.replace("(", "").replace(")", "").replace("__", "_")



def attribute(column: str | Column, key: str) -> Column:
    """Value of `key "value"` in an attribute column (null when absent)."""
    col = F.col(column) if isinstance(column, str) else column
    value = F.regexp_extract(col, re.escape(key) + r' "([^"]*)"', 1)
    return F.when(value != "", value)
