"""Filter trees to columns: text operators and metadata comparisons, nested with $and and $or."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$in": lambda c, v: c.isin(*v), "$nin": lambda c, v: ~c.isin(*v),
}
_TEXT = {"$contains": lambda c, v: F.contains(c, F.lit(v)), "$not_contains": lambda c, v: ~F.contains(c, F.lit(v)), "$regex": lambda c, v: c.rlike(v), "$exact": lambda c, v: c == v}


def _all(parts) -> Column:
    return reduce(lambda a, b: a & b, parts)


def text_filter(tree: dict, text: Column) -> Column:
    """A document filter; several operators in one dict are joined by and."""
    parts = []
    for op, v in tree.items():
        if op in ("$and", "$or"):
            subs = [text_filter(x, text) for x in v]
            parts.append(_all(subs) if op == "$and" else reduce(lambda a, b: a | b, subs))
        elif op in _TEXT:
            parts.append(_TEXT[op](text, v))
        else:
            raise ValueError(f"unknown text operator {op}")
    return _all(parts)


def metadata_filter(tree: dict) -> Column:
    """A metadata filter, over columns by name."""
    parts = []
    for key, v in tree.items():
        if key in ("$and", "$or"):
            subs = [metadata_filter(x) for x in v]
            parts.append(_all(subs) if key == "$and" else reduce(lambda a, b: a | b, subs))
        elif isinstance(v, dict):
            parts += [_COMPARE[op](F.col(key), x) for op, x in v.items()]
        else:
            parts.append(F.col(key) == v)
    return _all(parts)


def simple_filter(pattern: str, kind: str = "contains", combine_with=None, mode: str = "and") -> dict:
    """A pattern and further substrings as a filter tree; any mode but "and" means or."""
    base = {{"contains": "$contains", "regex": "$regex"}.get(kind, "$exact"): pattern}
    if not combine_with:
        return base
    return {"$and" if mode == "and" else "$or": [base, *({"$contains": x} for x in combine_with)]}
