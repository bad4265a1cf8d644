"""The metadata filter grammar, compiled to one Column.

``{key: scalar}``, ``{key: [scalars]}`` or ``{key: {op: value, ...}}`` with the operators eq, gt, gte, lt, lte, in,
contains and contains_any; all conditions hold together. Numbers never equal texts, every text is greater than every
number, true and false are 1 and 0; a missing or null value satisfies nothing. The key doc_id reads the column, with eq
and in only. Anything else is a ValueError.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from kelpie.functions.metadata import Value
from kelpie.functions.text import ascii_lower

SCOPES = {"chunks": "chunk", "summaries": "summary", "both": None}
MOST_ALTERNATIVES = 256


def _scalars(op: str, values, most: int | None = None) -> list:
    if not isinstance(values, list) or not values or any(isinstance(v, (list, dict)) for v in values) or most and len(values) > most:
        raise ValueError(f"{op} takes a list of scalars, not {values!r}")
    return values


def _class_of(bound):
    if bound is None:
        return None, None
    if isinstance(bound, (bool, int, float)):
        return "num", float(bound)
    if isinstance(bound, str):
        return "txt", bound
    raise ValueError(f"not a scalar: {bound!r}")


def _compare(v: Value, op: str, bound) -> Column:
    kind, b = _class_of(bound)
    if kind is None:
        return F.lit(False)
    own, other = (v.num, v.txt) if kind == "num" else (v.txt, v.num)
    test = {"eq": own == F.lit(b), "lt": own < F.lit(b), "lte": own <= F.lit(b), "gt": own > F.lit(b), "gte": own >= F.lit(b)}[op]
    beyond = op in ("gt", "gte") if kind == "num" else op in ("lt", "lte")
    return F.coalesce(test, F.lit(False)) | other.isNotNull() if beyond else F.coalesce(test, F.lit(False))


def _contains(v: Value, bound) -> Column:
    if bound is None or isinstance(bound, (list, dict)):
        raise ValueError(f"contains takes a scalar, not {bound!r}")
    needle = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in str(bound))
    return F.coalesce(F.contains(ascii_lower(v.rendered), F.lit(needle)), F.lit(False))


def compile_filter(filt: dict | None, metadata: str = "metadata", doc_id: str = "doc_id") -> Column:
    """The condition of a filter; true for none."""
    conditions: list[Column] = []
    for key, wanted in (filt or {}).items():
        ops = wanted if isinstance(wanted, dict) else {"in": wanted} if isinstance(wanted, list) else {"eq": wanted}
        if key == "doc_id":
            for op, bound in ops.items():
                if op == "eq":
                    conditions.append(F.coalesce(F.col(doc_id) == F.lit(_id_text(bound)), F.lit(False)))
                elif op == "in":
                    conditions.append(F.coalesce(F.col(doc_id).isin([_id_text(x) for x in _scalars(op, bound)]), F.lit(False)))
                else:
                    raise ValueError(f"doc_id knows eq and in, not {op!r}")
            continue
        v = Value(F.col(metadata), key)
        for op, bound in ops.items():
            if op in ("eq", "gt", "gte", "lt", "lte"):
                conditions.append(_compare(v, op, bound))
            elif op == "in":
                conditions.append(reduce(or_, [_compare(v, "eq", x) for x in _scalars(op, bound)]))
            elif op == "contains":
                conditions.append(_contains(v, bound))
            elif op == "contains_any":
                conditions.append(reduce(or_, [_contains(v, x) for x in _scalars(op, bound, MOST_ALTERNATIVES)]))
            else:
                raise ValueError(f"unknown operator {op!r}")
    return reduce(and_, conditions, F.lit(True))


def _id_text(bound) -> str | None:
    """doc_id is text: an integer stands for its digits, any other number for itself."""
    return None if bound is None else str(int(bound)) if isinstance(bound, bool) else str(bound)


def in_scope(scope: str = "chunks", filt: dict | None = None) -> Column:
    """Indexed records of a scope under a filter."""
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope!r}")
    kind = SCOPES[scope]
    base = F.col("indexed").cast("int") == 1
    return base & (F.col("type") == kind if kind else F.lit(True)) & compile_filter(filt)
