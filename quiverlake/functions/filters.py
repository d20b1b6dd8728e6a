"""Metadata filters: clauses, their validation, their columns, and the ways to write them.

All clauses of a filter must match. A missing key matches only ``ne`` and ``not_in``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = ("eq", "ne", "in", "not_in", "gt", "gte", "lt", "lte", "exists")
MAX_CLAUSES = 32
MAX_VALUES = 1024
_DECIMAL = r"[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?"
_NUMBER = rf"\A{_DECIMAL}\z"
_INFINITE = r"(?i)\A[+-]?inf(inity)?\z"
_HEX = r"(?i)\A[+-]?0x([0-9a-f]+([.][0-9a-f]*)?|[.][0-9a-f]+)p[+-]?[0-9]+\z"


class BadFilter(ValueError):
    """A clause that can't be evaluated."""


def parse_number(text: str) -> float | None:
    """A decimal, hexadecimal or infinite number; None for anything else, NaN and overflow."""
    if re.fullmatch(_DECIMAL, text):
        x = float(text)
        return x if math.isfinite(x) else None
    if re.fullmatch(r"[+-]?inf(inity)?", text, re.I):
        return float(text)
    if re.fullmatch(r"[+-]?0x([0-9a-f]+([.][0-9a-f]*)?|[.][0-9a-f]+)p[+-]?[0-9]+", text, re.I):
        try:
            return float.fromhex(text)
        except OverflowError:
            return None
    return None


def number(v: Column) -> Column:
    """parse_number of a string column; null where it has no number."""
    d = F.when(v.rlike(_NUMBER), v.try_cast("double"))
    d = F.when(F.abs(d) < float("inf"), d)
    infinite = F.when(v.rlike(_INFINITE), F.when(v.startswith("-"), F.lit(-float("inf"))).otherwise(F.lit(float("inf"))))
    return F.coalesce(d, infinite, _hex_number(v))


def _hex_digits(c: Column) -> Column:
    """Value of hex digits, as a sum of digit values (strings are short)."""
    digits = F.split(F.lower(c), "")
    return F.aggregate(F.filter(digits, lambda x: x != ""), F.lit(0.0), lambda s, x: s * 16 + (F.instr(F.lit("0123456789abcdef"), x) - 1))


def _hex_number(v: Column) -> Column:
    whole = F.regexp_extract(v, r"(?i)0x([0-9a-f]*)", 1)
    part = F.regexp_extract(v, r"(?i)0x[0-9a-f]*[.]([0-9a-f]*)", 1)
    power = F.regexp_extract(v, r"(?i)p([+-]?[0-9]+)\z", 1).try_cast("double")
    x = (_hex_digits(whole) + _hex_digits(part) / F.pow(F.lit(16.0), F.length(part))) * F.pow(F.lit(2.0), power)
    return F.when(v.rlike(_HEX), F.when(F.abs(x) < float("inf"), F.when(v.startswith("-"), -x).otherwise(x)))


@dataclass(frozen=True)
class Clause:
    key: str
    op: str = "eq"
    value: str = ""
    values: Sequence[str] = field(default=())

    def check(self) -> None:
        if not self.key:
            raise BadFilter("a clause needs a key")
        if self.op not in OPS:
            raise BadFilter(f"unknown operator {self.op!r}")
        if self.op in ("in", "not_in"):
            if not self.values:
                raise BadFilter(f"{self.op} needs values")
            if len(self.values) > MAX_VALUES:
                raise BadFilter(f"more than {MAX_VALUES} values")
        if self.op in ("gt", "gte", "lt", "lte") and parse_number(self.value) is None:
            raise BadFilter(f"{self.value!r} is no number")

    def column(self, metadata: Column) -> Column:
        """Whether a map column matches; never null, a null map has no keys."""
        self.check()
        found = F.try_element_at(metadata, F.lit(self.key))
        has = F.coalesce(F.map_contains_key(metadata, F.lit(self.key)), F.lit(False))
        match self.op:
            case "eq":
                return F.coalesce(found == self.value, F.lit(False))
            case "ne":
                return F.coalesce(found != self.value, F.lit(True))
            case "in":
                return F.coalesce(found.isin(list(dict.fromkeys(self.values))), F.lit(False))
            case "not_in":
                return ~F.coalesce(found.isin(list(dict.fromkeys(self.values))), F.lit(False))
            case "exists":
                return has
        x, y = number(found), F.lit(parse_number(self.value))
        return F.coalesce({"gt": x > y, "gte": x >= y, "lt": x < y, "lte": x <= y}[self.op], F.lit(False))


def matches(clauses: Iterable[Clause], metadata: Column | str = "metadata") -> Column:
    """Whether a row matches all clauses; every row matches none."""
    clauses = list(clauses)
    if len(clauses) > MAX_CLAUSES:
        raise BadFilter(f"more than {MAX_CLAUSES} clauses")
    m = F.col(metadata) if isinstance(metadata, str) else metadata
    return reduce(lambda a, b: a & b, (c.column(m) for c in clauses), F.lit(True))


def from_equalities(filters: Mapping[str, str]) -> list[Clause]:
    """Clauses of a plain mapping: every key equals its value."""
    return [Clause(k, "eq", v) for k, v in sorted(filters.items())]


def from_messages(items: Iterable[Mapping]) -> list[Clause]:
    """Clauses of {key, op, value, values}; no op means eq, and no values means [value]."""
    out = []
    for m in items:
        op = m.get("op") or "eq"
        values = list(m.get("values") or ([] if op == "exists" else [m.get("value", "")]))
        out.append(Clause(m.get("key", ""), op, m.get("value", ""), tuple(values)))
        out[-1].check()
    return out


def from_tuples(items: Iterable[tuple]) -> list[Clause]:
    """Clauses of (key, op) and (key, op, value or list of values)."""
    return from_messages({"key": i[0], "op": i[1], **({"values": list(i[2])} if len(i) > 2 and isinstance(i[2], (list, tuple)) else {"value": str(i[2]) if len(i) > 2 else ""})} for i in items)


def from_text(equalities: Iterable[str] = (), conditions: Iterable[str] = ()) -> list[Clause]:
    """Clauses of ``key=value`` and of ``key:op[:value]`` texts; in and not_in take a comma list."""
    out = []
    for e in equalities:
        key, sep, value = e.partition("=")
        if not sep or not key:
            raise BadFilter(f"{e!r} is not key=value")
        out.append(Clause(key, "eq", value, (value,)))
    for c in conditions:
        key, _, rest = c.partition(":")
        op, sep, value = rest.partition(":")
        values = tuple(value.split(",")) if op in ("in", "not_in") and sep else ()
        out.append(Clause(key, op, value, values))
        out[-1].check()
    return out
