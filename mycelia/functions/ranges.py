"""Lists of positive integers from specifications such as "8,1:5:2, 3", and names made of them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = 2**31 - 1


def positive_int(text: str) -> int:
    """A whole string in base 10, from 1 to 2**31 - 1; white space and a plus sign may come first."""
    if not re.fullmatch(r"\s*\+?[0-9]+", text) or not 1 <= (value := int(text)) <= LARGEST:
        raise ValueError(f"not a positive integer: {text!r}")
    return value


def parse_ranges(spec: str, label: str = "range list") -> list[int]:
    """Values of tokens `a`, `a:b` or `a:b:step`, both ends included, in ascending order and each once."""
    out: set[int] = set()
    for token in filter(None, spec.split(",")):
        parts = [p.strip() for p in token.strip().split(":")]
        if len(parts) > 3 or not all(parts):
            raise ValueError(f"{label}: bad token {token!r}")
        try:
            low, high, step = positive_int(parts[0]), positive_int(parts[1 if len(parts) > 1 else 0]), positive_int(parts[2]) if len(parts) == 3 else 1
        except ValueError as e:
            raise ValueError(f"{label}: {e}") from None
        if low > high:
            raise ValueError(f"{label}: {token!r} runs downward")
        out.update(range(low, high + 1, step))
    if not out:
        raise ValueError(f"{label}: empty")
    return sorted(out)


def range_values(spec: Column) -> Column:
    """The same as an array<int> expression; null for a specification that is not valid."""
    tokens = F.filter(F.split(spec, ","), lambda t: t != "")
    fields = lambda t: F.transform(F.split(t, ":"), lambda p: F.trim(p))
    number = lambda p: F.when(p.rlike(r"^\s*\+?[0-9]+$"), p.try_cast("int"))

    def values(t: Column) -> Column:
        f = fields(t)
        low = number(F.get(f, 0))
        high = F.when(F.size(f) > 1, number(F.get(f, 1))).otherwise(low)
        step = F.when(F.size(f) > 2, number(F.get(f, 2))).otherwise(F.lit(1))
        valid = (F.size(f) <= 3) & (low > 0) & (high >= low) & (step > 0)
        return F.when(valid, F.sequence(low, F.greatest(low, high), F.greatest(step, F.lit(1))))

    lists = F.transform(tokens, values)
    good = (F.size(lists) > 0) & ~F.exists(lists, lambda x: x.isNull())
    return F.when(good, F.array_sort(F.array_distinct(F.flatten(lists))))


def config_name(chunk: Column, exchange: Column) -> Column:
    return F.format_string("chunk_%d_exchange_%d", chunk, exchange)
