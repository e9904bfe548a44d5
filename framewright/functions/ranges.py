"""The range language: which numbers of 0..n-1 a specification names, in order and with repeats.

    spec   := term (";" term)*            terms follow each other
    term   := list ["/" list]             the numbers of the first list but those of the second
    list   := item ("," item)*            an empty first list before "/" means all numbers
    item   := "all" | "nil" | p | p "-" p | p ":" p | p ":" s ":" p
    p      := number | "^" number         "^k" counts from the end: n-1-k
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = r"\^?\d+"
ITEM = re.compile(rf"({POINT})(?:-({POINT})|:({POINT})(?::({POINT}))?)?$")


def point(text: str, n: int) -> int:
    return n - 1 - int(text[1:]) if text[0] == "^" else int(text)


def items(text: str, n: int) -> list[int]:
    out: list[int] = []
    for item in filter(None, (x.strip() for x in text.split(","))):
        if item in ("all", "nil"):
            out += range(n) if item == "all" else ()
            continue
        m = ITEM.match(item)
        if not m:
            raise ValueError(f"not a range: {item!r}")
        first, last, second, third = m.groups()
        begin = point(first, n)
        if third:
            end, step = point(third, n), int(second)
        else:
            end, step = (point(last or second, n) if last or second else begin), 1
        out += range(begin, end + 1, step) if end >= begin else range(begin, end - 1, -step)
    return out


def parse(spec: str, n: int) -> list[int]:
    """The numbers that spec names among 0..n-1; an error for one outside."""
    out: list[int] = []
    for term in spec.split(";"):
        kept, slash, gone = term.partition("/")
        own = items(kept, n) if kept.strip() or not slash else list(range(n))
        drop = set(items(gone, n))
        out += [x for x in own if x not in drop]
    bad = [x for x in out if not 0 <= x < n]
    if bad:
        raise ValueError(f"{bad[0]} is outside 0..{n - 1}")
    return out


def named(number: Column, n: Column, spec: str) -> Column:
    """Where spec names `number` among 0..n-1: a sorted array of structs (item, k), one for each naming, empty for none.

    Arithmetic on each item's ends, so ranges of any length cost nothing and n may differ from row to row.  Ends outside
    0..n-1 name nothing."""
    at = lambda text: n - 1 - int(text[1:]) if text[0] == "^" else F.lit(int(text)).cast("long")

    def progressions(text: str) -> list[tuple[Column, int, Column]]:
        out = []
        for item in filter(None, (x.strip() for x in text.split(","))):
            if item == "all":
                out.append((F.lit(0).cast("long"), 1, n - 1))
            elif item != "nil":
                m = ITEM.match(item)
                if not m:
                    raise ValueError(f"not a range: {item!r}")
                first, last, second, third = m.groups()
                out.append((at(first), int(second) if third else 1, at(third or last or second or first)))
        return out

    def place(begin: Column, step: int, end: Column) -> Column:
        """The place in the progression, or null."""
        up = F.when(number.between(begin, end) & (F.pmod(number - begin, F.lit(step)) == 0), F.floor((number - begin) / step))
        down = F.when((end < begin) & number.between(end, begin) & (F.pmod(begin - number, F.lit(step)) == 0), F.floor((begin - number) / step))
        return F.coalesce(up, down)

    found, item = [], 0
    for term in spec.split(";"):
        kept, slash, gone = term.partition("/")
        own = progressions(kept) if kept.strip() or not slash else progressions("all")
        free = ~F.coalesce(*[place(*p) for p in progressions(gone)], F.lit(-1)).cast("long").between(0, 2**62) if progressions(gone) else F.lit(True)
        for p in own:
            k = place(*p)
            found.append(F.when(k.isNotNull() & free, F.struct(F.lit(item).alias("item"), k.cast("long").alias("k"))))
            item += 1
    return F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull()))


def select(df: DataFrame, number: str, spec: str, n: int, out: str) -> DataFrame:
    """The rows whose `number` spec names, once for each naming; `out` (item, k) sorts them in the specification's order."""
    return df.withColumn(out, F.explode(named(F.col(number).cast("long"), F.lit(n).cast("long"), spec)))


def canonical(numbers: Column) -> Column:
    """The distinct numbers of a list, in order."""
    return F.array_sort(F.array_distinct(numbers))


def progression(number: Column, begin: int, step: int, end: Column) -> Column:
    """The predicate of `begin:step:end`, for ranges too long to list."""
    return number.between(F.lit(begin), end) & (F.pmod(number - begin, F.lit(step)) == 0)
