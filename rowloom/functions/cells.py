"""Text, number, list and logic functions for computed cells. All are built from Spark's own expressions.

Texts treat a missing cell as empty; positions count from 0 unless `one_based`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.base import blank

PI, E, GOLDEN_RATIO, SQRT2, SQRT1_2, INFINITY = math.pi, math.e, (1 + math.sqrt(5)) / 2, math.sqrt(2), math.sqrt(0.5), math.inf  # F13


def concat(*parts: Column) -> Column:
    """texts in a row; numbers and the like as text."""
    return F.concat(*[blank(p) for p in parts]) if parts else F.lit("")


text_join = text_append = concat


def length(text: Column) -> Column:
    """spaces count too."""
    return F.length(blank(text))


def text_is_empty(text: Column) -> Column:
    """F5."""
    return F.length(blank(text)) == 0


def lists_is_empty(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0)) <= 0


def text_index_of(text: Column, find: Column | str, last: bool = False, one_based: bool = False) -> Column:
    """where a text first (last) occurs; -1, or 0 if one-based, where it doesn't."""
    find = find if isinstance(find, Column) else F.lit(find)
    t = blank(text)
    if last:
        back = F.position(F.reverse(find), F.reverse(t))
        at = F.when(back == 0, 0).otherwise(F.length(t) - F.length(find) - back + 2)
    else:
        at = F.position(find, t)
    return at if one_based else at - 1


def text_char_at(text: Column, where: str, at: int = 0) -> Column:
    """where is first, last, from_start or from_end (counted from 0); empty beyond the text."""
    t = blank(text)
    if where in ("last", "from_end"):
        k = 0 if where == "last" else at
        return F.when(F.length(t) > k, F.substring(t, -(k + 1), 1)).otherwise("")
    return F.substring(t, (0 if where == "first" else at) + 1, 1)


def text_substring(text: Column, start: int = 0, end: int = -1) -> Column:
    """F8: both ends inclusive, from 0; negative positions count from the end (-1 the last)."""
    t = blank(text)
    a = F.lit(start) if start >= 0 else F.greatest(F.length(t) + start, F.lit(0))
    b = F.lit(end) if end >= 0 else F.length(t) + end
    return F.substring(t, a + 1, F.greatest(b - a + 1, F.lit(0)))


def upper(text: Column) -> Column:
    """F9."""
    return F.upper(blank(text))


def lower(text: Column) -> Column:
    return F.lower(blank(text))


def title(text: Column) -> Column:
    """Words begin after white space; letters after an apostrophe or digit stay small."""
    return F.initcap(blank(text))


def trim(text: Column, side: str = "both") -> Column:
    """white space of any kind, at the left, right or both."""
    pattern = {"left": r"^\s+", "right": r"\s+\z", "both": r"^\s+|\s+\z"}[side]
    return F.regexp_replace(blank(text), pattern, "")


def arithmetic(a: Column, op: str, b: Column) -> Column:
    """+ - * / ^ and %, whose result has the divisor's sign; dividing by zero gives null."""
    a, b = a.cast("double"), b.cast("double")
    safe = F.when(b != 0, b)
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / safe, "^": lambda: F.pow(a, b), "%": lambda: a - safe * F.floor(a / safe)}[op]()


def single(op: str, a: Column) -> Column:
    """one-operand functions; trigonometry in degrees; round is half up; outside a function's domain null."""
    a = a.cast("double")
    unit = F.when((a >= -1) & (a <= 1), a)
    return {
        "abs": lambda: F.abs(a), "sqrt": lambda: F.when(a >= 0, F.sqrt(a)), "neg": lambda: -a, "ln": lambda: F.when(a > 0, F.log(a)), "log10": lambda: F.when(a > 0, F.log10(a)), "exp": lambda: F.exp(a), "pow10": lambda: F.pow(F.lit(10.0), a),
        "round": lambda: F.floor(a + 0.5).cast("double"), "up": lambda: F.ceil(a).cast("double"), "down": lambda: F.floor(a).cast("double"),
        "sin": lambda: F.sin(F.radians(a)), "cos": lambda: F.cos(F.radians(a)), "tan": lambda: F.tan(F.radians(a)), "asin": lambda: F.degrees(F.asin(unit)), "acos": lambda: F.degrees(F.acos(unit)), "atan": lambda: F.degrees(F.atan(a)),
    }[op]()


def is_prime(n: Column) -> Column:
    """Divisors up to the root are tried, so it is meant for numbers up to some 10^12."""
    k = n.cast("long")
    whole = n.cast("double") == k
    odd = F.sequence(F.lit(3).cast("long"), F.greatest(F.floor(F.sqrt(k)).cast("long"), F.lit(3).cast("long")), F.lit(2).cast("long"))
    divided = F.exists(odd, lambda d: (d < k) & (k % d == 0))
    return F.coalesce(F.when(~whole | (k < 2), False).when(k < 4, True).when(k % 2 == 0, False).otherwise(~divided), F.lit(False))


def number_is(n: Column, what: str, divisor: int | None = None) -> Column:
    """even, odd, prime, whole, positive, negative, divisible_by (a divisor of 0 or none: false); a missing number is nothing."""
    x = n.cast("double")
    test = {
        "even": lambda: arithmetic(x, "%", F.lit(2)) == 0, "odd": lambda: arithmetic(x, "%", F.lit(2)) == 1, "prime": lambda: is_prime(n), "whole": lambda: F.floor(x) == x,
        "positive": lambda: x > 0, "negative": lambda: x < 0, "divisible_by": lambda: arithmetic(x, "%", F.lit(divisor)) == 0 if divisor else F.lit(False),
    }[what]()
    return F.coalesce(test, F.lit(False))


def constrain(n: Column, low: float, high: float) -> Column:
    """F15."""
    return F.least(F.greatest(n, F.lit(low)), F.lit(high))


def numbers(items: Column) -> Column:
    """The items that are numbers, as doubles."""
    return F.filter(F.transform(items, lambda x: x.try_cast("double")), lambda x: x.isNotNull())


def list_sum(items: Column) -> Column:
    """F16: lists count their numbers only; without any the sum is 0 and the others are null."""
    return F.aggregate(numbers(items), F.lit(0.0), lambda a, x: a + x)


def list_min(items: Column) -> Column:
    return F.array_min(numbers(items))


def list_max(items: Column) -> Column:
    return F.array_max(numbers(items))


def list_average(items: Column) -> Column:
    n = F.size(numbers(items))
    return F.when(n > 0, list_sum(items) / n)


def list_median(items: Column) -> Column:
    s = F.array_sort(numbers(items))
    n = F.size(s)
    half = F.floor(n / 2).cast("int")
    return F.when(n > 0, F.when(n % 2 == 1, F.try_element_at(s, half + 1)).otherwise((F.try_element_at(s, F.greatest(half, F.lit(1))) + F.try_element_at(s, half + 1)) / 2))


def list_modes(items: Column) -> Column:
    """All items that occur most often, in the order in which they come first."""
    distinct = F.array_distinct(items)
    count = lambda x: F.size(F.filter(items, lambda y: y.eqNullSafe(x)))
    most = F.array_max(F.transform(distinct, count))
    return F.filter(distinct, lambda x: count(x) == most)


def list_stddev(items: Column) -> Column:
    """Of the whole population."""
    x, n, mean = numbers(items), F.size(numbers(items)), list_average(items)
    return F.when(n > 0, F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.pow(v - mean, F.lit(2.0))) / n))


def list_length(items: Column) -> Column:
    """F17."""
    return F.greatest(F.coalesce(F.size(items), F.lit(0)), F.lit(0))


def list_repeat(item: Column, n: int) -> Column:
    return F.array_repeat(item, n)


def list_index_of(items: Column, item: Column, last: bool = False) -> Column:
    """From 0; -1 where it is absent."""
    if not last:
        return (F.array_position(items, item) - 1).cast("int")
    back = F.array_position(F.reverse(items), item)
    return F.when(back == 0, -1).otherwise(F.size(items) - back).cast("int")


def list_get(items: Column, where: str, at: int = 0) -> Column:
    """where is first, last, from_start or from_end (from 0); null beyond the list."""
    k = {"first": 1, "last": -1, "from_start": at + 1, "from_end": -(at + 1)}[where]
    return F.try_element_at(items, F.lit(k))


def list_sublist(items: Column, start: int, end: int) -> Column:
    """Both ends inclusive, from 0; negative ends count from the end."""
    n = F.size(items)
    a = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    b = F.lit(end) if end >= 0 else n + end
    return F.slice(items, a + 1, F.greatest(b - a + 1, F.lit(0)))


def list_set(items: Column, at: int, item: Column) -> Column:
    return F.transform(items, lambda x, k: F.when(k == at, item).otherwise(x))


def list_sort(items: Column, kind: str = "TEXT", descending: bool = False) -> Column:
    """NUMERIC (what is no number counts as 0), TEXT or IGNORE_CASE; equal items keep their order both ways."""
    sort_key = {"NUMERIC": lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)), "TEXT": lambda x: x.cast("string"), "IGNORE_CASE": lambda x: F.lower(x.cast("string"))}[kind]
    # places count down in a descending sort, so one plain sort of (key, place) serves both ways without a comparison in lambdas
    place = (lambda k: -k) if descending else lambda k: k
    keyed = F.transform(items, lambda x, k: F.struct(sort_key(x).alias("s"), place(k).alias("k"), x.alias("x")))
    return F.transform(F.sort_array(keyed, asc=not descending), lambda e: e.x)


def list_split(text: Column, delimiter: str) -> Column:
    """the delimiter is plain text; without one, single characters."""
    return F.split(blank(text), "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E") if delimiter else F.split(blank(text), "")


def list_join(items: Column, delimiter: str) -> Column:
    return F.array_join(F.transform(items, blank), delimiter)


def compare(a: Column, op: str, b: Column) -> Column:
    """F20."""
    return {"EQ": a == b, "NEQ": a != b, "LT": a < b, "LTE": a <= b, "GT": a > b, "GTE": a >= b}[op]


def both(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(False)) & F.coalesce(b, F.lit(False))


def either(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))


def negate(a: Column) -> Column:
    return ~F.coalesce(a, F.lit(False))


def choose(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first condition that holds: ternary, if, else if, else."""
    out = otherwise
    for condition, value in reversed(cases):
        out = F.when(condition, value).otherwise(out)
    return out


def canonical_map(cells: Column) -> Column:
    """a map of cells as JSON with sorted keys and without missing values, to compare as a key."""
    entries = F.array_sort(F.map_entries(F.map_filter(cells, lambda _, v: v.isNotNull())))
    return F.to_json(F.map_from_entries(entries))


def canonical_json(text: Column, schema: str) -> Column:
    """F21 for JSON text of a flat object: parsed as a map, then canonical; null if it is no object."""
    return canonical_map(F.from_json(text, F.lit(schema)))


def canonical_text(text: Column) -> Column:
    """F21 at any depth: JSON text with the keys of all objects sorted (by their bytes) and no white space, so that equal values have equal texts.

    Lists keep their order and nulls; null for what is no JSON, and for an object that has a key twice. Decimals lose trailing zeros; numbers
    with an exponent are doubles.
    """
    return F.to_json(F.try_parse_json(text))


def canonical_value(value: Column) -> Column:
    """F21 for a struct, map or array of any depth: its canonical text; missing values of objects are left out."""
    return canonical_text(F.to_json(value))
