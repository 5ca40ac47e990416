"""Column functions on numeric arrays; all of them are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the largest error that passes.
TOLERANCE = 0.11


def quantize(x: Column, scale: float, zero_point: int, lo: int, hi: int) -> Column:
    """saturate(round_half_even(x / scale) + zero_point). NaN saturates to lo; clamped before the cast."""
    q = F.rint(x.cast("double") / F.lit(float(scale))) + F.lit(float(zero_point))
    q = F.when(F.isnan(q), F.lit(float(lo))).otherwise(q)
    return F.least(F.greatest(q, F.lit(float(lo))), F.lit(float(hi))).cast("int")


def dequantize(q: Column, scale: float, zero_point: int) -> Column:
    return (q - F.lit(zero_point)).cast("double") * F.lit(float(scale))


def errors(output: Column, expected: Column) -> Column:
    """Elementwise |output - expected| over the expected length; NULL where the output is too short."""
    cut = F.slice(output, F.lit(1), F.size(expected))
    diff = F.zip_with(cut, expected, lambda a, b: F.abs(a - b))
    return F.when(F.size(output) >= F.size(expected), diff)


def _if_whole(values: Column, result: Column) -> Column:
    """The result, or NULL where an element is NULL; folds and greatest would pass over it."""
    return F.when(~F.exists(values, lambda v: v.isNull()), result)


def max_error(errs: Column, nan_policy: str = "fail") -> Column:
    """Largest error, 0 for an empty array, NULL if any error is unknown.

    nan_policy 'fail' lets NaN win, 'ignore' passes over it.
    """
    if nan_policy not in ("fail", "ignore"):
        raise ValueError(f"nan_policy: {nan_policy}")
    zero = F.lit(0.0)
    wide = F.transform(errs, lambda e: e.cast("double"))
    if nan_policy == "ignore":
        folded = F.aggregate(wide, zero, lambda m, e: F.when(F.isnan(e), m).otherwise(F.greatest(m, e)))
    else:
        folded = F.aggregate(wide, zero, lambda m, e: F.greatest(m, e))
    return _if_whole(errs, folded)


def within(error: Column, tolerance: float = TOLERANCE) -> Column:
    """Strict bound: an error equal to the tolerance passes; an unknown error does not."""
    return F.coalesce(~(error > F.lit(float(tolerance))), F.lit(False))


def max_abs(values: Column) -> Column:
    """Largest absolute value, 0 for an empty array, NULL if an element is NULL."""
    return _if_whole(values, F.aggregate(values, F.lit(0.0).cast("float"), lambda m, v: F.greatest(m, F.abs(v))))


def pick(values: Column, index: int, strict: bool = True) -> Column:
    """0-based element; strict raises out of range, lenient gives NULL."""
    return values[index] if strict else F.get(values, F.lit(index))


def tensor(*values: Column) -> Column:
    """A rank-1 float32 tensor."""
    return F.array(*[v.cast("float") for v in values])


def render(values: Column) -> Column:
    return values.cast("string")


def nanos_to_millis(ns: Column) -> Column:
    return ns / F.lit(1000000.0)


def fixed3(value: Column) -> Column:
    return F.format_string("%.3f", value.cast("double"))


def join_path(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def concat(*parts: Column | str) -> Column:
    """Texts and values one after the other; a string is a literal, a value that is NULL reads 'null'."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])


def dedent(text: Column) -> Column:
    """Without the indent that all lines with text share, and without a blank first and last line."""
    lines = F.split(text, "\n", -1)
    has_text = lambda line: F.rlike(line, F.lit(r"\S"))
    indents = F.transform(F.filter(lines, has_text), lambda line: F.length(F.regexp_extract(line, r"^\s*", 0)))
    shared = F.coalesce(F.array_min(indents), F.lit(0))
    inner = F.filter(lines, lambda line, i: has_text(line) | ((i > 0) & (i < F.size(lines) - 1)))
    return F.array_join(F.transform(inner, lambda line: F.substring(line, shared + 1, F.length(line))), "\n")


def option_map(options: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in options.items() for x in kv])


def first_match(*rules: tuple[Column, Column], default: Column) -> Column:
    """The value of the first rule that holds."""
    out = F.when(*rules[0]) if rules else None
    for cond, value in rules[1:]:
        out = out.when(cond, value)
    return default if out is None else out.otherwise(default)
