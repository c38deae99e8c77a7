"""Lookups in sorted arrays and padded slices, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def bisect_left(a: Column, x: Column) -> Column:
    """How many elements lie below ``x``."""
    return F.size(F.filter(a, lambda v: v < x))


def bisect_right(a: Column, x: Column) -> Column:
    """How many elements lie below or at ``x``."""
    return F.size(F.filter(a, lambda v: v <= x))


def between(a: Column, start: Column, end: Column) -> Column:
    """Elements above ``start`` up to and with ``end``."""
    return F.filter(a, lambda v: (v > start) & (v <= end))


def padded_slice(a: Column, first: Column, start: Column, end: Column) -> Column:
    """Values at positions [start, end) of an array whose first element is at ``first``; 0 outside."""
    value = lambda p: F.coalesce(F.try_element_at(a, (p - first + 1).cast("int")), F.lit(0.0))
    inside = lambda p: F.when((p >= first) & (p < first + F.size(a)), value(p)).otherwise(F.lit(0.0))
    return F.when(start < end, F.transform(F.sequence(start, end - 1), inside)).otherwise(F.array().cast("array<double>"))


def checked_slice(a: Column, first: Column, start: Column, end: Column) -> Column:
    """As ``padded_slice``, but positions outside the array are an error."""
    outside = (start < first) | (end > first + F.size(a))
    return F.when(outside, F.raise_error(F.concat_ws(" ", F.lit("outside the array:"), start.cast("string"), end.cast("string")))).otherwise(F.slice(a, (start - first + 1).cast("int"), (end - start).cast("int")))


def strand_code(strand: Column) -> Column:
    """0 for +, 1 for -, 2 for anything else."""
    return F.when(strand == "+", 0).when(strand == "-", 1).otherwise(2)


def strand_text(code: Column) -> Column:
    return F.when(code == 0, "+").when(code == 1, "-").otherwise(".")


def strand_name(code: Column) -> Column:
    return F.when(code == 0, "pos").when(code == 1, "neg").otherwise("none")
