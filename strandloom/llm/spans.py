"""Native span arithmetic: matches of a regular expression with their code point offsets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPAN = "array<struct<start:int,kind:int,end:int>>"


def quoted(pattern: str) -> str:
    """A Java pattern as a SQL string literal; single quotes become their hexadecimal escape."""
    return "'" + pattern.replace("'", r"\x27").replace("\\", "\\\\") + "'"


def in_chunks(items: str, at: str, kind: str, step: str, chunk: int = 128) -> str:
    """SQL of what ``step`` collects in ``out`` (of type ``kind``) over an array, ``at`` carried along.

    Appending copies an array, so results are collected by chunks and joined once: long texts with
    many matches cost little more than their length.
    """
    inner = f"aggregate(chunk, named_struct('at', t.at, 'out', CAST(array() AS {kind})), {step})"
    return f"""flatten(aggregate(
        transform(sequence(0, greatest(size({items}) - 1, 0) div {chunk}), k -> slice({items}, CAST(k AS int) * {chunk} + 1, {chunk})),
        named_struct('at', {at}, 'out', CAST(array() AS array<{kind}>)),
        (t, chunk) -> element_at(transform(array({inner}), r -> named_struct('at', r.at, 'out', concat(t.out, array(r.out)))), 1),
        t -> t.out))"""


def match_spans(text: str, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches in column ``text`` whose ``group`` has ``least`` characters.

    Offsets are sums of the lengths of what lies between matches and of the matches, so one pass
    over the pieces gives them; Spark counts code points.
    """
    p = quoted(pattern)
    found = f"""zip_with(
          filter(arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0)), x -> x['1'] IS NOT NULL),
          regexp_extract_all({text}, {p}, {group}),
          (x, g) -> named_struct('gap', length(x['0']), 'size', length(x['1']), 'ok', length(g) >= {least}))"""
    step = f"""(s, x) -> named_struct('at', s.at + x.gap + x.size,
          'out', IF(x.ok, concat(s.out, array(named_struct('start', s.at + x.gap, 'kind', {kind}, 'end', s.at + x.gap + x.size))), s.out))"""
    spans = f"element_at(transform(array({found}), m -> {in_chunks('m', '0', SPAN, step)}), 1)"
    return F.expr(f"CASE WHEN {text} RLIKE {p} THEN {spans} ELSE CAST(array() AS {SPAN}) END")


def written(spans: str, names: list[str]) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    listed = ", ".join(f"'{n}'" for n in names)
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array({listed}), s.kind + 1), ':', s.start, ':', s.end)), ',')")
