"""Kernel: the splice graph of one strand of one locus, its components, change points and trimming.

A transfrag is a dict of exons (sorted pairs), expr and is_ref.  Everything here is linear in exons
and nodes, or nearly: nodes are found by bisection among sorted bounds.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np

from . import changepoints


def introns(exons: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [(a[1], b[0]) for a, b in zip(exons, exons[1:])]


def walk(exons: list[tuple[int, int]], bounds: list[int]) -> list[tuple[int, int]]:
    """The nodes that the exons overlap, in genome order."""
    seen: dict[int, None] = {}
    for start, end in exons:
        seen.update(dict.fromkeys(range(bisect_right(bounds, start) - 1, bisect_left(bounds, end))))
    return [(bounds[i], bounds[i + 1]) for i in seen]


def between(sorted_: list[int], start: int, end: int) -> list[int]:
    """Elements above ``start`` up to and with ``end``."""
    return sorted_[bisect_right(sorted_, start) : bisect_right(sorted_, end)]


class SpliceGraph:
    """Nodes between boundaries, walks of transfrags over them in order of transcription, starts and stops.

    ``starts`` and ``stops`` are sites found by change points; they outlive ``build``.
    """

    def __init__(self, transfrags: list[dict], minus: bool, guided_ends: bool = False, guided_assembly: bool = False):
        self.minus, self.guided_ends, self.guided_assembly = minus, guided_ends, guided_assembly
        self.own = [t for t in transfrags if not t.get("is_ref")]
        self.refs = [t for t in transfrags if t.get("is_ref")]
        self.starts: set[int] = set()
        self.stops: set[int] = set()
        self.build()

    @property
    def used(self) -> list[dict]:
        return self.own + self.refs if self.guided_assembly else self.own

    def build(self) -> None:
        """Everything that follows from the transfrags and sites as they are now."""
        every = self.own + self.refs
        self.start = min(t["exons"][0][0] for t in every)
        self.end = max(t["exons"][-1][1] for t in every)
        low, high = ({t["exons"][0][0] for t in self.refs}, {t["exons"][-1][1] for t in self.refs})
        self.ref_starts, self.ref_stops = (sorted(high), sorted(low)) if self.minus else (sorted(low), sorted(high))
        self._cover()
        splices = lambda ts: {p for t in ts for i in introns(t["exons"]) for p in i}
        bounds = {self.start, self.end} | self.starts | self.stops | self._zero | splices(self.own)
        if self.guided_ends:
            bounds |= low | high
        if self.guided_assembly:
            bounds |= splices(self.refs)
        self.bounds = sorted(bounds)
        self.walks = [walk(t["exons"], self.bounds) for t in self.used]
        if self.minus:
            self.walks = [w[::-1] for w in self.walks]
        into = {b for w in self.walks for b in w[1:]}
        out = {a for w in self.walks for a in w[:-1]}
        self.nodes = sorted({n for w in self.walks for n in w})
        self.is_start = {n for n in self.nodes if n not in into}
        self.is_stop = {n for n in self.nodes if n not in out}
        self.is_ref = {n for t, w in zip(self.used, self.walks) if t.get("is_ref") for n in w}
        known = set(self.nodes)
        for sites, found, left in ((self.starts, self.is_start, not self.minus), (self.stops, self.is_stop, self.minus)):
            extra = (self.ref_starts if found is self.is_start else self.ref_stops) if self.guided_ends else []
            for pos in sites | set(extra):
                # The node that begins at the site, or on the other side the one that ends there.
                i = bisect_right(self.bounds, pos) if left else bisect_left(self.bounds, pos)
                if 0 < i < len(self.bounds) and (node := (self.bounds[i - 1], self.bounds[i])) in known:
                    found.add(node)

    def _cover(self) -> None:
        """Positions where coverage changes, its level from each of them on, and where it starts or ends.

        A count decides what is covered; sums of fractions need not cancel to zero.
        """
        at: dict[int, list] = {}
        for t in self.own:
            if t["expr"] > 0:
                for s, e in t["exons"]:
                    for pos, sign in ((s, 1), (e, -1)):
                        step = at.setdefault(pos, [0, 0.0])
                        step[0] += sign
                        step[1] += sign * t["expr"]
        self.steps = sorted(at)
        self.level: list[float] = []
        self._zero: set[int] = set()
        count, total = 0, 0.0
        for pos in self.steps:
            before, (more, change) = count, at[pos]
            count += more
            total = total + change if count else 0.0
            self.level.append(total)
            if (before == 0) != (count == 0):
                self._zero.add(pos)

    def runs(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Levels of summed expression in [start, end), which must lie in the graph, and their lengths."""
        if start < self.start or end > self.end:
            raise ValueError(f"{start}-{end} is outside {self.start}-{self.end}")
        i, j = bisect_right(self.steps, start), bisect_left(self.steps, end)
        levels = [self.level[i - 1] if i else 0.0, *self.level[i:j]]
        # What is left of equal steps up and down is rounding.
        return np.round(levels, 9), np.diff([start, *self.steps[i:j], end])

    def coverage(self, start: int, end: int) -> np.ndarray:
        """Summed expression at every position of [start, end)."""
        return np.repeat(*self.runs(start, end))

    def components(self) -> list["SpliceGraph"]:
        """Weakly connected parts, each a graph of its own transfrags; one part is the graph itself."""
        up = {n: n for n in self.nodes}

        def top(n: tuple) -> tuple:
            while up[n] != n:
                up[n] = n = up[up[n]]
            return n

        for w in self.walks:
            for a, b in zip(w, w[1:]):
                low, high = sorted((top(a), top(b)))
                up[high] = low
        parts: dict[tuple, list[dict]] = {}
        for t, w in zip(self.used, self.walks):
            if w:
                parts.setdefault(top(w[0]), []).append(t)
        if len(parts) == 1:
            return [self]
        return [SpliceGraph(parts[n], self.minus, self.guided_ends, self.guided_assembly) for n in sorted(parts)]

    def change_points(self, pvalue: float, fold: float, compat: bool = False) -> list[dict]:
        """Change points of every node's coverage, in positions of the genome."""
        out = []
        for start, end in self.nodes:
            if end - start < changepoints.LEAST or bisect_right(self.steps, start) == bisect_left(self.steps, end):
                continue  # too short, or level
            for found in changepoints.change_points(self.coverage(start, end), pvalue, fold, compat=compat):
                out.append(found | {k: start + found[k] for k in ("pos", "start", "end")})
        return out

    def apply(self, point: dict, trim: bool = True, ends: tuple[list, list] | None = None) -> None:
        """Make a change point a start or stop site, and cut transfrags that end on its slope.

        ``ends`` are the first and last positions before any cut (from ``outer``).
        """
        falls = point["sign"] < 0
        (self.stops if falls != self.minus else self.starts).add(point["pos"])
        if not trim:
            return
        first, last = ends or self.outer()
        pos = point["pos"]
        for t, a, b in zip(self.own, first, last):
            exons = t["exons"]
            if falls and pos < b <= point["end"] and not pos <= exons[-1][0] <= point["end"]:
                exons[-1] = (exons[-1][0], pos)
            elif not falls and point["start"] <= a < pos and not point["start"] <= exons[0][1] <= pos:
                exons[0] = (pos, exons[0][1])

    def outer(self) -> tuple[list[int], list[int]]:
        return [t["exons"][0][0] for t in self.own], [t["exons"][-1][1] for t in self.own]

    def refine(self, pvalue: float, fold: float, trim: bool = True, compat: bool = False) -> list[dict]:
        """Find change points, apply them all and build the graph again."""
        found = self.change_points(pvalue, fold, compat)
        ends = self.outer()
        for point in found:
            self.apply(point, trim, ends)
        if found:
            self.build()
        return found

    def paths(self) -> list[tuple[tuple, float, bool, bool]]:
        """(nodes, expression, starts, stops) of every transfrag in use."""
        return [(tuple(w), t["expr"], w[0] in self.is_start, w[-1] in self.is_stop) for t, w in zip(self.used, self.walks) if w]

    def node_rows(self) -> list[dict]:
        """Least, largest and mean coverage of each node, and the reference starts and stops in it."""
        rows = []
        for start, end in self.nodes:
            levels, sizes = self.runs(start, end)
            rows.append({"start": start, "end": end, "low": float(levels.min()), "high": float(levels.max()), "mean": float(levels @ sizes / (end - start)), "ref_starts": between(self.ref_starts, start, end), "ref_stops": between(self.ref_stops, start, end)})
        return rows
