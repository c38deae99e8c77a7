"""Kernels on one graph: k-mer graphs, choice of k, smoothing, widest paths, gene clusters.

A graph is small (one strand and component of one locus), so each kernel works on plain lists.
Node 0 is the source, node 1 the sink, k-mers follow in order of discovery; ties go to lower ids.
"""

from __future__ import annotations

from dataclasses import dataclass, field

SOURCE, SINK = 0, 1
SMALLEST = 1e-10


@dataclass
class KmerGraph:
    """K-mers of paths, joined where they follow each other."""

    names: list = field(default_factory=lambda: [("source",), ("sink",)])
    weight: list[float] = field(default_factory=lambda: [0.0, 0.0])
    ends: list[float] = field(default_factory=lambda: [0.0, 0.0])  # mass that spreads forward
    begins: list[float] = field(default_factory=lambda: [0.0, 0.0])  # mass that spreads backward
    after: list[set] = field(default_factory=lambda: [set(), set()])
    before: list[set] = field(default_factory=lambda: [set(), set()])
    live: set = field(default_factory=set)
    short: list[int] = field(default_factory=list)
    lost_kmers: int = 0
    lost_weight: float = 0.0

    @property
    def valid(self) -> bool:
        return SOURCE in self.live and SINK in self.live


def windows(path: tuple, k: int) -> list[tuple]:
    """All runs of k consecutive nodes."""
    return [path[i : i + k] for i in range(len(path) - k + 1)]


def _closure(start: int, steps: list[set]) -> set:
    seen, todo = {start}, [start]
    while todo:
        for nxt in steps[todo.pop()]:
            if nxt not in seen:
                seen.add(nxt)
                todo.append(nxt)
    return seen


def kmer_graph(paths: list[tuple[tuple, float, bool, bool]], k: int) -> KmerGraph:
    """The graph of k-mers of (path, expression, starts, stops); unreachable k-mers are dropped.

    A path shorter than k is set aside unless it runs from a start to a stop, when it is a node.
    """
    g = KmerGraph()
    ids: dict[tuple, int] = {}
    names, weight, ends, begins, after, before = g.names, g.weight, g.ends, g.begins, g.after, g.before
    for index, (path, expr, starts, stops) in enumerate(paths):
        if len(path) < k and not (starts and stops):
            g.short.append(index)
            continue
        last = SOURCE if starts else None
        if starts:
            weight[SOURCE] += expr
            begins[SOURCE] += expr
        for name in (path,) if len(path) < k else windows(path, k):
            node = ids.get(name)
            if node is None:
                ids[name] = node = len(names)
                names.append(name)
                weight.append(expr)
                ends.append(0.0)
                begins.append(0.0)
                after.append(set())
                before.append(set())
            else:
                weight[node] += expr
            if last is None:
                begins[node] += expr
            else:
                after[last].add(node)
                before[node].add(last)
            last = node
        if stops:
            weight[SINK] += expr
            after[last].add(SINK)
            before[SINK].add(last)
            last = SINK
        ends[last] += expr
    g.live = _closure(SOURCE, g.after) & _closure(SINK, g.before)
    gone = [node for node in range(len(names)) if node not in g.live]
    for node in gone:
        if node > SINK:
            g.lost_kmers += 1
            g.lost_weight += weight[node]
    for steps in (after, before) if gone else ():
        steps[:] = [own & g.live if node in g.live else set() for node, own in enumerate(steps)]
    return g


def score(g: KmerGraph, k: int) -> int:
    """Reachable k-mers, or -k for a graph without a path from source to sink."""
    return len(g.live - {SOURCE, SINK}) if g.valid else -k


def unimodal_maximum(f, low: int, high: int) -> tuple[int | None, float]:
    """The place and value of a maximum, by probing the middle and both quarters.

    Ranges of four points or fewer are scanned; equal values keep the smaller place.
    """
    known: dict[int, float] = {}

    def value(x: int) -> float:
        if x not in known:
            known[x] = f(x)
        return known[x]

    middle = (low + high) // 2
    while high - low > 3:
        left, right = (low + middle) // 2, (middle + high) // 2
        best = max((left, middle, right), key=lambda x: (value(x), -x))
        if best == left and value(left) >= value(middle):
            high, middle = middle, left
        elif best == right:
            low, middle = middle, right
        else:
            low, high = left, right
    if low > high:
        return None, 0
    best = max(range(low, high + 1), key=lambda x: (value(x), -x))
    return best, value(best)


def choose_k(paths: list, kmax: int = 0, loss_threshold: float | None = None) -> tuple[int, list[dict], KmerGraph | None]:
    """The k with most reachable k-mers, a row of figures for every k that was tried, the graph of the first.

    With a ``loss_threshold``, a k whose unreachable k-mers hold a larger share of expression counts
    like a graph without a path.
    """
    longest = max((len(p[0]) for p in paths), default=0)
    top = min(longest, kmax) if kmax else longest
    rows: list[dict] = []
    best: list = [None, None]

    def tried(k: int) -> int:
        g = kmer_graph(paths, k)
        total = sum(g.weight[n] for n in g.live - {SOURCE, SINK})
        lost = g.lost_weight
        rows.append({"k": k, "kmax": top, "transfrags": len(paths), "kmers": len(g.live - {SOURCE, SINK}), "short_transfrags": len(g.short), "lost_kmers": g.lost_kmers, "tot_expr": total, "lost_expr": lost, "lost_expr_frac": lost / total if total else 0.0, "valid": int(g.valid)})
        value = -k if loss_threshold is not None and lost > loss_threshold * total else score(g, k)
        if best[0] is None or (value, -k) > best[0]:
            best[:] = (value, -k), g
        return value

    k, _ = unimodal_maximum(tried, 1, top) if top else (0, 0)
    # The search may end at another k than the best it came by.
    graph = best[1] if best[0] is not None and -best[0][1] == k else kmer_graph(paths, k) if k else None
    return k or 0, rows, graph


def rescue(g: KmerGraph, paths: list) -> int:
    """Share each short path's expression among the k-mers that contain it; the number without any."""
    holders: dict[tuple, set[int]] = {}
    sizes = {len(paths[i][0]) for i in g.short}
    for node in g.live - {SOURCE, SINK}:
        for m in sizes:
            for part in windows(g.names[node], m):
                holders.setdefault(part, set()).add(node)
    gains: list[tuple[int, float]] = []
    lost = 0
    for i in g.short:
        path, expr = paths[i][:2]
        found = sorted(holders.get(path, ()))
        total = sum(g.weight[n] for n in found)
        lost += not found
        gains += [(n, expr * g.weight[n] / total if total else expr / len(found)) for n in found]
    for node, gain in gains:
        g.weight[node] += gain
        g.ends[node] += gain
        g.begins[node] += gain
    return lost


def topological(g: KmerGraph) -> list[int]:
    """Kahn's order of the live nodes, lower ids first."""
    import heapq

    waiting = {n: len(g.before[n]) for n in g.live}
    ready = [n for n, d in waiting.items() if not d]
    heapq.heapify(ready)
    order = []
    while ready:
        node = heapq.heappop(ready)
        order.append(node)
        for nxt in g.after[node]:
            waiting[nxt] -= 1
            if not waiting[nxt]:
                heapq.heappush(ready, nxt)
    return order


def smooth(g: KmerGraph) -> None:
    """Spread what starts or ends inside the graph along it, in proportion to the neighbours."""
    order = topological(g)
    added = [0.0] * len(g.names)
    for walk, steps, mass in ((order, g.after, g.ends), (order[::-1], g.before, g.begins)):
        for node in walk:
            total = sum(g.weight[n] for n in steps[node])
            for nxt in steps[node]:
                part = mass[node] * (g.weight[nxt] / total) if total else mass[node] / len(steps[node])
                mass[nxt] += part
                added[nxt] += part
    for node, gain in enumerate(added):
        g.weight[node] += gain


def widest_paths(g: KmerGraph, path_frac: float = 0.0, max_paths: int = 0) -> list[tuple[list[int], float]]:
    """Source-to-sink paths by falling bottleneck, each taken off before the next is sought."""
    if not g.valid or g.weight[SOURCE] < SMALLEST:
        return []
    order, left = topological(g), list(g.weight)
    out: list[tuple[list[int], float]] = []
    bar = SMALLEST
    while not max_paths or len(out) < max_paths:
        width, via = {SOURCE: left[SOURCE]}, {}
        for node in order:
            if node not in width:
                continue
            for nxt in sorted(g.after[node]):
                through = min(width[node], left[nxt])
                if nxt not in width or through > width[nxt]:
                    width[nxt], via[nxt] = through, node
        flow = width[SINK]
        if out and flow <= bar:
            break
        path = [SINK]
        while path[-1] != SOURCE:
            path.append(via[path[-1]])
        path.reverse()
        for node in path:
            left[node] = max(left[node] - flow, SMALLEST)
        if not out:
            bar = max(flow * path_frac, SMALLEST)
        out.append((path, flow))
    return out


def exons_of(path: list[int], g: KmerGraph, minus: bool) -> list[tuple[int, int]]:
    """Exons of a k-mer path: its nodes in genome order, neighbours that touch joined."""
    return joined(list(g.names[path[1]]) + [g.names[n][-1] for n in path[2:-1]], minus)


def joined(nodes: list[tuple[int, int]], minus: bool) -> list[tuple[int, int]]:
    """Nodes in order of transcription as exons in genome order, neighbours that touch as one."""
    merged: list[tuple[int, int]] = []
    for start, end in reversed(nodes) if minus else nodes:
        if merged and merged[-1][1] == start:
            merged[-1] = (merged[-1][0], end)
        else:
            merged.append((start, end))
    return merged


def gene_clusters(paths: list[tuple[tuple, float]], min_frac: float = 0.0) -> tuple[list[dict], list[tuple]]:
    """Genes (paths that share nodes) in order of discovery, and the paths below ``min_frac``.

    A path that meets a gene is left out if its share of any gene's best path is below the limit.
    """
    genes: list[dict] = []
    dropped = []
    for path, expr in paths:
        met = [g for g in genes if not g["nodes"].isdisjoint(path)]
        if met and any(expr / g["paths"][0][1] < min_frac for g in genes if g["paths"][0][1]):
            dropped.append((path, expr))
            continue
        gene = met[0] if met else {"expr": SMALLEST, "nodes": set(), "paths": []}
        for other in met[1:]:
            gene["expr"] += other["expr"]
            gene["nodes"] |= other["nodes"]
            gene["paths"] += other["paths"]
            genes.remove(other)
        if met:
            gene["paths"].sort(key=lambda p: -p[1])
        else:
            genes.append(gene)
        gene["expr"] += expr
        gene["nodes"] |= set(path)
        gene["paths"].append((path, expr))
    return genes, dropped


def lone(paths: list[tuple[tuple, float, bool, bool]], minus: bool) -> list[dict] | None:
    """The isoform of a graph that is a single path: the path itself, whatever k is chosen."""
    if len(paths) != 1 or paths[0][1] < SMALLEST:
        return None
    (nodes, expr, _, _), *_ = paths
    return [{"gene": 0, "rank": 0, "exons": joined(list(nodes), minus), "expr": expr, "rel_frac": 1.0, "abs_frac": expr / (SMALLEST + expr)}]


def assemble(paths: list[tuple[tuple, float, bool, bool]], minus: bool, isoform_frac: float = 0.05, max_isoforms: int = 0, kmax: int = 0, path_frac: float = 0.0, max_paths: int = 0, loss_threshold: float | None = None) -> tuple[list[dict], list[dict]]:
    """Isoforms of the paths of one splice graph, whose nodes are intervals; the rows of the choice of k."""
    _, tried, g = choose_k(paths, kmax, loss_threshold)
    if g is None or not g.valid:
        return [], tried
    rescue(g, paths)
    smooth(g)
    found = [(tuple(exons_of(p, g, minus)), e) for p, e in widest_paths(g, path_frac, max_paths)]
    rows = []
    for number, gene in enumerate(gene_clusters(found, isoform_frac)[0]):
        best = gene["paths"][0][1]
        for rank, (exons, expr) in enumerate(gene["paths"][: max_isoforms or None]):
            rows.append({"gene": number, "rank": rank, "exons": exons, "expr": expr, "rel_frac": expr / best if best else 0.0, "abs_frac": expr / gene["expr"]})
    return rows, tried
