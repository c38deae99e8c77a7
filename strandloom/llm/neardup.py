"""Near-duplicate documents: SetSketch registers, banding, joint likelihood, exact verification.

1.  A document is the set of its word shingles.  Its sketch has ``REGISTERS`` registers: the
    smallest exponential variate that a hash gives any shingle, on a logarithmic scale of base
    ``BASE``, truncated to 16 bits.  Registers of a union are the larger of each pair, so sketches
    merge, and they agree with a probability that follows the Jaccard similarity.
2.  Documents with equal sets form a class; the least id stands for it from here on.
3.  Bands of registers are hashed into buckets.  Every bucket gets a centre, the member that
    shares most buckets with others, and only links to the centre are tried first, so a large
    group costs a row a member instead of all pairs.
4.  Candidate pairs whose joint maximum-likelihood estimate is far below the threshold go; the
    others are confirmed on the full sets of shingles.
5.  What the centres left apart is tried exactly: in a small bucket, all pairs of different
    components; in a large one, every member is taken as its symmetric difference from the
    centre.  Two sets differ by what their differences from the centre do not share, so pairs
    that share nothing there are similar only if both are linked to the centre already, and the
    others meet on a shingle of their differences' prefixes.  No pair above the threshold that
    shares a bucket is lost.  That a pair of similarity s shares none has the probability
    (1 - s**BAND) ** (REGISTERS / BAND): 6e-11 at 0.85, 5e-8 at 0.8.
6.  Components are the least reachable ids, by minimum labels with pointer jumping.

Nothing is collected to the driver but flags that end loops; hot keys are pre-aggregated, or meet
in joins of plain tables that adaptive execution can split.

Results for odd input: null, empty and wordless texts have an empty set and are linked with
nothing; texts with fewer words than a shingle are one shingle; equal sets are linked whatever the
texts' other differences; rows that share a doc_id count as one document with several sets and
are linked; rows without a doc_id are kept, with a null component; an empty table gives an empty
result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, slices, text_buffer

REGISTERS = 128
BAND = 4
BASE = 1.001
RATE = 20.0
TOP = 65535
#: Buckets of more members are searched by prefixes instead of pair by pair.
LARGE = 48
#: Tasks that share the members of one centre.
SALTS = 64
#: Standard errors below the threshold at which an estimate rules a pair out.
SURE = 5.0

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(9001).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = 0x9E3779B97F4A7C15
_MULTIPLIERS = np.random.default_rng(77).integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a buffer of documents, and each document's bounds among them."""
    n = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    inside = ~_SPACE[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    # A document's first letter starts a word even where the text before ends in one.
    first = offsets[:-1][offsets[:-1] < len(raw)]
    starts[first] |= inside[first]
    at = np.flatnonzero(starts)
    ends_mask = inside.copy()
    ends_mask[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends_mask[last] |= inside[last]
    end = np.flatnonzero(ends_mask) + 1
    # Powers run from each word's start, so a word hashes alike wherever it stands.
    size = end - at
    place = np.arange(len(raw)) - np.repeat(np.concatenate([[0], at]), np.diff(np.concatenate([[0], at, [len(raw)]])))
    longest = int(size.max(initial=1))
    powers = np.cumprod(np.full(longest, _POWER, np.uint64))
    terms = _BYTES[_LOWER[raw]]
    terms *= powers[np.minimum(place, longest - 1)]
    terms[~inside] = 0
    words = np.add.reduceat(terms, at) if len(at) else np.zeros(0, np.uint64)
    bounds = np.searchsorted(at, offsets)
    return mix(words + size.astype(np.uint64)), bounds


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every document."""
    words, bounds = word_hashes(raw, offsets)
    rolled = words.copy()
    for k in range(1, width):
        rolled = mix(rolled[:-1] * np.uint64(3) + words[k:]) if len(rolled) > 1 else rolled[:0]
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for k in range(a, b):
                whole = mix(whole * np.uint64(5) + words[k : k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers of non-empty sets, one row each."""
    flat = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    low = np.empty((len(sets), REGISTERS), np.uint64)
    scratch = np.empty_like(flat)
    for k in range(REGISTERS):
        np.multiply(flat, _MULTIPLIERS[k], out=scratch)
        low[:, k] = np.minimum.reduceat(scratch, first)
    uniform = ((low >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    variate = -np.log1p(-uniform) / RATE
    return np.clip(np.floor(1.0 - np.log(variate) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def joint_estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, grid: int = 101) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of rows of registers whose sets have known sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (size_a / (size_a + size_b))[:, None]
    v = 1.0 - u
    most = np.minimum(u / v, v / u)
    j = most * np.linspace(0.0, 1.0, grid)[None, :]

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    p, q = chance(u - v * j), chance(v - u * j)
    score = more * np.log(np.maximum(p, 1e-12)) + less * np.log(np.maximum(q, 1e-12)) + same * np.log(np.maximum(1 - p - q, 1e-12))
    return np.take_along_axis(j, score.argmax(1)[:, None], 1)[:, 0]


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, key (two longs naming the set) and registers of every document."""
    import hashlib

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                sets = shingle_sets(*text_buffer(part.column("text")), width)
                full = [s for s in sets if len(s)]
                rows = iter(registers(full)) if full else iter(())
                marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(marks, pa.binary()),
                        pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n", "key", "registers"],
                )

    return texts.mapInArrow(run, "doc_id long, n long, key binary, registers binary")


def full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """id and shingles (packed, sorted) of the classes in ``nodes`` (id, key), from the texts."""
    import hashlib

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(nodes, "id")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                sets = [s.tobytes() for s in shingle_sets(*text_buffer(part.column("text")), width)]
                keys = part.column("key").to_pylist()
                keep = [hashlib.blake2b(s, digest_size=16).digest() == k for s, k in zip(sets, keys)]
                ids = [i for i, ok in zip(part.column("id").to_pylist(), keep) if ok]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s for s, ok in zip(sets, keep) if ok], pa.binary())], names=["id", "shingles"])

    return texts.select("id", "key", "text").mapInArrow(run, "id long, shingles binary").groupBy("id").agg(F.min("shingles").alias("shingles"))


def plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, large) that the joint estimate does not rule out; large ones all stay."""
    bar = percent / 100.0 - SURE * (percent / 100.0 * (1 - percent / 100.0) / REGISTERS) ** 0.5

    @F.arrow_udf("boolean")
    def near(ra: pa.Array, rb: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        if not len(ra):
            return pa.array([], pa.bool_())
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(len(c), REGISTERS) for c in (ra, rb))
        n, m = (c.to_numpy(zero_copy_only=False).astype(np.float64) for c in (na, nb))
        out = np.concatenate([joint_estimate(x[k : k + 2048], y[k : k + 2048], n[k : k + 2048], m[k : k + 2048]) for k in range(0, len(x), 2048)])
        return pa.array(out >= bar)

    one = sketches.select(F.col("id").alias("a"), F.col("registers").alias("ra"), F.col("n").alias("na"))
    two = sketches.select(F.col("id").alias("b"), F.col("registers").alias("rb"), F.col("n").alias("nb"))
    sized = pairs.join(one, "a").join(two, "b")
    # Sets whose sizes differ by more than the threshold cannot be that similar.
    fits = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return sized.where(F.col("large") | fits).withColumn("near", near("ra", "rb", "na", "nb")).where("large OR near").select("a", "b", "large")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, linked (exact), a's size, and for large pairs how far a is from b, and the prefix of that.

    ``far`` counts the shingles that a and b do not share, ``prefix`` lists the first of them: those
    of a alone by hash, then those of b alone.  A third set is within the threshold of a, yet apart
    from a's component, only if it shares ``(far - slack * sizes) / 2`` of them, and at least one.
    """
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "large", "sa", "sb")

    def run(batches):
        for batch in batches:
            linked, prefix, sizes, apart = [], [], [], []
            for large, ra, rb in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                x, y = np.frombuffer(ra, np.uint64), np.frombuffer(rb, np.uint64)
                common = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x
                shared = int(common.sum())
                sizes.append(len(x))
                linked.append(100 * shared >= percent * (len(x) + len(y) - shared))
                if large:
                    far = len(x) + len(y) - 2 * shared
                    # A third set's own difference, less its slack, is least at the centre itself.
                    excess = (100 + percent) * far - (100 - percent) * (len(x) + len(y))
                    need = max(1, -(-excess // (2 * (100 + percent))))
                    alone = np.setdiff1d(y, x, assume_unique=True)
                    order = np.concatenate([x[~common], alone])[: max(0, far - need + 1)]
                    apart.append(far)
                    prefix.append(order.view(np.int64).tolist())
                else:
                    apart.append(None)
                    prefix.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(linked, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(apart, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))],
                names=["a", "b", "large", "linked", "n", "far", "prefix"],
            )

    return both.mapInArrow(run, "a long, b long, large boolean, linked boolean, n long, far long, prefix array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b): the least id reachable."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        known = labels.select(F.col("node").alias("b"), F.col("component").alias("low"))
        near = both.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("low").alias("near"))
        least = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("further"))
        moved = least.join(jump, "low", "left").select("node", F.least("low", F.coalesce("further", "low")).alias("component"), F.col("component").alias("was"))
        moved = cut(moved, "labels")
        labels = moved.select("node", "component")
        if moved.where("component <> was").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    table = cut(sketch(docs, width), "sketches")
    classes = table.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("registers").alias("registers")
    )
    classes = cut(classes, "classes")
    bands = REGISTERS // BAND
    buckets = classes.select("id", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"), "registers")
    buckets = buckets.select("id", F.expr(f"xxhash64(band, substring(registers, band * {2 * BAND} + 1, {2 * BAND}))").alias("bucket"))
    stats = cut(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high"), "buckets")
    pairs = stats.where("c = 2").select(F.col("high").alias("a"), F.col("low").alias("b"), F.lit(False).alias("large"))
    members = cut(buckets.join(stats.where("c > 2").select("bucket", "c"), "bucket"), "members")
    popular = members.groupBy("id").agg(F.sum("c").alias("popular"))
    ranked = cut(members.join(popular, "id"), "ranked")
    centres = ranked.groupBy("bucket").agg(F.max("c").alias("c"), F.max_by("id", F.struct("popular", -F.col("id"))).alias("centre"), F.max("popular").alias("top"))
    centres = cut(centres, "centres")
    placed = cut(ranked.select("bucket", "id", "c").join(centres.select("bucket", "centre", "top"), "bucket"), "placed")
    # The large buckets of one family share a centre: each centre hands on to the most popular
    # centre that it meets in its own buckets, twice.
    upper = cut(placed.where(F.col("c") > LARGE).groupBy("id").agg(F.max_by("centre", F.struct("top", -F.col("centre"))).alias("up")), "upper")
    heads = centres.where(F.col("c") > LARGE).select("bucket", "centre")
    for _ in range(2):
        heads = heads.join(upper.select(F.col("id").alias("centre"), "up"), "centre", "left").select("bucket", F.coalesce("up", "centre").alias("centre"))
    heads = cut(heads, "heads")
    large = placed.where(F.col("c") > LARGE).select("bucket", "id").join(heads, "bucket").select(F.col("id").alias("a"), F.col("centre").alias("b"))
    star = placed.where(F.col("id") != F.col("centre")).select(F.col("id").alias("a"), F.col("centre").alias("b"), F.lit(False).alias("large"))
    # The head itself stays among the large rows: others are compared with its prefix too.
    star = star.unionByName(large.withColumn("large", F.lit(True)))
    star = pairs.unionByName(star).groupBy("a", "b").agg(F.max("large").alias("large"))
    tried = cut(plausible(star, classes, percent), "pairs")

    def sets_of(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        return cut(full_sets(docs, ids.join(classes.select("id", "key"), "id"), width), "sets")

    first = cut(confirm(tried, sets_of(tried), percent), "links")
    links = first.where("linked AND a <> b").select("a", "b")
    labels = components(links)
    label = labels.select(F.col("node").alias("id"), "component")

    # What is still apart although it shares a bucket.
    with_label = placed.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = with_label.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    small = cut(with_label.where(F.col("c") <= LARGE).join(mixed, "bucket").select("bucket", "id", "component", "centre"), "apart")
    other = small.select("bucket", F.col("id").alias("b"), F.col("component").alias("cb"))
    near = small.select("bucket", F.col("id").alias("a"), F.col("component").alias("ca"), "centre").join(other, "bucket").where("a < b AND ca <> cb AND a <> centre AND b <> centre").select("a", "b")
    rows = first.where("large").select(F.col("a").alias("id"), F.col("b").alias("centre"), "n", "far", "prefix")
    rows = rows.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = rows.groupBy("centre").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("centre")
    # One centre may head a large part of all rows: its members are dealt over several tasks.
    split = split.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    stems = salted.join(split, ["centre", "salt"]).select("centre", "id", "n", "far", "component", F.posexplode("prefix").alias("at", "stem"))
    groups = stems.groupBy("centre", "stem").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("centre", "stem")
    stems = cut(stems.join(groups, ["centre", "stem"]), "stems")
    one, two = (stems.select("centre", "stem", *(F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "far", "component", "at"))) for side in "ab")
    # Sizes must be near enough, and what follows the shared stem enough to bring the two together.
    fits = f"""id_a < id_b AND component_a <> component_b AND 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)
        AND {100 + percent} * (far_a + far_b - 2 * least(far_a - at_a, far_b - at_b)) <= {100 - percent} * (n_a + n_b)"""
    far = one.join(two, ["centre", "stem"]).where(fits).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    rest = near.unionByName(far).distinct().withColumn("large", F.lit(False))
    rest = cut(plausible(rest, classes, percent), "rest")
    if not rest.isEmpty():
        more = cut(confirm(rest, sets_of(rest), percent).where("linked").select("a", "b"), "more")
        if not more.isEmpty():
            labels = components(links.unionByName(more))

    # Rows that share a doc_id link their classes; the least id of a class is one of its rows'.
    named = classes.select("key", "id").join(labels.select(F.col("node").alias("id"), "component"), "id", "left").select("key", F.coalesce("component", "id").alias("component"))
    named = cut(named, "named")
    out = table.join(named, "key", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("component_id").isNull() | (F.col("component_id") == F.col("doc_id")))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one of the least id, all columns kept.

    Rows without an id stay; of rows of equal id and text one stays; rows that share an id but not their
    text stay together or go together.
    """
    dropped = near_duplicates(docs.select("doc_id", "text"), width, percent).where("NOT kept").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(dropped, "doc_id", "left_anti").select(docs.columns)
    same = F.struct(F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b"), F.col("text").isNull().alias("c"))
    return named.withColumn("_same", same).dropDuplicates(["doc_id", "_same"]).drop("_same").unionByName(docs.where("doc_id IS NULL"))
