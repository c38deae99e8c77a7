"""Secret scanning: fixed patterns, and character Markov models compared by log-likelihood ratio.

Everything runs as DataFrame expressions.  Two first-order Markov models over a fixed alphabet are
trained, one on random strings, one on ordinary identifiers; a run of characters is a secret if
the ratio of its likelihoods exceeds a threshold, or else those of its stretches whose ratio does.  The labelled samples are keyed digests in the usual
encodings (random by construction) and words of a bounded, hashed sample of documents, alone and
joined in the styles of identifiers.

Results for odd input: null text counts as empty and has no spans; overlapping kinds keep all base
spans, base spans are cut out of a run before the models see it; text length is not limited;
repeated rows get equal results; an empty table gives an empty result (and models of the digests
alone); other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .spans import SPAN, in_chunks, match_spans, written

# The base patterns, in the order of the kinds.
KINDS = ["assign", "access", "hex"]
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

_RUN = "A-Za-z0-9+/_=-"
LEAST = 16
#: Runs of LEAST or more that hold a letter.
CANDIDATE = rf"(?<![{_RUN}])(?=[{_RUN}]{{{LEAST}}})(?=[0-9+/_=-]*+[A-Za-z])[{_RUN}]+"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
ALNUM = ALPHABET[:62]
SIDE = len(ALPHABET) + 1
RATIO = 12.0
# Words of ordinary identifiers, beside those of the corpus.
WORDS = """account action array batch buffer cache callback channel client column command config content context
controller count current data database default delete description device document element error event example factory
field file filter function group handler header height image index input instance iterator key language length level
library list listener local manager map message method model module name network node number object offset option order
output package page parameter parser password path pattern point position process property provider query queue record
reference request resource response result return root schema script search section select server service session
setting source state status stream string style system table target task template test text thread time token type
update user utility value version view width window worker""".split()


def _pair_counts(strings: DataFrame) -> dict[tuple[str, str], int]:
    """Counts of neighbouring characters; at most the square of the alphabet's rows."""
    chars = strings.select(F.split("s", "").alias("c")).where(F.size("c") > 1)
    pairs = chars.select(F.explode(F.expr("transform(sequence(1, size(c) - 1), i -> struct(c[i - 1] AS a, c[i] AS b))")).alias("p"))
    known = F.col("p.a").isin(*ALPHABET) & F.col("p.b").isin(*ALPHABET)
    return {(r["a"], r["b"]): r["n"] for r in pairs.where(known).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).collect()}


def labelled_samples(docs: DataFrame, most_docs: int = 300) -> tuple[DataFrame, DataFrame]:
    """(random strings, ordinary identifiers), each with one column ``s``.

    The words are those of about ``most_docs`` whole documents, drawn by a hash of the id.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    digests = spark.range(0, 3000, 1, 2)
    random = digests.select(
        F.explode(F.array(digest, F.upper(digest), F.base64(F.unhex(digest)), F.translate(F.base64(F.unhex(digest)), "+/=", "-_"))).alias("s")
    )
    total = docs.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("identifiers")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    words = docs.where(draw < (most_docs / total if total else 1.0)).select(
        F.expr("array_distinct(regexp_extract_all(text, '[A-Za-z]{4,}', 0))").alias("w")
    )
    fixed = [WORDS[k:] + WORDS[:k] for k in range(0, len(WORDS), 7)]
    words = words.unionByName(spark.createDataFrame([(w,) for w in fixed], "w array<string>"))
    pair = words.where(F.size("w") > 1).select(F.explode(F.expr("transform(sequence(1, size(w) - 1), i -> struct(w[i - 1] AS a, w[i] AS b))")).alias("p"))
    a, b = F.col("p.a"), F.col("p.b")
    styles = F.array(
        a, F.lower(a), F.upper(a), F.concat_ws("_", F.lower(a), F.lower(b)), F.concat_ws("_", F.upper(a), F.upper(b)),
        F.concat(F.lower(a), F.initcap(b)), F.concat(F.initcap(a), F.initcap(b)), F.concat_ws("-", F.lower(a), F.lower(b)),
        F.concat(F.lower(a), F.lit("_2")), F.concat(F.lower(a), F.lit("/"), F.lower(b)), F.concat(F.initcap(a), F.lit("2024")),
    )
    return random, pair.select(F.explode(styles).alias("s"))


def markov_table(docs: DataFrame) -> list[float]:
    """Log-likelihood ratios of character pairs, random over ordinary, row by row of SIDE columns.

    Row and column 0 stand for any character outside the alphabet and hold zeros.
    """
    random, ordinary = map(_pair_counts, labelled_samples(docs))

    def conditional(counts: dict) -> dict:
        out = {}
        for a in ALPHABET:
            total = sum(counts.get((a, b), 0) for b in ALPHABET) + len(ALPHABET)
            out |= {(a, b): math.log((counts.get((a, b), 0) + 1) / total) for b in ALPHABET}
        return out

    p, q = conditional(random), conditional(ordinary)
    table = [0.0] * (SIDE * SIDE)
    for i, a in enumerate(ALPHABET, 1):
        for j, b in enumerate(ALPHABET, 1):
            table[i * SIDE + j] = round(p[a, b] - q[a, b], 4)
    return table


def _pieces(tokens: str, base: str) -> Column:
    """What base spans leave of candidate runs, where it is long enough."""
    return F.expr(
        f"""filter(flatten(transform({tokens}, t -> aggregate({base},
          named_struct('at', t.start, 'out', CAST(array() AS {SPAN})),
          (s, b) -> IF(b.start < t.end AND t.start < b.end,
            named_struct('at', greatest(s.at, b.end), 'out', concat(s.out, array(named_struct('start', s.at, 'kind', t.kind, 'end', b.start)))),
            s),
          s -> concat(s.out, array(named_struct('start', s.at, 'kind', t.kind, 'end', t.end)))))), p -> p.end - p.start >= {LEAST})"""
    )


def _stretches(text: str, pieces: str, table: list[float], ratio: float) -> Column:
    """Spans of the pieces whose ratio exceeds ``ratio``, or else of their stretches that do.

    A stretch starts where the running sum was last at or below 0 and ends at its highest place;
    it is complete once the sum has fallen by ``ratio`` from there.  It is widened to whole words
    of letters and digits, and must then hold a letter and LEAST characters.
    """
    values = f"CAST(split('{' '.join(map(str, table))}', ' ') AS array<double>)"
    empty = "CAST(array() AS array<struct<a:int,b:int>>)"
    found = f"IF(s.best > {ratio}, concat(s.out, array(named_struct('a', s.first, 'b', s.last))), s.out)"
    # The sum that the next pair is added to: begun again after a stretch is complete or worth nothing.
    again = f"(s.sum <= 0 OR s.best - s.sum >= {ratio})"
    step = f"""named_struct('i', s.i + 1, 'before', k, 'all', s.all + v, 'sum', IF({again}, 0, s.sum) + v,
        'begin', IF({again}, greatest(s.i - 1, 0), s.begin),
        'best', IF({again}, greatest(v, 0), greatest(s.best, s.sum + v)),
        'first', IF({again}, greatest(s.i - 1, 0), IF(s.sum + v > s.best, s.begin, s.first)),
        'last', IF({again} OR s.sum + v > s.best, s.i + 1, s.last),
        'out', IF({again}, {found}, s.out))"""
    pair = f"element_at({values}, s.before * {SIDE} + k + 1)"
    zero = "CAST(0 AS double)"
    spans = f"""aggregate(
        transform(split(t, ''), c -> instr('{ALPHABET}', c)),
        named_struct('i', 0, 'before', 0, 'all', {zero}, 'sum', {zero}, 'begin', 0, 'best', {zero}, 'first', 0, 'last', 0, 'out', {empty}),
        (s, k) -> element_at(transform(array({pair}), v -> {step}), 1),
        s -> IF(s.all > {ratio}, array(named_struct('a', 0, 'b', s.i)), {found}))"""
    wide = f"""transform({spans}, x -> named_struct(
        'a', length(trim(TRAILING '{ALNUM}' FROM substring(t, 1, x.a))),
        'b', length(t) - length(trim(LEADING '{ALNUM}' FROM substring(t, x.b + 1)))))"""
    joined = f"""aggregate({wide}, {empty}, (o, x) -> IF(size(o) > 0 AND element_at(o, -1).b > x.a,
        concat(slice(o, 1, size(o) - 1), array(named_struct('a', element_at(o, -1).a, 'b', greatest(element_at(o, -1).b, x.b)))),
        concat(o, array(x))))"""
    good = f"filter({joined}, x -> x.b - x.a >= {LEAST} AND substring(t, x.a + 1, x.b - x.a) RLIKE '[A-Za-z]')"
    return F.expr(
        f"""flatten(transform({pieces}, p -> element_at(transform(array(substring({text}, p.start + 1, p.end - p.start)), t ->
          transform({good}, x -> named_struct('start', p.start + x.a, 'kind', p.kind, 'end', p.start + x.b))), 1)))"""
    )


def find_secrets(docs: DataFrame, table: list[float] | None = None, ratio: float = RATIO, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, text, base (spans of the fixed patterns) and spans (with the model's), sorted.

    Spans are structs (start, kind, end); kind counts through ``KINDS``, the model's is the last.
    """
    table = markov_table(docs) if table is None else table
    base = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    base = base.select(*keep, "text", F.array_sort(F.concat(match_spans("text", ASSIGN, 0, 2, 6), match_spans("text", ACCESS, 1), match_spans("text", HEX, 2))).alias("base"))
    tokens = base.withColumn("_tokens", match_spans("text", CANDIDATE, len(KINDS)))
    free = tokens.withColumn("_pieces", F.when(F.size("_tokens") > 0, _pieces("_tokens", "base")))
    added = F.when(F.size("_pieces") > 0, _stretches("text", "_pieces", table, ratio)).otherwise(F.expr(f"CAST(array() AS {SPAN})"))
    return free.select(*keep, "text", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``find_secrets``."""
    names = [*KINDS, "markov"]
    count = lambda k: F.expr(f"CAST(size(filter(base, s -> s.kind = {k})) AS long)")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(written("base", names).cast("binary"), 256).alias("base_sha256"),
        written("spans", names).alias("spans"),
    )


def redacted(text: str = "text", spans: str = "spans", mark: str = "[SECRET]") -> Column:
    """The text with every stretch of overlapping spans replaced by a mark."""
    # Kept stretches lie between the reach of earlier spans and the next start beyond it.
    step = f"""(s, x) -> named_struct('at', greatest(s.at, x.end),
        'out', IF(x.start >= s.at, concat(s.out, array(substring({text}, s.at + 1, x.start - s.at))), s.out))"""
    pieces = in_chunks(f"{spans}", "0", "array<string>", step)
    return F.expr(
        f"""CASE WHEN size({spans}) = 0 THEN {text} ELSE
          concat(array_join({pieces}, '{mark}'), '{mark}', substring({text}, 1 + aggregate({spans}, 0, (m, x) -> greatest(m, x.end)))) END"""
    )
