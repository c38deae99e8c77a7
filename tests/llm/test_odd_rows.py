"""Every row-wise operator on null, empty, very long and repeated texts, with columns whose names clash."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import html_extract, langid, neardup, packing, quality, repetition, secrets, trie_bpe

tokenizers = pytest.importorskip("public_tokenizers")
CLASHING = ["score", "lang_pred", "held_out", "spans", "base", "kind", "n_words", "kept", "coverage", "ids", "decoded", "n", "key", "bucket", "component", "component_id", "n_shingles", "start", "length", "offset", "sequence_id", "doc_tokens", "_n", "id", "a", "b"]


@pytest.fixture(scope="module")
def plain(spark):
    rng = np.random.default_rng(21)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 7))) for _ in range(300)]
    long = " ".join(rng.choice(words, 60000))
    rows = [(1, None), (2, ""), (3, "   "), (4, long), (5, "one text, twice"), (5, "one text, twice"), (6, long + " end"), (None, "without an id")]
    rows += [(10 + k, " ".join(rng.choice(words, 80))) for k in range(6)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def operators(spark, plain):
    path = tokenizers.path
    learn = plain.where("doc_id >= 10").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    net, table = langid.train(learn, learnable=F.lit(True)), secrets.markov_table(plain)
    model = quality.PositiveUnlabelled(0.4)
    return {
        "quality": lambda d: quality.score(d, model),
        "secrets": lambda d: secrets.digest(secrets.find_secrets(d, table)),
        "language": lambda d: langid.predict(d, net),
        "duplicates": lambda d: neardup.near_duplicates(d, 3, 85),
        "repetition": repetition.repetition_rules,
        "bpe": lambda d: trie_bpe.encode_decode(d, path("word_bpe_49k.json")),
        "packing": lambda d: packing.pack(d, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).groupBy("doc_id").agg(F.sum("length").alias("size"), F.max("doc_tokens").alias("tokens")),
        "pages": lambda d: html_extract.extract(d.withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.lit("u"))).withColumnRenamed("page_id", "doc_id"),
    }


def found(df):
    return sorted(str(r) for r in df.collect())


@pytest.mark.parametrize("name", ["quality", "secrets", "language", "duplicates", "repetition", "bpe", "packing", "pages"])
def test_rows_of_all_kinds(plain, operators, name):
    run = operators[name]
    want = run(plain)
    clashing = plain.select("*", *[F.lit(k).cast("string").alias(c) for k, c in enumerate(CLASHING)])
    assert found(run(clashing)) == found(want)
    got = want.collect()
    if name == "packing":
        assert {r["doc_id"] for r in got} == {r["doc_id"] for r in plain.collect()}
        assert {r["doc_id"]: r["size"] for r in got}[5] == 2 * {r["doc_id"]: r["tokens"] for r in got}[5]
    elif name == "duplicates":
        by = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got}
        assert by[6][0] == by[4][0] == 4 and by[4][1] > 50000 and by[1] == (1, 0) and by[3] == (3, 0)
    else:
        assert len(got) == plain.count()
        assert len({str(r) for r in got if r["doc_id"] == 5}) == 1


def test_first_of_equal_containers():
    text = "A paragraph, of one length, in two boxes that are alike in all."
    page = f"<body><table><tr><td><p>{text}</p></td></tr></table><table><tr><td><p>{text}</p></td></tr></table></body>"
    assert html_extract.main_text(page) == html_extract.main_text(page) and html_extract.main_text(page).startswith(text)
