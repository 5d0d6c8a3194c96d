"""Mixing sources to target weights, in tokens of a public tokenizer.

Method: a low-discrepancy schedule. The slots of the mixture are golden-ratio points in whole numbers,
mapped through the cumulative weights to sources; a source's k-th slot takes its k-th block, and its
blocks are equal numbers of tokens of its shuffled documents, one shuffle after the other while the
source may be repeated. Any stretch of the mixture so holds the sources near their weights.

The total is given, or all tokens of the sources with a target. A source gives at most max_repeats
times its tokens; what it cannot give is left out, not given to others, and reported. Shares sum to
one, so where a source falls short the others necessarily stand above theirs in what is left: a
source within reach meets its target as a share of the total (``share_of_total``), in which what is
missing counts, and keeps its proportion to every other one within reach.

Plan: documents are tokenized in one Arrow-batched pass; only ids and token counts are shuffled. Places
within a source are prefix sums in two steps, over hash buckets and within a bucket, so that a source
that holds a third of all documents is worked on by many tasks; ranks of slots likewise, by ranges.

Defined results: documents with a null or unlisted source and those with null or empty text are not
used; a source without documents reaches 0; repeated rows of a document count once; a document stays
whole and belongs to the block in which it begins.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from math import gcd, isqrt

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.plans.lineage import cut

#: Folder of the public tokenizers' files.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Tokens of a block, documents of a bucket of a source's shuffle, and slots ranked by one task.
BLOCK, BUCKET, STRETCH = 2048, 8192, 8192
SEED = 11
#: Fixed value: the public pattern by which the tokenizer splits a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, tokens) of each document with a source and tokens."""

    # the file goes to the executors with the job: it need not lie at the same path there
    docs.sparkSession.sparkContext.addFile(f"{folder}/{VOCABULARY}")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(SparkFiles.get(VOCABULARY))
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": [len(e.encode_ordinary(t)) for t in b["text"]]})

    usable = docs.where("source is not null AND text <> ''").select("doc_id", "source", "text")
    return usable.mapInPandas(count, "doc_id long, source string, tokens long").where("tokens > 0").groupBy("doc_id").agg(F.min_by("source", "tokens").alias("source"), F.min("tokens").alias("tokens"))


def budgets(counts: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, wanted, given): tokens of each source."""
    have = counts.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("documents"))
    t = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    b = t.join(have, "source", "left").na.fill(0, ["available", "documents"])
    whole = F.lit(total) if total is not None else F.sum("available").over(_all())
    return b.withColumn("total", whole).withColumn("wanted", F.floor(F.col("target_share") * F.col("total"))).withColumn("given", F.least("wanted", F.col("available") * F.col("max_repeats")).cast("long"))


def _all():
    from pyspark.sql import Window

    # one row a source: the list of targets, not the documents
    return Window.partitionBy(F.lit(1))


def placed_documents(counts: DataFrame, budget: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, repeat, begin): the use of each document and the token of its source
    at which it begins; uses that begin beyond the source's budget are left out."""
    passes = budget.where("given > 0").select("source", "given", "available", F.greatest(F.ceil(F.col("documents") / BUCKET), F.lit(1)).alias("buckets"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("given") / F.col("available")).cast("int") - 1)).alias("repeat"))
    uses = counts.join(passes, "source").withColumn("h", F.xxhash64("doc_id", "repeat", F.lit(SEED))).withColumn("bucket", F.pmod("h", F.col("buckets"))).drop("buckets")
    uses = cut(uses)
    sums = uses.groupBy("source", "repeat", "bucket").agg(F.sum("tokens").alias("n"))
    before = sums.selectExpr("source", "repeat", "bucket", "coalesce(sum(n) OVER (PARTITION BY source ORDER BY repeat, bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")
    at = uses.join(before, ["source", "repeat", "bucket"])
    begun = at.selectExpr("doc_id", "source", "tokens", "repeat", "given", "before + coalesce(sum(tokens) OVER (PARTITION BY source, repeat, bucket ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin")
    return begun.where("begin < given").drop("given")


def _golden_step(n: int) -> int:
    """The number nearest to n over the golden ratio without a divisor in common with n."""
    root = isqrt(5 * n * n)
    near = (root - n) // 2
    return next(a for d in range(n + 1) for a in (near + d, near - d) if 0 < a <= n and gcd(a, n) == 1)


def slots(budget: DataFrame) -> DataFrame:
    """(slot, source, block): the schedule. Each source has exactly as many slots as its budget has blocks.

    Of n slots, slot i has the point i * step mod n, with step next to n over the golden ratio and prime to
    n: the golden-ratio sequence in whole numbers, which meets every point once. Points are mapped
    through the cumulative numbers of blocks."""
    spark = budget.sparkSession
    rows = [(r.source, -(-r.given // BLOCK)) for r in budget.where("given > 0").orderBy("source").collect()]  # one row a source
    n = sum(k for _, k in rows)
    if not n:
        return spark.createDataFrame([], "slot long, source string, block long")
    step, upto, cases = _golden_step(n), 0, []
    for _, k in rows:
        upto += k
        cases.append(upto)
    # a product of two numbers of 31 bits is a long, any other of up to 38 digits a decimal
    point = F.expr(f"id * {step}L % {n}L") if n < 1 << 31 else F.expr(f"CAST(CAST(id AS DECIMAL(19,0)) * CAST({step} AS DECIMAL(19,0)) % CAST({n} AS DECIMAL(19,0)) AS BIGINT)")
    source = F.coalesce(*[F.when(F.col("point") < F.lit(b), F.lit(s)) for (s, _), b in zip(rows[:-1], cases, strict=False)], F.lit(rows[-1][0]))
    drawn = spark.range(n).withColumn("point", point).withColumn("source", source).withColumn("stretch", F.expr(f"id div {STRETCH}"))
    tally = drawn.groupBy("source", "stretch").agg(F.count("*").alias("k"))
    before = tally.selectExpr("source", "stretch", "coalesce(sum(k) OVER (PARTITION BY source ORDER BY stretch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")
    return drawn.join(before, ["source", "stretch"]).selectExpr("id AS slot", "source", "before + row_number() OVER (PARTITION BY source, stretch ORDER BY id) - 1 AS block")


def schedule(docs: DataFrame, targets: DataFrame, total: int | None = None, folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """(mixture, budget). mixture: (slot, source, block, begin, doc_id, repeat, tokens) in the order of
    slot, then begin. Every block has a slot of its own."""
    counts = cut(token_counts(docs, folder))
    budget = cut(budgets(counts, targets, total))
    placed = placed_documents(counts, budget).withColumn("block", F.expr(f"begin div {BLOCK}"))
    return placed.join(slots(budget), ["source", "block"]).select("slot", "source", "block", "begin", "doc_id", "repeat", "tokens"), budget


def report(mixture: DataFrame, budget: DataFrame) -> DataFrame:
    """One row a source: its target and reached share, tokens, uses, documents, the most uses of one
    document, and whether the target was within reach."""
    per_doc = mixture.groupBy("source", "doc_id").agg(F.count("*").alias("k"), F.sum("tokens").alias("n"))
    used = per_doc.groupBy("source").agg(F.sum("n").alias("tokens"), F.sum("k").alias("uses"), F.count("*").alias("documents_used"), F.max("k").alias("most_repeats"))
    b = budget.join(used, "source", "left").na.fill(0, ["tokens", "uses", "documents_used", "most_repeats"])
    reached = F.col("tokens") / F.nullif(F.sum("tokens").over(_all()), F.lit(0))
    return b.select("source", "target_share", F.round(reached, 6).alias("reached_share"), F.round(F.col("tokens") / F.nullif("total", F.lit(0)), 6).alias("share_of_total"), "max_repeats", "most_repeats", "documents", "documents_used", "uses", "available", "wanted", "tokens", (F.col("given") >= F.col("wanted")).alias("within_reach"))
