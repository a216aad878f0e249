"""Mixtures of sources with target shares of the tokens."""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.prefix import prefix_sum
from tributary.session import materialise

TOKENIZERS = os.environ.get("TRIBUTARY_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def token_counts(docs: DataFrame, key: str, text: str, *keep: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, *keep, tokens): tokens of each text under a public byte-level tokenizer; null and empty texts have 0.

    ``tokenizers`` is the folder of the vocabulary files, read by each executor.
    """
    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in (key, *keep))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        sys.path.insert(0, tokenizers)
        import public_tokenizers as P

        with open(os.path.join(tokenizers, vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("corpus", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if isinstance(t, str) else 0 for t in b[text]]
            yield b.drop(columns=[text]).assign(tokens=pd.Series(n, dtype="int64", index=b.index))

    return docs.select(key, *keep, text).mapInPandas(run, f"{fields}, tokens long")


def mixture(sized: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", seed: str = "mix") -> DataFrame:
    """(key, source, tokens, times): how often each chosen document is used.

    The size of the mixture is the largest at which every source can give its share without using a
    document more often than ``max_repeat``. Each source's documents take a hash-random order; whole
    rounds over the source come first, and the rest is cut where the running sum of tokens comes nearest to
    the budget. Sources with a target of 0, of no tokens or absent from ``targets``, null sources and documents of
    no tokens take no part; equal texts under different keys are different documents. A target source
    without documents makes the mixture impossible and gives no rows. Running sums come from a range sort, so
    a source with a third of all rows spreads over many tasks.
    """
    t = targets.where(F.col("target_share") > 0).select(F.col(source).alias("__s"), "target_share", "max_repeat")
    live = sized.where((F.col("tokens") > 0) & F.col(source).isNotNull())
    live = materialise(live.withColumn("__h", F.xxhash64(F.col(key).cast("string"), F.lit(seed))), "sized")
    totals = live.groupBy(F.col(source).alias("__src")).agg(F.sum("tokens").alias("__have"))
    budget = t.join(totals, F.col("__s") == F.col("__src"), "left")
    size = budget.agg(F.min(F.coalesce("__have", F.lit(0)) * F.col("max_repeat") / F.col("target_share"))).first()[0] or 0.0
    budget = budget.select("__s", "__have", (F.lit(float(size)) * F.col("target_share")).alias("__budget"), "max_repeat")
    budget = budget.withColumn("__rounds", F.least(F.floor(F.col("__budget") / F.col("__have") + F.lit(1e-9)), F.col("max_repeat").cast("long")))
    budget = budget.withColumn("__rest", F.greatest(F.lit(0.0), F.col("__budget") - F.col("__rounds") * F.col("__have")))
    run = prefix_sum(live, [source], ["__h", key], "tokens", "__upto")
    run = run.join(F.broadcast(budget), run[source] == budget["__s"])  # one row per source of the targets
    # a document is in when at least half of it lies below the cut
    extra = (F.col("__rounds") < F.col("max_repeat")) & (F.col("__upto") - F.col("tokens") / 2 <= F.col("__rest"))
    times = F.col("__rounds") + F.when(extra, 1).otherwise(0)
    return run.withColumn("times", times.cast("int")).where("times > 0").select(key, source, "tokens", "times")


def share_report(chosen: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """(source, target_share, documents, tokens, share, most_times): what the mixture reached, one row per target."""
    got = chosen.groupBy(F.col(source).alias("__s")).agg(
        F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("times")).alias("tokens"), F.max("times").alias("most_times")
    )
    total = got.agg(F.sum("tokens")).first()[0] or 0
    out = targets.join(F.broadcast(got), F.col(source) == F.col("__s"), "left")
    n = F.coalesce("tokens", F.lit(0))
    return out.select(
        source, "target_share", F.coalesce("documents", F.lit(0)).alias("documents"), n.alias("tokens"),
        F.when(F.lit(total) > 0, n / F.lit(float(total or 1))).alias("share"), F.coalesce("most_times", F.lit(0)).alias("most_times"),
    )
