"""Mixing sources to target shares of a total token count, small ones repeated at most so often.

Each document gets an Efraimidis-Spirakis key: an exponential variate divided by its quality weight. Within a source, documents
ordered by key and prefix-summed fill the fractional part of its budget; whole epochs come before it. Prefix sums are made in
two levels, over key buckets first and inside the one bucket where the budget ends, so that no source gathers in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamisol.llm import quality
from tamisol.session import materialise

#: Key buckets per doubling of the key; the tokenizer's file in the folder of public tokenizers; seed of the keys.
BUCKETS, VOCABULARY, SEED = 1 << 10, "/opt/tokenizers/byte_bpe_50k.tiktoken", 20
# Fixed value: the splitting pattern that belongs to the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counter(path: str):
    """A function from texts to their numbers of tokens, for the ranks in ``path``."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    encode = encoding.encode_ordinary

    def count(texts: list[str | None]) -> list[int]:
        return [len(encode(t)) if t else 0 for t in texts]

    return count


#: Weight of the least likely prose, so that no document is out of reach.
LEAST = 0.01


def with_tokens(docs: DataFrame, common_words: DataFrame | None = None, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens, weight) of every document with a source; one row per doc_id. Whole texts are tokenised; the weight is the
    posterior of prose that the mixture of ``quality`` gives, LEAST at least, or 1 for all where there are no ``common_words``."""
    made: list = []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").filter(F.col("source").isNotNull() & F.col("doc_id").isNotNull())
    common = quality.by_language(common_words) if common_words is not None else None
    judged = quality.STATISTICS if common is not None else []

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(token_counter(path))
        for b in batches:
            texts = b.column(2).to_pylist()
            stats = [quality.statistics(t, common) for t in texts] if judged else []
            cols = zip(*stats, strict=True) if stats else [[]] * len(judged)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made[0](texts), pa.int64()), *(pa.array(c, pa.float64()) for c in cols)], ["doc_id", "source", "tokens", *judged])

    counted = rows.mapInArrow(scan, "doc_id long, source string, tokens long" + "".join(f", {s} double" for s in judged))
    if not judged:
        return counted.withColumn("weight", F.lit(1.0))
    # texts are read once; the mixture is fitted on the numbers of all documents
    return quality.with_prose(materialise(counted, "counted"), common).withColumn("weight", F.greatest("prose", F.lit(LEAST))).drop("prose")


def _keys(rows: DataFrame) -> DataFrame:
    """Append ``key``, ascending in order of selection, and its ``bucket``. The uniform variate comes from a hash of the document, so a lost task makes the same one again."""
    u = (F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    key = -F.log(u) / F.col("weight")
    # whatever the weights, the logarithm of an exponential variate has a density below 0.37, so no bucket holds more than 0.37 ln 2 / BUCKETS of a source
    return rows.withColumn("key", key).withColumn("bucket", F.floor(F.log2("key") * BUCKETS).cast("int"))


def plan(totals: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, budget, epochs, rest) of each wanted source that has tokens.

    The total is the largest one at which every source reaches its share within its repeats. Sources without tokens can't take part; the shares
    of the others keep their proportions. Null or non-positive shares or repeats mean that a source isn't wanted; repeated target rows count once.
    """
    wanted = targets.filter("source is not null and target_share > 0 and max_repeats >= 1").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").cast("int").alias("max_repeats"))
    both = totals.filter("tokens > 0").join(wanted, "source")
    one = W.partitionBy(F.lit(0))  # one row per source: as many as the targets table has
    both = both.withColumn("target_share", F.col("target_share") / F.sum("target_share").over(one))
    both = both.withColumn("total", F.min(F.col("tokens") * F.col("max_repeats") / F.col("target_share")).over(one))
    budget = F.least(F.floor(F.col("total") * F.col("target_share") + 1e-6).cast("long"), F.col("tokens") * F.col("max_repeats"))
    both = both.withColumn("budget", budget).withColumn("epochs", F.floor(F.col("budget") / F.col("tokens")).cast("int"))
    return both.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")).drop("total")


def selection(docs: DataFrame, targets: DataFrame, common_words: DataFrame | None = None, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens, copies) of every document used at least once; copies is at most the source's max_repeats.

    Within a source, ``epochs`` copies of every document are taken, and one more of those whose prefix sum of tokens, in key order (ties by doc_id), stays
    within the rest of the budget. Documents without tokens are used as often as their source's epochs.
    """
    rows = materialise(_keys(with_tokens(docs, common_words, path)), "tokens")
    goals = materialise(plan(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")), targets), "plan")
    sums = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # some 70 doublings at most, so as many times BUCKETS rows a source
    edge = sums.withColumn("before", before).join(goals.select("source", "rest"), "source").filter("before <= rest").groupBy("source").agg(F.max_by(F.struct("bucket", "before", "rest"), "bucket").alias("e"))
    edge = edge.select("source", F.col("e.bucket").alias("edge"), F.col("e.before").alias("before"), F.col("e.rest").alias("rest"))
    # one row per source of the targets table, so at most as many as that has
    facts = goals.select("source", "epochs").join(edge, "source", "left")
    placed = rows.join(facts, "source")
    inside = placed.filter("bucket = edge").withColumn("sum", F.sum("tokens").over(W.partitionBy("source").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0)))
    inside = inside.select("doc_id", "source", "tokens", "epochs", (F.col("before") + F.col("sum") <= F.col("rest")).cast("int").alias("more"))
    others = placed.filter("edge is null or bucket <> edge").select("doc_id", "source", "tokens", "epochs", F.coalesce((F.col("bucket") < F.col("edge")).cast("int"), F.lit(0)).alias("more"))
    both = others.unionByName(inside)
    return both.select("doc_id", "source", "tokens", (F.col("epochs") + F.col("more")).alias("copies")).filter("copies > 0")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_copies) of each wanted source; sources that gave nothing have 0."""
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    wanted = targets.filter("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = wanted.join(got, "source", "left").select("source", "target_share", *(zero(F.col(c)).alias(c) for c in ("tokens", "documents", "most_copies")))
    return rows.withColumn("actual_share", F.col("tokens") / F.greatest(F.sum("tokens").over(W.partitionBy(F.lit(0))), F.lit(1)))
