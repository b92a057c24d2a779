"""Mixing with a very long document where a quota ends."""

from pyspark.sql import functions as F

from ledgerloom.llm import mixing


def test_a_long_document_at_the_cut_leaves_no_gap(spark):
    # in the seeded order: 1,000 documents of 9 words, one of 40,000, then 8,000 of 9 words and one of 1
    size = F.when(F.col("id") == 1000, 40_000).when(F.col("id") == 9001, 1).otherwise(9)
    sized = spark.range(9002).select(
        F.lit('["a"]').alias("pattern"), F.array(F.lit("a")).alias("sources"),
        (F.lit(mixing.LOWEST) + F.col("id") * (1 << 49)).alias("hash"), size.cast("bigint").alias("size"))
    for rest in (9_000 + 39_997, 9_000 + 40_000, 9_000 + 39_988):
        spans = mixing._spans(sized, {'["a"]': rest})['["a"]']
        taken = sum(r["size"] for r in sized.collect() if any(lo <= r.hash <= hi and r["size"] <= cap for lo, hi, cap in spans))
        assert rest - 8 < taken <= rest


def test_targets_with_long_documents(spark):
    size = F.when(F.col("id") % 1500 == 1, 20_000).otherwise(1 + F.col("id") % 60).cast("int")
    docs = spark.range(9000).select(
        F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("source"),
        F.repeat(F.lit("w "), size).alias("text"))
    taken, sizes, targets = mixing.mix_table(docs, weights=(1, 1, 1), seed=2)
    got = {r.s: r.t for r in taken.groupBy(F.col("sources")[0].alias("s")).agg(F.sum(F.col("copies") * F.col("size")).alias("t")).collect()}
    assert mixing.mix_documents(docs, weights=(1, 1, 1), seed=2).count() == taken.agg(F.sum("copies")).first()[0]
    # a mix misses its target by less than the shortest document that is left
    assert all(targets[s] - 2 < got[s] <= targets[s] + 1 for s in sizes)
