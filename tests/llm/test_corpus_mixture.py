"""A mixture as large as the corpus, where scarce sources fall short."""

from pyspark.sql import functions as F

from scantable.llm import queries

DATA = "/root/testdata/sf0.01"


def test_scarce_sources_stop_at_their_repeats(spark):
    sizes = queries._sizes(spark, DATA, ["doc_id", "source"])
    have = {r.source: r.n for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    targets = {r.source: r for r in spark.read.parquet(f"{DATA}/mix_targets.parquet").collect()}
    total, wanted = sum(have.values()), sum(t.target_share for s, t in targets.items() if have.get(s))
    shares = {r.source: r for r in queries.queries()["p9_corpus_shares"](spark, DATA).collect()}
    assert set(shares) == set(targets)
    short = 0
    for s, t in targets.items():
        most, aim = have.get(s, 0) * t.max_repeats, total * t.target_share / wanted
        if most < aim:
            short += 1
            assert shares[s].tokens == most
        else:
            assert abs(shares[s].tokens - aim) < 0.02 * aim
    assert short > 0
    used = {r.source: r.n for r in queries.queries()["p9_corpus"](spark, DATA).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert used == {s: r.tokens for s, r in shares.items() if r.tokens}
