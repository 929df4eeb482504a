"""The pipeline's stages, each against a plain version on its own input."""

import tiktoken
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline as P
    from leafmill.llm.credentials import learn_grammars, redact
    from leafmill.llm.queries import public_vocabulary

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names, seen = [n for n, _ in P.STAGES], [docs]
    for i, (_, stage) in enumerate(P.STAGES):
        seen.append(stage(spark, seen[-1], SF).cache())
        assert i == len(names) - 1 or seen[-1].columns == columns
    texts = [{r["doc_id"]: r["text"] for r in s.collect()} for s in seen[:5]]
    assert all(not brute.quality_base(t)[5] for t in texts[1].values())
    ids = sorted(texts[1])
    sets = [brute.shingle_set(texts[1][i]) for i in ids]
    groups = brute.joined(len(ids), lambda i, j: brute.jaccard(sets[i], sets[j]) >= 0.8)
    assert sorted(texts[2]) == sorted({ids[g] for g in groups})
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(texts[3]) == sorted(i for i, t in texts[2].items() if not brute.contamination(t, items)[4])
    g = learn_grammars()
    assert texts[4] == {i: redact(t, g) for i, t in texts[3].items()}
    v = public_vocabulary()
    enc = tiktoken.Encoding("own", pat_str=v.pattern, mergeable_ranks={t: i for i, t in enumerate(v.tokens) if t is not None}, special_tokens={})
    got = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in seen[5].collect()}
    assert got == {i: (len(enc.encode_ordinary(t)), brute.sha(t)) for i, t in texts[4].items()}
    run = P.run(spark, SF)
    assert {r["doc_id"]: r["decoded_sha256"] for r in run.collect()} == {i: d for i, (_, d) in got.items()}
    assert run.filter(F.col("tokens").isNull()).count() == 0


def test_odd_rows(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    odd = docs.limit(40).union(docs.limit(3)).union(docs.limit(5).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)))
    for c in ("text", "lang", "source", "n_chars"):
        odd = odd.union(docs.limit(6).withColumn(c, F.lit(None).cast(docs.schema[c].dataType)))
    odd = odd.union(docs.limit(1).withColumn("text", F.lit("word " * 60_000))).union(docs.limit(1).withColumn("text", F.lit("")))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, d, b in (("odd", odd, bench.union(bench.limit(1))), ("none", docs.limit(0), bench), ("bare", docs.limit(30), bench.limit(0))):
        d = d.withColumn("tokens", F.lit("clash")).withColumn("_place", F.lit(7)).withColumn("node", F.lit(None).cast("string"))
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        b.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = P.run(spark, f"{tmp_path}/{name}")
        assert isinstance(out.schema, StructType) and "decoded_sha256" in out.columns
        n = out.count()
        assert n == 0 if name == "none" else 0 < n <= d.count()
        kept = [r["decoded_sha256"] for r in out.collect()]
        assert len(kept) == len(set(kept))
    assert P.STAGES[0][1](spark, odd, SF).columns == columns
