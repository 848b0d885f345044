"""The pipeline's stages against plain versions of what they decide, each on its own input."""

from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from test_llm import brute_force_classes
from tokenizers import Tokenizer

from boardsift.llm import quality, toxicity

SF = "/root/testdata/sf0.001"


def kept_ids(docs):
    return sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def copied(spark, docs):
    """The same rows as a table of their own, as the next stage reads them."""
    return spark.createDataFrame(docs.collect(), docs.schema)


def test_stages_against_plain_versions(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality", "exact-dedup", "near-dedup", "packing"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    # copies with other white space, repeated rows, null and empty texts, and a column of a name that stages use
    more = docs.where("doc_id < 20").withColumn("text", F.concat(F.lit(" \n"), "text")).withColumn("doc_id", F.col("doc_id") + 1000)
    odd = spark.createDataFrame([(2000, None), (2001, ""), (2002, None)], "doc_id long, text string")
    docs = docs.unionByName(more).unionByName(docs.where("doc_id < 5")).unionByName(odd, allowMissingColumns=True).withColumn("row", F.lit(7))
    columns = docs.columns
    docs = copied(spark, docs)
    for name, score, reject in (("toxicity", toxicity.score_toxicity, 1), ("quality", quality.score_quality, 0)):
        decided = score(docs, labels).collect()
        found = copied(spark, stages[name](spark, docs, SF))
        assert found.columns == columns and kept_ids(found) == sorted(r["doc_id"] for r in decided if r["predicted"] != reject)
        assert found.count() < docs.count()
        docs = found
    groups = defaultdict(list)
    for r in docs.collect():
        groups["".join(c for c in r["text"] or "" if c not in " \t\n\v\f\r")].append((-len(r["text"] or ""), r["doc_id"]))
    found = copied(spark, stages["exact-dedup"](spark, docs, SF))
    assert found.columns == columns and kept_ids(found) == sorted(min(g)[1] for g in groups.values()) and found.count() < docs.count()
    docs = found
    label = brute_force_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    found = copied(spark, stages["near-dedup"](spark, docs, SF))
    assert found.columns == columns and kept_ids(found) == sorted(set(label.values())) and found.count() < docs.count()
    docs = found
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter({r["doc_id"]: len(own.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect()})
    got, used = Counter(), Counter()
    for r in stages["packing"](spark, docs, SF).collect():
        got[r["doc_id"]] += r["length"]
        used[r["sequence_id"]] += r["length"]
    assert got == want and max(used.values()) <= 4096


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, SF)
        assert found.columns == docs.columns and found.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_run(spark, tmp_path):
    """Stages follow each other: what the run packs is what the stages keep one by one."""
    found = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = copied(spark, stage(spark, docs, SF))
    assert sorted(r["doc_id"] for r in found.select("doc_id").distinct().collect()) == kept_ids(docs)
