"""The pipeline's stages against plain computations on their own input."""
import __spark_entry__ as E
import corpus_pipeline as P
from prudent.llm import quality
from prudent.llm.common import staged

from test_filters import brute_base
from test_near_duplicates import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["quality_rules", "minhash_near_dedup", "pii", "source_mixing", "best_fit_packing"]
    kept = {}
    for name, stage in P.STAGES:
        before, docs = docs, staged(stage(spark, docs, SF), name)
        kept[name] = (before, docs)
        assert docs.columns == columns or name == "best_fit_packing"

    before, after = (x.toPandas().set_index("doc_id") for x in kept["quality_rules"])
    rules = quality.fit(kept["quality_rules"][0], spark.read.parquet(f"{SF}/labels.parquet"))
    stats = {i: dict(zip(quality.BASE + quality.FEATURES, quality.statistics(t))) for i, t in before.text.items()}

    def fits(c, s):
        return s[c.feature] >= c.value if c.at_least else s[c.feature] <= c.value
    good = {i for i, t in before.text.items() if not brute_base(t)[-1] and not any(all(fits(c, stats[i]) for c in r) for r in rules)}
    assert set(after.index) == good

    before, after = (x.toPandas() for x in kept["minhash_near_dedup"])
    want = {i for i, _, _, stays in brute(list(zip(before.doc_id, before.text)), 5) if stays}
    assert set(after.doc_id) == want and len(after) < len(before)

    before, after = (x.toPandas().set_index("doc_id") for x in kept["pii"])
    assert set(before.index) == set(after.index) and (after.text.str.len() == after.n_chars).all()
    changed = before.index[before.text != after.text.reindex(before.index)]
    assert 0 < len(changed) < len(before)
    assert not any(m in t for i, t in after.text.items() for m in __import__("re").findall(r"[\w.]+@mail\d[\w.]+", before.text[i]))

    before, after = (x.toPandas() for x in kept["source_mixing"])
    assert set(after.doc_id) < set(before.doc_id)
    before, after = (x.toPandas() for x in kept["best_fit_packing"])
    assert set(after.doc_id) == set(before.doc_id) and (after.groupby("sequence_id").length.sum() <= 1024).all()


def test_registered():
    names = set(E.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names}


def run_stages(spark, docs):
    for name, stage in P.STAGES[:-1]:
        out = staged(stage(spark, docs, SF), name)
        assert out.columns == docs.columns, name
        docs = out
    return docs, staged(P.STAGES[-1][1](spark, docs, SF), "packed")


def test_nulls_repeats_and_clashing_names_pass_all_stages(spark):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None, None, None, None), (7_000_000, None, "en", "s", None), (7_000_001, "", None, None, 0), (None, "word " * 80, "en", None, 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.limit(5))
    for name in ("__gone", "id", "_id", "__id", "kept", "component_id", "weight", "scale", "p", "n", "prob", "u", "length", "n_words", "word_chars", "parts", "kind"):
        docs = docs.withColumn(name, F.lit("clash"))
    docs = staged(docs, "odd")
    last, packed = run_stages(spark, docs)
    assert 0 < last.count() < docs.count() and last.where("`__gone` <> 'clash' OR id <> 'clash'").count() == 0
    assert set(r.doc_id for r in packed.collect()) == set(r.doc_id for r in last.collect())


def test_an_empty_table_passes_all_stages(spark):
    last, packed = run_stages(spark, spark.read.parquet(f"{SF}/documents.parquet").where("false"))
    assert last.count() == packed.count() == 0
