import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as cp  # noqa: E402
from tillroll.llm import langid, packing, simhash, toxicity  # noqa: E402
from test_simhash import UPPER, brute_print, classes  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = langid.fit(docs)
    rows = {d: t for d, t in rows.items() if (p := model.predict(t))[0] != "und" and p[1] >= cp.MIN_LANGUAGE_SCORE}
    seen = docs.where(docs.doc_id.isin(list(rows)))
    assert {r["doc_id"] for r in cp.language_id(spark, docs, SF).collect()} == set(rows)
    lexicon = toxicity.fit(seen, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {d: t for d, t in rows.items() if lexicon.score(t) < 0.5}
    best = {}
    for d, t in rows.items():
        best[t.translate(UPPER)] = max(d, best.get(t.translate(UPPER), d))
    rows = {d: rows[d] for d in best.values()}
    low = classes({d: brute_print(t) for d, t in rows.items()})
    rows = {d: rows[d] for d in set(low.values())}
    out = cp.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == set(rows)


def test_stages_keep_columns_and_take_odd_input(spark, docs, odd_rows):
    df = docs(odd_rows)
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, df, SF).columns == df.columns, name
        assert stage(spark, df.limit(0), SF).count() == 0, name
    assert cp.STAGES[-1][1](spark, df.limit(0), SF).count() == 0
    assert simhash.BITS == 2


def test_a_worker_holds_no_encoder_after_packing_or_other_work(spark, docs):
    import public_tokenizers
    from pyspark.sql import functions as F

    def kept(batches):
        import pyarrow as pa
        from tillroll.llm import common
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([len(common._held)])], ["n"])

    df = docs([(i, f"some words {i}") for i in range(40)])
    packing.tokenised(df, public_tokenizers.path("word_bpe_49k.json")).count()
    langid.predict(df.repartition(16), langid.fit(df)).count()
    simhash.near_duplicates(df.repartition(16)).count()
    assert spark.range(16).repartition(16).mapInArrow(kept, "n long").agg(F.max("n")).first()[0] <= 1


def test_one_slot_for_encoders():
    from tillroll.llm import common

    assert common.held("a", lambda: 1) == 1 and common.held("a", lambda: 2) == 1
    assert common.held("b", lambda: 3) == 3 and list(common._held) == ["b"]
    common.release()
    assert not common._held
