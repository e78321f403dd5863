import corpus_pipeline
from tests.llm.fixtures import empty_documents, odd_documents
from transferwatch.llm import jaccard, mixing, pii, quality
from transferwatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_has_its_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")).keep(docs).cache()
    heads = jaccard.components(kept).where("doc_id = component_id").select("doc_id").distinct()
    final = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in final.select("doc_id").collect()) == sorted(r.doc_id for r in heads.collect())
    # The mixture reaches the result: places, and with them the source shares of every beginning of it.
    mixed = mixing.mix(pii.protect(jaccard.one_of_each(kept)).select("doc_id", "source"), block_rows=mixing.BLOCK_ROWS)
    wanted = {r.doc_id: r.position for r in mixed.collect()}
    assert {r.doc_id: r.position for r in final.select("doc_id", "position").collect()} == wanted
    protected = {r.doc_id: r.text for r in pii.protect(kept).collect()}
    assert all(r.decoded for r in final.collect())
    lengths = {r.doc_id: sum(r.n_pieces for _ in [0]) for r in final.collect()}
    assert all(0 < n <= len(protected[d].encode()) + 1 for d, n in lengths.items())


def test_all_but_the_last_return_the_documents_columns(spark):
    for docs in (odd_documents(spark), empty_documents(spark)):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, SF)
            after.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert after.columns == docs.columns


def test_places_follow_the_files(spark, tmp_path):
    rows = spark.range(0, 500, 1, 7).selectExpr("id", "id as _row", "'x' as _file")
    rows.repartitionByRange(5, "id").sortWithinPartitions("id").write.parquet(f"{tmp_path}/t")
    placed = mixing.with_positions(spark.read.parquet(f"{tmp_path}/t"))
    assert placed.where("id != position").isEmpty() and placed.count() == 500
    assert mixing.with_positions(rows).where("position is not null").isEmpty()
