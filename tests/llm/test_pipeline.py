import corpus_pipeline
import pytest

from loomgraph.llm import decontaminate, near_dedup, pii, quality
from loomgraph.llm.common import table


def test_stages_act_on_what_is_left(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    one = corpus_pipeline.quality_rules(spark, docs, sf_dir).cache()
    kept = {r.doc_id for r in quality.quality(docs, table(spark, sf_dir, "labels")).where("kept").collect()}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == kept
    two = corpus_pipeline.near_duplicates(spark, one, sf_dir).cache()
    assert {r.doc_id for r in two.collect()} == {r.doc_id for r in near_dedup.near_duplicates(one, corpus_pipeline.SIMILAR).where("kept").collect()}
    three = corpus_pipeline.decontamination(spark, two, sf_dir).cache()
    leaks = {r.doc_id for r in decontaminate.contaminated(two, table(spark, sf_dir, "benchmark")).collect()}
    assert {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect()} - leaks
    four = corpus_pipeline.personal_data(spark, three, sf_dir)
    assert four.schema == docs.schema and pii.personal_data(four).selectExpr("sum(n_email + n_phone + n_ip + n_card)").first()[0] in (0, None)
    last = corpus_pipeline.encoding(spark, four, sf_dir).collect()
    assert len(last) == three.count() and all(r.n_tokens == (r.ids.count(",") + 1 if r.ids else 0) for r in last)


@pytest.mark.parametrize("k", range(5))
def test_stages_take_an_empty_table(spark, sf_dir, k):
    docs = table(spark, sf_dir, "documents").limit(0)
    assert corpus_pipeline.STAGES[k][1](spark, docs, sf_dir).count() == 0


def test_rows_without_an_id_stay(spark, sf_dir):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text, "en", "s", 1), (None, text, "en", "s", 1), (4, text, "en", "s", 1), (5, text, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()) == ["4", "None", "None"]


def test_texts_of_one_id_are_decided_each(spark, sf_dir):
    first, second = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = spark.createDataFrame([(3, first, "en", "s", 1), (5, first, "en", "s", 1), (5, second, "en", "s", 1), (5, second, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted((r.doc_id, r.text[:2]) for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect())
    assert left == [(3, "a0"), (5, "b0"), (5, "b0")]
    item = table(spark, sf_dir, "benchmark").first().text
    leaks = spark.createDataFrame([(7, item, "en", "s", 1), (7, second, "en", "s", 1)], docs.schema)
    assert [r.text for r in corpus_pipeline.decontamination(spark, leaks, sf_dir).collect()] == [second]


def test_run_leaves_one_table(spark, sf_dir):
    from loomgraph.llm.common import written

    before = written()
    assert corpus_pipeline.run(spark, sf_dir).count() > 0 and written() == before + 1
