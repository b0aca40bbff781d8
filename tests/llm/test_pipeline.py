import corpus_pipeline
from zonecast.llm import decontam, mixing, pii, rules, setjoin
from zonecast.llm.base import documents
from zonecast.sources import tables

from .test_setjoin import brute

SMALL = "/root/testdata/sf0.001"


def test_stages_equal_plain_versions(spark):
    docs = documents(spark, SMALL)
    columns = docs.columns
    rows = docs.collect()

    out = corpus_pipeline.quality_rules(spark, docs, SMALL)
    assert out.columns == columns
    want = {r["doc_id"]: c["text"] for r in rows if (c := rules.clean(r["text"]))["kept"]}
    assert {r["doc_id"]: r["text"] for r in out.collect()} == want

    out2 = corpus_pipeline.near_duplicates(spark, out, SMALL)
    assert out2.columns == columns
    want = {c for _, c in brute(list(want.items()), 5, 80).values()}
    assert {r["doc_id"] for r in out2.collect()} == want

    out3 = corpus_pipeline.decontamination(spark, out2, SMALL)
    assert out3.columns == columns
    held = {r["doc_id"] for r in decontam.contaminated(spark, out2, tables.table(spark, SMALL, "benchmark")).collect()}
    texts = {r["doc_id"]: r["text"] for r in out3.collect()}
    assert set(texts) == want - held
    items = [r["text"] for r in tables.table(spark, SMALL, "benchmark").collect()]
    assert not any(i in t for i in items for t in texts.values())

    out4 = corpus_pipeline.personal_data(spark, out3, SMALL)
    assert out4.columns == columns
    hidden = {r["doc_id"]: r for r in out4.collect()}
    assert {i: r["text"] for i, r in hidden.items()} == {i: pii.masked(t) for i, t in texts.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in hidden.values())
    assert not any(pii.find_spans(r["text"]) for r in hidden.values())

    mixed = {r["doc_id"]: r["copies"] * r["size"] for r in corpus_pipeline.source_mix(spark, out4, SMALL).collect()}
    taken = {r["doc_id"]: r["taken"] for r in mixing.report(spark, out4).collect() if r["taken"]}
    assert mixed == taken


def test_run_of_an_empty_table(spark, tmp_path):
    documents(spark, SMALL).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    tables.table(spark, SMALL, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stage_list(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "source_mix"]
    assert setjoin.first_of_each.__defaults__ == (5, 80)
