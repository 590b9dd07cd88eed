import corpus_pipeline
import pytest
from tidemark.llm import packing
from tidemark.llm.common import DOCUMENT_COLUMNS


def stages(spark, docs, folder):
    """Every stage's rows, each from what the one before gives."""
    out = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{n}")
        docs = out[name] = spark.read.parquet(f"{folder}/{n}")
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == DOCUMENT_COLUMNS
    return out


@pytest.fixture(scope="module")
def prose():
    import random
    rng = random.Random(3)
    letters = {"one": "abcdef", "two": "uvwxyz"}

    def make(lang, n):
        return " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(3, 7))) for _ in range(n))
    return make


def test_the_stages_decide(spark, documents, prose, folder):
    rows = [(i, prose("one" if i % 2 else "two", 60), "one" if i % 2 else "two", "a" if i % 3 else "b") for i in range(300)]
    rows += [(400, rows[0][1], "two", "a"), (401, rows[1][1] + " end", "one", "a"), (402, rows[2][1] + " password: hunter2hunter2", "two", "a"), (403, None, "one", "a"), (404, "", "one", "b"),
             (405, "12 34 56", "one", "a"), (7, prose("one", 50), "one", None), (7, prose("one", 50), "one", None), (None, prose("two", 50), None, "a"), (None, prose("two", 50), None, "a")]
    docs = documents(rows)
    got = stages(spark, docs, folder)
    known = {r.doc_id for r in got["language"].collect()}
    assert not known & {403, 404, 405} and len(known) >= 295
    kept = got["near copies"].collect()
    assert not {r.doc_id for r in kept} & {400, 401, 402} and sum(r.doc_id == 7 for r in kept) == 3 and sum(r.doc_id is None for r in kept) == 2
    assert got["secrets"].count() == len(kept)
    mixed = {}
    for r in got["mix"].collect():
        mixed[r.source] = mixed.get(r.source, 0) + len(r.text.split())
    sizes = {}
    for r in got["secrets"].collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    assert set(mixed) == set(sizes) and all(mixed[s] <= 2 * sizes[s] + 60 for s in mixed)
    packed = got["packing"]
    assert packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").isEmpty()
    assert packed.select("doc_id", "piece").exceptAll(packing.pack(got["mix"]).select("doc_id", "piece")).isEmpty()


def test_run_reads_documents_and_empty_tables(spark, documents, prose, folder):
    rows = [(i, prose("one" if i % 2 else "two", 40), "one" if i % 2 else "two", "a") for i in range(120)]
    documents(rows).select(*DOCUMENT_COLUMNS).write.parquet(f"{folder}/full/documents.parquet")
    documents([]).select(*DOCUMENT_COLUMNS).write.parquet(f"{folder}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/full").count() > 100
    assert corpus_pipeline.run(spark, f"{folder}/none").collect() == []
    assert set(stages(spark, documents([]), folder)) == {name for name, _ in corpus_pipeline.STAGES}
