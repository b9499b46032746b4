"""Each stage of the pipeline against what its operator says, one after the other."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from firmament.llm import common, kneser_ney, order_minhash, pii, queries, winnowing  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    out = [common.table(spark, sf_dir, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.materialize(stage(spark, out[-1], sf_dir), name))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_take_effect(spark, sf_dir, stages):
    raw, good, single, clean, masked, mixture = stages
    assert all(s.columns == raw.columns for s in stages[:-1])
    judged = kneser_ney.judged(raw, queries.trusted(common.table(spark, sf_dir, "labels")))
    assert ids(good) == ids(judged.where("accepted")) != ids(raw)
    classes = order_minhash.near_duplicates(good).collect()
    assert ids(single) == {r.class_id for r in classes} != ids(good)
    hits = winnowing.contamination(single, common.table(spark, sf_dir, "benchmark"))
    assert ids(clean) == ids(hits.where("n_hit = 0")) != ids(single)
    before, after = ({r.doc_id: r for r in s.collect()} for s in (clean, masked))
    assert all(after[i].text == pii.masked(r.text) and after[i].n_chars == len(after[i].text) for i, r in before.items())
    assert any(after[i].text != r.text for i, r in before.items())
    assert ids(mixture) == ids(masked) and mixture.count() > masked.count()


def test_run_is_the_chain(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "copy").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, stages[-1].select("doc_id", "copy").collect()))


def small_tables(spark, folder, docs, labels, benchmark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*d, "s", len(d[1] or "")) for d in docs], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_odd_rows_and_empty_tables(spark, tmp_path):
    """Null, empty and repeated rows, rows without id or language; nothing labelled; no rows at all."""
    text = " ".join(f"word{i % 50} of tale{i}" for i in range(120))
    leak = "one two three four five six seven eight nine ten"
    docs = [(1, text, "en"), (2, text, "en"), (3, text.replace("tale9 ", "story9 "), "fr"), (4, None, None), (5, "", "en"), (6, "short one", None), (6, "short one", None),
            (None, "no id here", "de"), (7, f"before {leak} after", "en"), (8, "mail bob@example.com now", "es")]
    item = [(1, leak), (2, None), (None, "")]
    out = corpus_pipeline.run(spark, small_tables(spark, tmp_path / "a", docs, [(1, 1, 0), (6, 1, None), (8, 1, 0), (None, 1, 1), (7, 1, 0)], item)).collect()
    assert {r.doc_id for r in out} <= {1, 6, 8, None} and {1, 6, 8} <= {r.doc_id for r in out}
    assert all("bob" not in r.text for r in out)
    out = corpus_pipeline.run(spark, small_tables(spark, tmp_path / "b", docs, [], [])).collect()
    assert {str(r.doc_id) for r in out} == {"1", "6", "7", "8", "None"}
    assert corpus_pipeline.run(spark, small_tables(spark, tmp_path / "c", [], [], [])).isEmpty()


def test_leaks_go_whatever_the_columns_are_called(spark, docs):
    from pyspark.sql import functions as F
    items = spark.createDataFrame([(1, "word0 tale0 of the river and hill number 0 word1")], "item_id long, text string")
    clash = docs.withColumns({c: F.lit("mine") for c in ("_digest", "n_hit", "w", "key", "item")})
    left = winnowing.drop_contaminated(clash, items)
    assert left.columns == clash.columns and {r._digest for r in left.collect()} == {"mine"}
    assert {r.doc_id for r in left.collect()} == {4, 5, 6, 7, 8, 9, 10, None, 12}
