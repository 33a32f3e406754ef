from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm.decontaminate import windows, word_list

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen, at = docs.columns, {}, docs
    for name, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.written(stage(spark, at, DATA), name)
        seen[name] = {r.doc_id: r for r in at.collect()}
        assert at.columns[:5] == columns and (name == "mixing" or at.columns == columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "mixing"]
    all_docs = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    gone = all_docs.keys() - seen["toxicity"].keys()
    assert gone and all(labels.get(i) != 0 for i in gone)
    texts = {r.text for r in seen["toxicity"].values()}
    assert len({r.text for r in seen["near_duplicates"].values()}) == len(seen["near_duplicates"]) <= len(texts)
    runs = {w for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() for w in windows(word_list(r.text.encode()), 10)}
    holds = lambda t: any(tuple(w[i : i + 10]) in runs for w in [word_list(t.encode())] for i in range(len(w)))
    assert {i for i, r in seen["near_duplicates"].items() if not holds(r.text)} == seen["decontamination"].keys()
    changed = [i for i, r in seen["personal_data"].items() if r.text != all_docs[i].text]
    assert changed and all("<" in seen["personal_data"][i].text for i in changed)
    assert not any("@mail" in r.text for r in seen["personal_data"].values())
    assert seen["mixing"].keys() == seen["personal_data"].keys() == seen["decontamination"].keys()


def test_empty(spark):
    at = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, DATA)
    assert at.collect() == []


def test_odd_rows_and_clashing_columns(spark):
    """Nulls, empty texts, repeated ids and rows, and columns with the names that the operators use themselves."""
    names = ["score", "hits", "items", "row", "found", "kept", "learnt_from", "node", "low", "least", "mix", "text_2", "n_words", "cuts", "component_id", "at"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (7_000_001, "kept as it is", None, None, None), (7_000_001, "another text of that id", "en", "s", 3), (7_000_002, "said twice", "en", "s", 1), (7_000_002, "said twice", "en", "s", 1), (7_000_003, "a" + "-" * 200_000 + "b", "xx", "s", 2)], docs.schema)
    at = docs.unionAll(odd).withColumns({n: F.lit(i) for i, n in enumerate(names)})
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, at, DATA), name)
        assert out.columns[: len(at.columns)] == at.columns
        at = out
    got = [(r.doc_id, r.text) for r in at.where("doc_id >= 7000000 or doc_id is null").collect()]
    assert sorted(t for d, t in got if d in (7_000_001, 7_000_002)) == ["another text of that id", "kept as it is", "said twice"]
    assert len(got) == 5 and sum(d is None for d, _ in got) == 1  # the rows without words are copies of each other
    assert at.select(*names).distinct().collect() == [tuple(range(len(names)))]
