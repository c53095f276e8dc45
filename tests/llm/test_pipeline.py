import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from drivetrace.llm import jaccard, mixing, pii, quality


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, out[-1][1], sf_dir)
        out.append((name, made if name == "pieces" else corpus_pipeline.written(made, "test")))
    return dict(out)


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages(spark, sf_dir, steps):
    docs, names = steps["documents"], [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near-duplicates", "private", "mixture", "pieces"]
    assert all(steps[n].columns == docs.columns for n in names[:-1])

    machine = quality.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r.doc_id for r in quality.scored(docs, machine).where("predicted = 1").collect()}
    assert texts(steps["quality"]) == [x for x in texts(docs) if x[0] in good]

    kept = {r.doc_id for r in jaccard.near_texts(steps["quality"]).where("kept").collect()}
    assert texts(steps["near-duplicates"]) == [x for x in texts(steps["quality"]) if x[0] in kept]
    assert jaccard.near_texts(steps["near-duplicates"]).where("n_links > 0").count() == 0

    assert [i for i, _ in texts(steps["private"])] == [i for i, _ in texts(steps["near-duplicates"])]
    assert pii.private_spans(steps["private"]).where("size(base) > 0").count() == 0

    mixed = texts(steps["mixture"])
    assert set(mixed) <= set(texts(steps["private"])) and len(mixed) > 0.5 * len(texts(steps["private"]))
    last = steps["pieces"].collect()
    assert sorted(r.doc_id for r in last) == [i for i, _ in mixed] and all(r.round_trip for r in last)


def test_stages_against_plain_versions(spark, sf_dir, steps):
    """Scores pair by pair, shingle sets compared one by one, patterns by Python's, readings from the plan, ids by the library."""
    from sentencepiece import SentencePieceProcessor
    from test_jaccard import brute
    from test_pii import plain_spans
    from test_quality import plain_score

    machine = quality.learned(steps["documents"], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = [(r.doc_id, r.text, plain_score(machine, (r.text or "").encode(), r.n_chars)) for r in steps["documents"].collect()]
    assert all(abs(s - 0.3) > 2e-4 for _, _, s in scores)
    good = sorted((i, t) for i, t, s in scores if s >= 0.3)
    assert texts(steps["quality"]) == good

    first = {i for i, c, _ in brute(good) if i == c}
    assert texts(steps["near-duplicates"]) == [x for x in good if x[0] in first]

    before, after = dict(texts(steps["near-duplicates"])), dict(texts(steps["private"]))
    assert before.keys() == after.keys()
    assert all(plain_spans(t or "") == [] for t in after.values())
    hidden = [i for i, t in before.items() if plain_spans(t or "")]
    assert hidden and all(after[i] == before[i] for i in before if i not in hidden)
    assert all(any(k in after[i] for k in ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")) for i in hidden)

    plan = sorted((r.progress, r.block, r.place, r.doc_id) for r in mixing.mixture(steps["private"]).collect())
    assert sorted(p[3] for p in plan) == [i for i, _ in texts(steps["mixture"])]
    assert [r.doc_id for r in steps["mixture"].collect()] == [p[3] for p in plan]

    library = SentencePieceProcessor(model_file=corpus_pipeline.PIECE_MODEL)
    mixed = dict(texts(steps["mixture"]))
    assert all(list(r.ids) == library.encode(mixed[r.doc_id]) and r.n_tokens == len(r.ids) for r in steps["pieces"].collect())


def test_stages_with_odd_rows(spark, sf_dir):
    """Null and empty texts, null ids, repeated rows, columns of any name, and no rows at all."""
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).withColumn("row", F.lit("x")).withColumn("_h", F.lit(1))
    odd = [(None, "A plain text that has no id of its own, but words enough.", "en", "s", 57, "x", 1), (7_000_001, None, "en", None, None, "x", 1),
           (7_000_002, "", "en", "s", 0, "x", 1), (7_000_003, "word " * 50_000, None, "s", 250_000, "x", 1)] * 2
    docs = some.unionByName(spark.createDataFrame(odd, some.schema))
    for rows in (docs, docs.limit(0)):
        n = rows.count()
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, rows, sf_dir)
            if name != "pieces":
                assert made.columns == docs.columns, name
                made = corpus_pipeline.written(made, "odd")
            if name in ("quality", "near-duplicates"):
                assert made.count() <= n
            if name == "private":
                assert made.count() == rows.count()
            if name == "pieces":
                assert made.count() == rows.count() and made.where("NOT round_trip").count() == 0
            rows = made


def test_run(spark, sf_dir, steps):
    assert corpus_pipeline.run(spark, sf_dir).count() == steps["pieces"].count()
