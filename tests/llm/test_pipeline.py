import corpus_pipeline
from turnwise.llm.decontaminate import find_contaminated
from turnwise.llm.language import letters_of  # noqa: F401  the subpackage is importable as a whole
from turnwise.llm.secrets import scanner, RULES
from turnwise.llm.simhash import fingerprint, shingles
from turnwise.llm.toxicity import Scorer, fit_toxicity

FOLDER = "/root/testdata/sf0.01"


def test_stages_on_their_own_input(spark, folder):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.toPandas()
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        kept[name] = (before, docs.toPandas())
    assert all(list(after.columns) == columns for name, (_, after) in kept.items() if name != "mixing")

    before, after = kept["toxicity"]
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    scorer = Scorer(fit_toxicity(source, spark.read.parquet(f"{FOLDER}/labels.parquet")))
    assert set(after.doc_id) == {d for d, t in zip(before.doc_id, before.text) if scorer.score(t) < 0.5}

    before, after = kept["simhash_near_dedup"]
    prints = dict(zip(before.doc_id, (fingerprint(shingles(t or "", 4, False)) for t in before.text)))
    firsts, todo = set(), sorted(prints)
    while todo:
        group, first = [todo[0]], todo[0]
        left = set(todo[1:])
        for x in group:
            near = {y for y in left if (prints[x] ^ prints[y]).bit_count() <= 4}
            group += sorted(near)
            left -= near
        firsts.add(first)
        todo = sorted(left)
    assert set(after.doc_id) == firsts and len(firsts) < len(prints)

    before, after = kept["decontamination"]
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    found = find_contaminated(spark.createDataFrame(before), benchmark).toPandas()
    assert set(before.doc_id) - set(after.doc_id) == set(found.doc_id) and len(found)

    before, after = kept["secret_scans"]
    machine = scanner(RULES)
    assert sorted(before.doc_id) == sorted(after.doc_id)
    texts = dict(zip(before.doc_id, before.text))
    changed = {d for d, t in zip(after.doc_id, after.text) if t != texts[d]}
    assert changed == {d for d, t in texts.items() if machine.spans(t)} and changed
    assert (after.n_chars == after.text.str.len()).all()

    before, after = kept["mixing"]
    assert sorted(before.doc_id) == sorted(after.doc_id)
    assert not after.duplicated(["slot", "rank_in_block"]).any()


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and {"doc_id", "slot", "rank_in_block"} <= set(rows.columns)
