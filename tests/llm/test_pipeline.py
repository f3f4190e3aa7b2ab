import random

import corpus_pipeline
from cohortlens.llm.common import components
from cohortlens.llm.quality import THRESHOLD, fit, score
from cohortlens.llm.simhash import majority, shingle_hashes


def corpus(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 7)))
    rows = []
    for i in range(400):
        lines = [" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(5)]
        rows.append((i, "\n".join([*lines, "All rights reserved by the owner."]), "en", f"s{i % 17 if i % 3 else 0}", 0))
    rows += [(1000 + i, " ".join(word() + "###" for _ in range(60)), "en", "s1", 0) for i in range(40)]
    rows += [(2000, rows[7][1], "en", "s5", 0), (None, rows[7][1], "en", "s5", 0), (2001, None, None, None, None), (2002, "", "en", "s2", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, schema).repartition(4)


def test_each_stage_acts_on_all_of_its_input(spark, tmp_path):
    docs = corpus(spark)
    columns = docs.columns
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{len(outs)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(outs)}")
        outs[name] = docs
        if stage is not corpus_pipeline.packing:
            assert docs.columns == columns
    kept = {r.doc_id for r in outs["quality classifier"].collect()}
    assert kept == set(range(400)) | {2000, None, 2001, 2002}
    assert outs["line dedup"].where("text LIKE '%rights reserved%'").count() == 0
    assert outs["line dedup"].where("n_chars <> length(text)").count() == 0
    # Copies go, those without an id too; null and empty texts are near-duplicates.
    ids = [r.doc_id for r in outs["SimHash near-dedup"].collect()]
    assert sorted(ids) == sorted([*range(400), 2001])
    mixed = outs["mixing sources to target weights"]
    assert {r.doc_id for r in mixed.collect()} == set(ids) and mixed.count() >= len(ids)
    assert outs["packing"].select("doc_id").distinct().count() == len(ids)


def test_rejections_follow_the_scores(spark):
    docs = corpus(spark)
    good = {r.doc_id for r in score(docs, fit(docs)).collect() if r.score >= THRESHOLD}
    assert {r.doc_id for r in corpus_pipeline.quality_classifier(spark, docs, "").collect()} == good


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(0, 200)] + [(500, 501), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_near_dedup_keeps_one_row_per_component(spark):
    """Against brute force: SimHash bits, then the smallest id of each group."""
    rng = random.Random(3)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(200)] for _ in range(30)]
    rows = []
    for i, words in enumerate(base):
        for j in range(4):
            own = list(words)
            if j:
                own[rng.randrange(200)] = f"new{j}"
            rows.append((10 * i + j, " ".join(own), "en", "s", 0))
    rows += [(5, rows[4][1], "en", "s", 0), (5, rows[4][1], "en", "s", 0), (None, rows[0][1], "en", "s", 0)]
    rows += [(None, None, None, None, None), (7, "", "en", "s", 0)]
    fps = [majority(shingle_hashes((r[1] or "").encode(), 3)) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    want = {}
    for g, r in zip(group, rows, strict=True):
        want[g] = min(want.get(g, (True, 0)), (r[0] is None, r[0] or 0))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    got = [(r.doc_id is None, r.doc_id or 0) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(got) == sorted(want.values())
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_rows_that_differ_in_which_column_is_null_are_two(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "en", None, 5), (1, text, None, "en", 5), (1, text, "en", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.near_dedup(spark, docs, "").count() == 1
    hashed = [(r.lang, r.source) for r in corpus_pipeline.near_dedup(spark, docs.union(docs), "").collect()]
    assert hashed in ([("en", None)], [(None, "en")])
