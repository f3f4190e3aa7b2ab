from collections import defaultdict

import pytest

from cohortlens.llm.line_spread import remove_boilerplate


def brute(rows, min_sites, min_words):
    sites = defaultdict(set)
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if site is not None:
                sites[line.strip(" ")].add(site)
    gone = {s for s, own in sites.items() if len(own) >= min_sites and len(s.split(" ")) >= min_words}
    out = []
    for i, text, _ in rows:
        kept = None if text is None else "\n".join(x for x in text.split("\n") if x.strip(" ") not in gone)
        out.append((i, kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_sites", [3, 40, 60])
def test_equals_brute_force(spark, min_sites):
    rows = []
    for i in range(200):
        lines = [f"own line number {i}", " all rights are reserved ", "Ok."]
        lines += [f"shared by every {m} sites" for m in (2, 3, 4, 5) if i % m == 0] + [""]
        rows.append((i if i % 50 else None, "\n".join(lines), f"site{i % 70}" if i % 9 else None))
    rows += [(500, None, "s"), (501, "", "s"), (7, rows[7][1], rows[7][2]), (502, "all rights are reserved", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS row", "2 AS gone", "3 AS h1")
    got = remove_boilerplate(df.repartition(4), min_sites)
    assert sorted([(r["row"]["doc_id"], r["text"]) for r in got.collect()], key=str) == brute(rows, min_sites, 3)
    assert got.where("row.gone <> 2").count() == 0
    assert remove_boilerplate(df.limit(0)).count() == 0
