"""Ranked search against the score worked out by hand."""

import math
import random
import re

from civiclake.operators.search_index import B, K1, search_ranked, write_index

SCHEMA = "portal string, id string, title string, notes string, tags array<string>, word string"


def by_hand(rows, query, limit):
    out = []
    words = set(re.findall(r"[^\W_]+", query.lower()))
    for portal in {r[0] for r in rows}:
        docs = {r[1]: re.findall(r"[^\W_]+", " ".join([r[2] or "", r[3] or "", *[t for t in (r[4] or []) if t]]).lower()) for r in rows if r[0] == portal}
        mean = sum(map(len, docs.values())) / len(docs)
        scores = {}
        for w in words:
            d = sum(w in x for x in docs.values())
            for i, x in docs.items():
                t = x.count(w)
                if t:
                    idf = math.log(1 + (len(docs) - d + 0.5) / (d + 0.5))
                    scores.setdefault(i, []).append(idf * t * (K1 + 1) / (t + K1 * (1 - B + B * len(x) / mean)))
        best = sorted((-round(sum(s), 6), i, len(s)) for i, s in scores.items())[:limit]
        out += [(portal, n, i, -s, k) for n, (s, i, k) in enumerate(best, 1)]
    return sorted(out)


def test_scores_by_hand(spark, tmp_path):
    r = random.Random(6)
    words = ["water", "road", "Été", "naïve", "x1", "2024", "the", "Bus", "Bus-Stop", "park"]
    rows = [(r.choice(["a", "a", "b"]), f"d{i:03d}", " ".join(r.choices(words, k=r.randint(0, 4))) or None, " ".join(r.choices(words, k=r.randint(0, 30))),
             r.choice([None, [], ["water"], ["road", None, "bus"]]), "clash") for i in range(120)]
    rows += [("b", "same1", "water", "", [], ""), ("b", "same2", "water", "", [], ""), ("c", "none", None, None, None, None)]
    write_index(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "i"))
    for query, limit in (("Water, BUS!", 7), ("été naïve 2024", 500), ("the the the", 3), ("nothing here", 5), (" ,;", 5), ("", 5)):
        got = sorted(tuple(x) for x in search_ranked(spark, str(tmp_path / "i"), query, limit).collect())
        assert got == by_hand(rows, query, limit), query


def test_only_the_querys_words_are_read(spark, tmp_path):
    write_index(spark.createDataFrame([("a", "1", "one two", "three", ["four"], "")], SCHEMA), str(tmp_path / "i"))
    plan = search_ranked(spark, str(tmp_path / "i"), "two")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(word), EqualTo(word,two)" in plan or "In(word, [two])" in plan or "EqualTo(word,two)" in plan


def test_an_empty_catalogue(spark, tmp_path):
    write_index(spark.createDataFrame([], SCHEMA), str(tmp_path / "i"))
    assert search_ranked(spark, str(tmp_path / "i"), "water").count() == 0


def test_no_task_groups_the_words_of_all_it_reads(spark, tmp_path):
    """A dataset that is there twice counts its words twice; ids are dealt before their scores are summed."""
    rows = [("p", "1", "red ring", "red", ["ring"], ""), ("p", "1", "red ring", "red", ["ring"], ""), ("p", "2", "blue", None, None, "")]
    write_index(spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    got = sorted(tuple(x) for x in spark.read.parquet(f"{tmp_path}/postings").select("id", "word", "times", "length").collect())
    assert got == [("1", "red", 4, 4), ("1", "ring", 4, 4), ("2", "blue", 1, 1)]
    found = search_ranked(spark, str(tmp_path), "red")
    assert [(x["id"], x["words_found"]) for x in found.collect()] == [("1", 1)]
    assert "REPARTITION_BY_COL" in found._jdf.queryExecution().executedPlan().toString()
