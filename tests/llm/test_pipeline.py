"""The five stages against plain Python, and ids that repeat with other texts."""

import hashlib
import random
import tracemalloc

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from civiclake.llm import bagminhash, components, decontaminate, line_dedup, nearest, quality, token_counts
from civiclake.llm.suite import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_id long, kept boolean, gone int, item_id long"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def docs(spark, rows):
    """(doc_id, text) with clashing further columns."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 5, True, 1, 2) for i, t in rows], DOCS)


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_near_duplicates_of_repeated_ids(spark):
    r = random.Random(3)
    a, b, c = prose(r, 80), prose(r, 80), prose(r, 80)
    near_b = b.rsplit(" ", 1)[0] + " zzz"
    found = bagminhash.near_duplicates(docs(spark, [(1, a), (1, b), (2, near_b), (7, c), (None, a)])).collect()
    assert sorted((x["doc_id"] or 0, x["class_id"]) for x in found) == [(0, None), (1, 1), (1, 1), (2, 1), (7, 7)]
    # Text A stays once, under its smallest doc_id, though rows of 5 and 9 go.
    rows = [(3, b), (5, a), (5, b), (9, a), (9, a), (4, c), (4, c), (4, c), (None, a), (None, a), (6, None), (8, ""), (6, None)]
    left = kept(corpus_pipeline.keep_one_of_each_class(spark, docs(spark, rows), ""))
    assert left == sorted([(3, b), (5, a), (4, c), (None, a), (None, a), (6, None)], key=str)


def test_contamination_of_repeated_ids(spark, tmp_path):
    r = random.Random(4)
    one, two, clean = prose(r, 30), prose(r, 30), prose(r, 60)
    bench = spark.createDataFrame([(1, one), (1, two), (2, None), (None, one)], "item_id long, text string")
    rows = [(1, prose(r, 9) + " " + one), (2, two + " " + prose(r, 9)), (2, clean), (3, clean), (None, one), (5, None), (6, "")]
    found = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert found == {(1, 1), (2, 1)}
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    left = kept(corpus_pipeline.drop_contaminated(spark, docs(spark, rows), str(tmp_path)))
    assert left == sorted([(2, clean), (3, clean), (None, one), (5, None), (6, "")], key=str)


def most_python_in_a_task(plan):
    """(Python steps that one task of the plan's last stage goes through, the most of any stage)."""
    if "QueryStage" in plan.nodeName():
        return 0, most_python_in_a_task(plan.plan())[1]
    below = [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.children().apply(i) for i in range(plan.children().size())]
    found = [most_python_in_a_task(x) for x in below]
    last, most = max((x for x, _ in found), default=0), max((x for _, x in found), default=0)
    if "Exchange" in plan.nodeName():
        return 0, most
    last += any(x in plan.nodeName() for x in ("InPandas", "InArrow", "EvalPython"))
    return last, max(most, last)


def test_contamination_uses_one_python_worker_a_task(spark, tmp_path):
    r = random.Random(5)
    passages = [prose(r, 30) for _ in range(5)]
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark")
    docs(spark, [(i, prose(r, 9) + " " + (passages[i] if i < 5 else prose(r, 30))) for i in range(20)]).write.parquet(f"{tmp_path}/documents")
    bench, rows = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("benchmark", "documents"))
    found = decontaminate.contaminated_texts(rows, bench)
    assert {(x["doc_id"], x["item_id"]) for x in found.collect()} == {(i, i) for i in range(5)}
    assert most_python_in_a_task(found._jdf.queryExecution().executedPlan())[1] == 1


def test_bitmap_reaches_the_driver_as_columns(spark):
    ids = spark.range(200_000).select(F.xxhash64("id").alias("id"))
    tracemalloc.start()
    bits = line_dedup.bitmap(ids)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert line_dedup.hit(bits, ids.limit(1_000).toArrow()["id"].to_numpy()).all()
    assert most < 30_000_000  # 8 MB of it are the bitmap itself
    assert not line_dedup.bitmap(ids.filter("id is null")).any()


def jaccard_lines(a, b):
    g = lambda x: {x[i:i + line_dedup.GRAM] for i in range(len(x) - line_dedup.GRAM + 1)} or {x}
    x, y = g(a), g(b)
    return len(x & y) >= 0.8 * len(x | y)


def lines_by_hand(rows):
    """Each text less the lines that an alike one stands before, in the order of (doc_id, place)."""
    places = sorted((i, p, x) for i, t in rows if i is not None for p, x in enumerate((t or "").split("\n")) if x.strip(" "))
    names = sorted({x for _, _, x in places})
    root = {x: x for x in names}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(names):
        for y in names[i + 1:]:
            if jaccard_lines(x, y):
                root[top(x)] = top(y)
    first = {}
    for i, p, x in places:
        first.setdefault(top(x), (i, p))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for p, x in enumerate(lines) if i is None or not x.strip(" ") or first[top(x)] == (i, p)]
        out.append((i, t if len(left) == len(lines) else "\n".join(left)))
    return out


def test_the_five_stages_by_hand(spark, tmp_path):
    r = random.Random(9)
    passage, shared = prose(r, 30), "a line that many documents of this little corpus have in common"
    good = [prose(r, 60) + ".\n" + prose(r, 40) + "." for _ in range(60)]
    junk = [" ".join(["buy", "now", "!!!", "click", "$$$"] * r.randint(8, 20)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(good + junk)]
    rows += [(200 + i, prose(r, 50) + "\n" + shared + ("." if i % 2 else "")) for i in range(6)]
    rows += [(300, good[0]), (301, good[1] + " end"), (302, prose(r, 30) + "\n" + passage), (303, None), (304, ""), (None, good[3]), (305, good[5]), (305, good[5]), (306, "x" * 30_000)]
    labels = [(i, 1 if i < 60 else 0, 0) for i in range(100)] + [(None, 1, 0), (999, 0, None)]
    folder = str(tmp_path)
    docs(spark, rows).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (1, prose(r, 30)), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    start = spark.read.parquet(f"{folder}/documents.parquet")

    # Quality: the operator's own scores, row by row; that the classifier is right on what it was shown.
    passed = corpus_pipeline.reject_low_quality(spark, start, folder)
    assert passed.columns == start.columns
    left = kept(passed)
    assert {i for i, _ in left if i is not None and i < 60} == set(range(60)) and not any(i is not None and 60 <= i < 100 for i, _ in left)
    models = quality.train(start, spark.read.parquet(f"{folder}/labels.parquet"))
    plain = pd.DataFrame([(t or "", "en", "s", None if t is None else len(t)) for _, t in rows], columns=["text", "lang", "source", "n_chars"])
    score = quality.combined(models["quality"], quality.views_of(plain))
    assert left == sorted([row for row, s in zip(rows, score) if s >= 0.5], key=str) and models["toxic"] is None

    passed.write.parquet(f"{folder}/1")
    deduped = corpus_pipeline.remove_duplicate_lines(spark, spark.read.parquet(f"{folder}/1"), folder)
    want = lines_by_hand(left)
    assert deduped.columns == start.columns and kept(deduped) == sorted(want, key=str)
    assert all(x["n_chars"] == len(x["text"]) for x in deduped.collect() if x["text"] is not None)

    deduped.write.parquet(f"{folder}/2")
    single = corpus_pipeline.keep_one_of_each_class(spark, spark.read.parquet(f"{folder}/2"), folder)

    def bag(t):
        words = (t or "").split()
        runs = {}
        for i in range(max(1, len(words) - 4) if words else 0):
            k = tuple(words[i:i + 5])
            runs[k] = runs.get(k, 0) + 1
        return runs

    def alike(x, y):
        a, b = bag(x), bag(y)
        both = sum(min(n, b.get(k, 0)) for k, n in a.items())
        total = sum(a.values()) + sum(b.values()) - both
        return total == 0 or both >= 0.8 * total

    alone = []
    for i, t in sorted({x for x in want if x[0] is not None}, key=lambda x: (x[0], str(x[1]))):
        if not any(alike(t, y) for _, y in alone):
            alone.append((i, t))
    alone += [x for x in want if x[0] is None]
    assert kept(single) == sorted(alone, key=str)

    single.write.parquet(f"{folder}/3")
    clean = corpus_pipeline.drop_contaminated(spark, spark.read.parquet(f"{folder}/3"), folder)
    rest = [x for x in alone if x[0] != 302]
    assert kept(clean) == sorted(rest, key=str)

    model = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    whole = corpus_pipeline.run(spark, folder)
    got = sorted(((x["doc_id"], x["n_tokens"], x["ids_sha256"]) for x in whole.collect()), key=str)
    ids = {t: [*model.encode(t or ""), model.eos_id()] for _, t in rest}
    assert got == sorted([(i, len(ids[t]), hashlib.sha256(" ".join(map(str, ids[t])).encode()).hexdigest()) for i, t in rest], key=str)


def test_the_pipeline_on_empty_tables(spark, tmp_path):
    for name, rows, schema in (("documents", [], DOCS), ("labels", [], "doc_id long, quality int, toxic int"), ("benchmark", [], "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_templated_lines_and_a_document_of_many_lines(spark):
    """Lines of one template are not alike; they cost counts, not comparisons. A long document loses its lines in one go."""
    templated = "\n".join(f"record {i:06d} was written by station {i * 7919 % 20011:05d} today" for i in range(20_000))
    many = "\n".join("%x" % (i * 2654435761 % 2**32) for i in range(100_000))
    got = {r["doc_id"]: r["n"] for r in line_dedup.dedup_lines(docs(spark, [(1, templated), (2, many), (3, many), (4, templated)]), counted="n").select("doc_id", "n").collect()}
    assert got[3] == 100_000 and got[4] == 20_000 and got[1] < 20_000 and got[2] == 0


def test_token_counts_of_one_long_run(spark, monkeypatch):
    model = token_counts.units(str(public_tokenizers.path(token_counts.MODEL)))
    r = random.Random(2)
    run = "".join(r.choices("abcdefgh", k=1_000_000))
    assert token_counts.count_huge(model.encode, "some words " + run + " and more") == len(model.encode(["some words " + run + " and more"])[0])
    monkeypatch.setattr(token_counts, "TABLE_CHARS", 20_000)
    for start in range(0, 200, 20):  # texts that are one unit each, and units that are very long
        spaced = ["　".join(prose(r, 40) for _ in range(3)) + str(i) for i in range(start, start + 10)] + [run[i:i + 3_000] for i in range(start, start + 10)]
        assert model.counts(spaced) == [len(x) for x in model.encode(spaced)]
        assert sum(map(len, model.numbers)) == model.chars < 20_000 + sum(map(len, spaced))


def test_nearest_of_huge_components(spark):
    r = np.random.default_rng(4)
    vectors = {i: r.normal(size=8).tolist() for i in range(200)}
    vectors[20] = [1.7e308] * 8
    vectors[21] = [1.7e308, -1.7e308] * 4
    vectors[22] = [5e-324] * 8
    df = spark.createDataFrame([(i, v) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    got = {}
    for x in nearest.nearest(df, F.col("vec_id") % 20 == 0, k=5).collect():
        got.setdefault(x["query_id"], {})[x["rank"]] = (x["vec_id"], x["score"])
    assert set(got) == set(range(0, 200, 20)) and all(len(v) == 5 for v in got.values())
    for q in range(40, 200, 20):
        exact = sorted(((float(np.dot(vectors[q], v)), -i) for i, v in vectors.items() if i != q and abs(v[0]) < 1e300), reverse=True)
        plain = [v for _, v in sorted(got[q].items()) if abs(v[1]) < 1e300]
        assert [i for i, _ in plain] == [-i for _, i in exact[:len(plain)]]


def test_features_leave_a_task_in_slices(monkeypatch):
    import pyarrow as pa

    from civiclake.llm import quality

    monkeypatch.setattr(quality, "SLICE_CHARS", 100)
    texts = [f"word {i} of some text" for i in range(40)] + ["long " * 100, "", "é" * 60]
    n = len(texts)
    part = pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "text": texts, "lang": ["en", None, *["de"] * (n - 2)], "source": [None] * n, "n_chars": pa.array([5, None, *[7] * (n - 2)], pa.int64()), "text_id": list(range(n)), "bucket": [1] * n})
    found = list(quality._features(iter([part])))
    assert len(found) > 10 and max(x.num_rows for x in found) <= 8
    rows = pd.concat([x.to_pandas() for x in found], ignore_index=True)
    assert rows["doc_id"].tolist() == list(range(n)) and set(rows["bucket"]) == {1}
    own = part.to_pandas()
    words, pages = quality.feature_lists(own)
    for i in range(n):
        assert rows["words"][i].tolist() == words[i][0].tolist() and rows["word_values"][i].tolist() == words[i][1].tolist()
        assert rows["page"][i].tolist() == pages[i][0].tolist() and rows["page_values"][i].tolist() == pages[i][1].tolist()


def test_small_keys_prepare_a_line_once():
    from civiclake.llm.components import _across, _passing
    from civiclake.llm.line_dedup import SIMILAR, alike, bands, gram_sets

    random = np.random.default_rng(5)
    base = ["".join(random.choice(list("abcdefgh "), 60)) for _ in range(40)]
    lines = [x for b in base for x in (b, b[:50] + "0" + b[51:], b + "zz")]
    keys = bands(lines)
    rows = [(int(k), 0, 0, 0, i, keys[i], x) for i, x in enumerate(lines) for k in keys[i] if k]
    frame = pd.DataFrame(rows, columns=["key", "lo", "hi", "own", "component", "bands", "data"]).sort_values("key", ignore_index=True)
    prepared = []

    def prepare(texts):
        prepared.extend(texts)
        return gram_sets(texts)

    def roots(found):
        root = list(range(len(lines)))
        for a, b in found:
            root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
        return root

    found = pd.concat(_across(prepare, alike, SIMILAR)(iter([frame])))
    expected, apart = [], []
    for (key, lo, hi), own in frame.groupby(["key", "lo", "hi"]):
        a, b = _passing(key, lo, hi, *[own[x].to_numpy() for x in ("own", "component", "bands", "data")], lambda texts: apart.extend(texts) or gram_sets(texts), alike, SIMILAR)
        expected += zip(a, b)
    assert roots(zip(found["a"], found["b"])) == roots(expected) and len(set(roots(expected))) < 100
    assert prepared and len(prepared) <= len(set(prepared)) + 3 < len(apart)  # the last key of a task comes in a frame of its own


def test_signing_counts_the_first_grams_only():
    from civiclake.llm.line_dedup import SHORT, SIMILAR, distinct, grams

    random = np.random.default_rng(6)
    lines = ["".join(random.choice(list(letters), n)) for letters in ("ab", "abc", "abcdefgh") for n in range(90, 500, 7)] + ["ab" * 300, "x" * 1000]
    hashes, each = grams(lines)
    counted = distinct(hashes, each)
    whole = [len(set(x[i:i + 8] for i in range(len(x) - 7))) for x in lines]
    for own, full, n in zip(counted.tolist(), whole, each.tolist()):
        assert (own <= SHORT) == (full <= SHORT) or n < SIMILAR * SHORT
        assert (own >= SIMILAR * SHORT) == (full >= SIMILAR * SHORT)
    assert counted[-3] == SHORT + SHORT // 4 < whole[-3]


def test_keys_leave_a_task_packed(monkeypatch):
    """Keys go out as a row per bucket; a hot key is not held; what meets is what plain counting finds."""
    monkeypatch.setattr(line_dedup, "BUCKET_BITS", 2)
    random = np.random.default_rng(7)
    base = ["".join(random.choice(list("abcdefgh "), 60)) for _ in range(60)]
    lines = base + [b + "zz" for b in base[:20]] + ["the same line again and again " + "%x" % (i * 2654435761 % 2**20) for i in range(40)] + base[50:] * 3
    ids = [line_dedup.mix(np.array([lines.index(x)], np.uint64)).view(np.int64)[0] for x in lines]
    parts = [pd.DataFrame({"id": ids[a:a + 30], "line": lines[a:a + 30]}) for a in range(0, len(lines), 30)]
    own = {i: {int(k) for k in keys if k} for i, keys in zip(ids, line_dedup.bands(lines))}
    met = {k: {i for i in own if k in own[i]} for keys in own.values() for k in keys}
    several = {(k, i) for k, found in met.items() if len(found) > 1 for i in found}
    repeated = {i for i in ids if ids.count(i) > 1}
    for held in (1 << 20, 30):
        monkeypatch.setattr(line_dedup, "HELD_KEYS", held)
        for dealt in (parts, [pd.concat(parts)]):
            packed = pd.concat([x for part in dealt for x in line_dedup._keys(iter([part]))]).sort_values("bucket", kind="stable", ignore_index=True)
            assert held == 30 or len(packed) <= 4 * len(dealt)
            got = pd.concat(list(line_dedup._meeting(iter([packed[:3], packed[3:]]))))
            got = set(zip(got["key"].tolist(), got["id"].tolist()))
            assert several <= got and repeated <= {i for _, i in got}
            assert {i for _, i in got - several} <= repeated and all(k in own[i] for k, i in got)


def test_line_dedup_of_a_doc_id_with_several_texts(spark):
    rows = [(1, "some first line here\nanother line of text"), (2, "an unlike beginning\nsome first line here"), (2, "quite another start\nthe third line of all"), (2, "an unlike beginning\nsome first line here"), (None, "some first line here"), (3, None), (4, "nothing to remove")]
    got = line_dedup.dedup_lines(docs(spark, rows), counted="n").select("doc_id", "text", "n").collect()
    want = [(1, rows[0][1], 0), (2, "an unlike beginning", 1), (2, "an unlike beginning", 1), (2, rows[2][1], 0), (3, None, 0), (4, rows[6][1], 0), (None, rows[4][1], 0)]
    assert sorted(map(tuple, got), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")) == want


def test_components_of_thinly_spread_edges(spark, monkeypatch):
    """A few edges in many partitions take no rounds of stars; more than a task joins do."""
    rounds = []
    stars = components._stars
    monkeypatch.setattr(components, "_stars", lambda edges: rounds.append(1) or stars(edges))
    edges = spark.createDataFrame([(i, i + 1) for i in range(300) if i % 50 != 49], "a long, b long").repartition(40)
    want = {i: i - i % 50 for i in range(300)}
    assert {r["id"]: r["component"] for r in components.components(edges).collect()} == want
    assert not rounds
    monkeypatch.setattr(components, "EDGES", 100)
    assert {r["id"]: r["component"] for r in components.components(edges).collect()} == want
    assert rounds
