"""The corpus operators against brute force, libraries and planted cases, with nulls, ties, repeats and extra columns."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from civiclake.llm import bagminhash, components, decontaminate, license_scan, line_dedup, nearest, pii, quality, sentencepiece_ids, substring_dedup, token_counts
from civiclake.llm.suite import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long, chunk long, id long"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def docs(spark, texts):
    """Documents with clashing further columns; texts by doc_id in order."""
    return spark.createDataFrame([(i, t, "en", None, None, 7, 9) for i, t in enumerate(texts)], DOCS)


def prose(random, n):
    return " ".join("".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7))) for _ in range(n))


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


ODD = [None, "", "   ", "\n\n", "x", "a  b\n\tc ", "é ́ ▁x▁", "🙂🙂 　x \xa0 y", "<|endoftext|> </s> <s>", "w" * 30_000, "'ll we'll " * 50]


def test_substring_dedup_against_windows(spark):
    r = random.Random(1)
    passage, other = prose(r, 40), prose(r, 25)
    texts = [*ODD, prose(r, 60), passage, prose(r, 10) + " " + passage + "\n" + prose(r, 5), " ".join([other, other]), "the of " * 40]
    texts += [prose(r, 3) + " " + passage[: r.randint(50, 150)] + " " + other for _ in range(20)] + [passage, passage]

    def brute():
        seen, out = {}, []
        for text in texts:
            words = (text or "").encode().split()
            gone = [False] * len(words)
            for i in range(len(words) - 19):
                key = tuple(words[i:i + 20])
                if key in seen:
                    gone[i:i + 20] = [True] * 20
                seen.setdefault(key, 1)
            out.append((len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g)))
        return out

    for size in (400, 4_000_000):
        got = rows(substring_dedup.substring_dedup(docs(spark, texts), chunk_chars=size))
        assert [(got[i]["n_words"], got[i]["n_removed"], bytes(got[i]["kept"])) for i in range(len(texts))] == brute()
    assert substring_dedup.substring_dedup(docs(spark, texts).limit(0)).count() == 0
    null = spark.createDataFrame([(None, passage), (5, passage)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(null, digest=True).collect()} == {None: 0, 5: 40}


def test_sentencepiece_as_the_library(spark):
    path = str(public_tokenizers.path(sentencepiece_ids.MODEL))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = rows(sentencepiece_ids.encode(docs(spark, ODD), path))
    short = rows(sentencepiece_ids.digests(docs(spark, ODD), path))
    for i, text in enumerate(ODD):
        ids = [*model.encode(text or ""), model.eos_id()]
        assert got[i]["ids"] == ids and got[i]["decoded"] == model.decode(ids)
        assert short[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert (short[i]["n_tokens"], short[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(model.decode(ids).encode()).hexdigest())
    small = sentencepiece_ids.Encoder(path, table_words=3)  # the table's size changes nothing
    for _ in range(2):
        assert [x.tolist() for x in small.ids([t or "" for t in ODD])] == [[*model.encode(t or ""), model.eos_id()] for t in ODD]


def test_token_counts_as_the_library(spark):
    path = str(public_tokenizers.path(token_counts.MODEL))
    model = Tokenizer.from_file(path)
    r = random.Random(2)
    texts = [*ODD, prose(r, 20_000), "a" * 60_000, "ab1! " * 12_000, "é\n" * 30_000, "<|endoftext|>" * 5_000]
    got = rows(token_counts.token_counts(docs(spark, texts), path))
    for i, text in enumerate(texts):
        n = len(model.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((text or "").encode()), n > 512)
    encode = lambda x: model.encode_batch(x, add_special_tokens=False)
    for text in ["'ll" * 900, " " * 800 + "x" * 900, "日本語" * 700, prose(r, 900)]:
        assert token_counts.count_huge(encode, text, 300, 16) == len(model.encode(text, add_special_tokens=False).ids)


def test_pii_patterns_and_field(spark):
    def brute(t):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            digits = re.sub("[ -]", "", m[0])
            if 13 <= len(digits) <= 19 and pii.luhn(digits):
                out.append(("card", *m.span()))
        return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]

    r = random.Random(3)
    for _ in range(3000):
        text = "".join(r.choice(r.choice(["a@.-1", "0123456789.", "0123 -4", "+1(5) 0-9."])) for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == brute(text)
    texts = [*ODD, "mail a.b@c.example.org or +1 (366) 555-9807", "ring (555) 014-2233 now", "in 1987 there were 12 cats", "card 4111 1111 1111 1111"]
    got = rows(pii.find_pii(docs(spark, texts), pii.labelled_table(spark)))
    n = len(ODD)
    assert [tuple(s) for s in got[n]["base"]] == [("email", 5, 22), ("phone", 26, 43)]
    assert [tuple(s) for s in got[n + 1]["added"]] == [("phone", 5, 19)] and got[n + 2]["added"] == []
    assert all(got[i]["base"] == [] and got[i]["added"] == [] for i in range(n))
    empty = pii.find_pii(docs(spark, texts), pii.labelled_table(spark).limit(0))
    assert empty.where("size(added) > 0").count() == 0


def jaccard(a, b):
    _, ka, wa = bagminhash.bags([a])
    _, kb, wb = bagminhash.bags([b])
    x, y = dict(zip(ka, wa)), dict(zip(kb, wb))
    low = sum(min(n, y.get(k, 0)) for k, n in x.items())
    return low / (sum(x.values()) + sum(y.values()) - low)


def test_bagminhash_is_unbiased():
    r = random.Random(4)
    words = prose(r, 60).split()
    a, b = " ".join(words * 3), " ".join(words * 2 + words[:30] + prose(r, 30).split())
    doc, keys, weight = bagminhash.bags([a, b])
    signed = bagminhash.signatures(doc, keys, weight, 2, 4000)
    assert abs((signed[0] == signed[1]).mean() - jaccard(a, b)) < 0.04


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(5)
    texts = [None, "", "one two", "one two", "x y z"]
    for _ in range(12):
        base = prose(r, 120).split()
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 5)):
            copy = list(base)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = prose(r, 1)
            texts.append(" ".join(copy))
    parent = list(range(len(texts)))

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for i in range(len(texts)):
        for j in range(i):
            a, b = (texts[i] or "").split(), (texts[j] or "").split()
            if (a == b) or (a and b and jaccard(texts[i], texts[j]) >= 0.8):
                u, v = top(i), top(j)
                parent[max(u, v)] = min(u, v)
    got = rows(bagminhash.near_duplicates(docs(spark, texts)))
    assert {i: x["class_id"] for i, x in got.items()} == {i: top(i) for i in range(len(texts))}
    assert bagminhash.near_duplicates(docs(spark, texts).limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (4, "a b c")], "doc_id long, text string")
    assert sorted((x["doc_id"] or 0, x["class_id"]) for x in bagminhash.near_duplicates(nulls).collect()) == [(0, None), (3, 3), (4, 3)]


def test_components_against_union_find(spark):
    r = random.Random(15)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(120)] + [(7, 7)]
    r.shuffle(pairs)
    group = {x: x for p in pairs for x in p}

    def top(x):
        return x if group[x] == x else top(group[x])

    for a, b in pairs:
        u, v = top(a), top(b)
        group[max(u, v)] = min(u, v)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(16)
    got = components.components(edges).collect()
    assert len(got) == len(linked) and {x["id"]: x["component"] for x in got} == {x: top(x) for x in linked}
    assert components.components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1_024, 3])
def test_links_beside_a_hub_that_is_unlike_them(spark, monkeypatch, block):
    """Key 5 is shared by all, and its hub is similar to few; numbers are similar when they differ by one at most."""
    monkeypatch.setattr(components, "BLOCK", block)
    numbers = {i: n for i, n in enumerate([50, 1, 2, 3, 10, 11, 30, 51, 70, 71, 72, 73])}
    frame = spark.createDataFrame([(5, i, 0, len(numbers)) for i in numbers] + [(9, i, 8, 2) for i in (8, 9)], "key long, id long, hub long, n long")
    data = [(i, str(n), [5, 9 if i in (8, 9) else 0]) for i, n in numbers.items()]
    items = spark.createDataFrame(data, "id long, data string, bands array<long>")
    got = components.linked(frame, lambda ids: items.join(ids, "id"), lambda texts: [np.array([int(x)]) for x in texts], lambda a, b: abs(int(a[0]) - int(b[0])) <= 1)
    known = {r["id"]: r["component"] for r in got.collect()}
    assert [known.get(i, i) for i in numbers] == [0, 1, 1, 1, 4, 4, 6, 0, 8, 8, 8, 8]


def test_line_dedup_against_all_pairs(spark):
    r = random.Random(6)
    lines = [prose(r, r.choice([1, 4, 12, 40])) for _ in range(40)]
    lines += [x + "!" for x in lines if len(x) > 60] + [x.replace("a", "e", 1) for x in lines if len(x) > 100]
    texts = [None, "", " \n", *["\n".join(r.sample(lines, 6)) for _ in range(25)]]
    places = [(d, p, x) for d, t in enumerate(texts) for p, x in enumerate((t or "").split("\n")) if x.strip()]
    group = list(range(len(places)))

    def top(x):
        return x if group[x] == x else top(group[x])

    sets = [{x[k:k + 8] for k in range(max(1, len(x) - 7))} for *_, x in places]
    for i in range(len(places)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                u, v = top(i), top(j)
                group[max(u, v)] = min(u, v)
    kept = {places[i][:2] for i in range(len(places)) if top(i) == i}
    want = {d: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip() or (d, p) in kept) for d, t in enumerate(texts)}
    out = line_dedup.dedup_lines(docs(spark, texts))
    assert out.columns == docs(spark, texts).columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == want
    assert line_dedup.dedup_lines(docs(spark, texts).limit(0)).count() == 0


def test_line_dedup_of_lines_that_repeat_their_grams(spark):
    r = random.Random(12)
    phrase, long = prose(r, 8) + " ", prose(r, 60) + " "
    lines = ["-" * 60, "-" * 200, "-" * 1_000, "=-" * 40, "=-" * 300, phrase * 2, phrase * 9, long * 2, long * 5, prose(r, 60)]
    sets = [{x[k:k + 8] for k in range(len(x) - 7)} for x in lines]
    alone = [i for i, a in enumerate(sets) if not any(len(a & b) >= 0.8 * len(a | b) for b in sets[:i])]
    assert alone == [0, 3, 5, 7, 9]
    out = line_dedup.dedup_lines(docs(spark, lines)).collect()
    assert {x["doc_id"]: x["text"] for x in out} == {i: x if i in alone else "" for i, x in enumerate(lines)}


def test_contamination_finds_exact_and_edited_passages(spark):
    r = random.Random(7)
    items = [prose(r, n) for n in (30, 15, 50, 3)]
    edited = items[2].split()
    for i in range(2, 50, 9):
        edited[i] = "changed"
    texts = [*ODD, prose(r, 400) + " " + items[0].upper() + ", " + prose(r, 300), prose(r, 50) + " " + " ".join(edited), items[1], prose(r, 500), items[3]]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)] + [(None, "x", 1), (9, None, 1), (8, "", 1)], "item_id long, text string, doc_id long")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    n = len(ODD)
    assert set(got) == {(n, 0), (n + 1, 2), (n + 2, 1), (n + 4, 3)} and got[n, 0] == 1.0 and 0.5 < got[n + 1, 2] < 1
    assert decontaminate.contaminated(docs(spark, texts), bench.limit(0)).count() == 0


def test_contamination_finds_copies_with_every_fifth_word_changed(spark):
    rng = random.Random(13)
    alone, beside = ([f"{name}{i}" for i in range(50)] for name in "ab")
    edited = lambda words: " ".join(f"x{rng.randrange(10**9)}" if i % 5 == 4 else w for i, w in enumerate(words))
    texts = [edited(alone), " ".join(beside)]
    texts += [prose(rng, 80) + " " + edited(beside) + " " + prose(rng, 80) for _ in range(8)]
    bench = spark.createDataFrame([(1, " ".join(alone)), (2, " ".join(beside))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert got.keys() == {(0, 1)} | {(i, 2) for i in range(1, 10)}
    assert got[0, 1] == pytest.approx(0.7, abs=0.02) and got[1, 2] == 1.0


def test_alignment_against_the_table():
    def plain(a, b):
        h, best = np.zeros((len(a) + 1, len(b) + 1)), 0.0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -0.5), h[i - 1, j] - 0.5, h[i, j - 1] - 0.5)
                best = max(best, h[i, j])
        return best

    r = np.random.default_rng(8)
    items = [r.integers(0, 5, r.integers(1, 12)) for _ in range(60)]
    parts = [r.integers(0, 5, r.integers(1, 30)) for _ in range(60)]
    assert decontaminate.smith_waterman(items, parts).tolist() == [plain(a, b) for a, b in zip(items, parts)]


def test_nearest_against_brute_force(spark):
    r = np.random.default_rng(9)
    x = r.standard_normal((600, 16))
    x[100:160] = x[100]
    data = [(i, v.tolist(), 3) for i, v in enumerate(x)] + [(900, None, 1), (920, [], 1), (940, [0.0] * 16, 1), (960, [None] + [1.0] * 15, 1), (980, [float("nan")] * 16, 1), (None, [1.0] * 16, 1), (20, x[20].tolist(), 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, rank int")
    found = nearest.nearest(df, F.col("vec_id") % 20 == 0).collect()
    hits = 0
    for q in range(0, 600, 20):
        mine = sorted((f["rank"], f["vec_id"], f["score"]) for f in found if f["query_id"] == q)
        score = x @ x[q]
        best = [i for i in sorted(range(600), key=lambda i: (-round(float(score[i]), 9), i)) if i != q][:20]
        assert [m[0] for m in mine] == list(range(1, 21)) and all(abs(s - score[v]) < 1e-9 for _, v, s in mine)
        hits += len(set(best) & {m[1] for m in mine})
    assert hits / 600 >= 0.9 and {f["query_id"] for f in found} == set(range(0, 600, 20))
    assert nearest.nearest(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("kind", ["one long", "log-normal"])
def test_nearest_of_unequal_norms(spark, kind):
    r = np.random.default_rng(10)
    x = r.standard_normal((4_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x *= np.exp(r.standard_normal(len(x)))[:, None] if kind == "log-normal" else np.where(np.arange(len(x)) == 7, 10.0, 1.0)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = nearest.nearest(df, F.col("vec_id") % 40 == 0).collect()
    score = x[::40] @ x.T
    score[np.arange(100), np.arange(0, 4_000, 40)] = -np.inf
    true = {(40 * q, int(i)) for q, order in enumerate(np.argsort(-score, axis=1)[:, :20]) for i in order}
    assert len(found) == 2_000
    assert len(true & {(y["query_id"], y["vec_id"]) for y in found}) >= 0.95 * len(true)


def test_quality_learns_and_keeps_clean_documents(spark):
    r = random.Random(10)
    texts, labels = [], []
    for i in range(240):
        text, good, toxic = prose(r, 60), 1, 0
        if i % 4 == 1:
            text, good = " ".join(w.upper() + "!!" for w in text.split()), 0
        if i % 4 == 2:
            text, toxic = text + " you nasty fool " + prose(r, 20), 1
        texts.append(text)
        labels.append((i, good, toxic))
    frame = docs(spark, [*texts, None])
    marks = spark.createDataFrame(labels[:160] + [(5000, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    models = quality.train(frame, marks)
    scored = frame.withColumn("s", quality.scorer(frame, models)).select("doc_id", quality.passes(F.col("s")).alias("keep"))
    got = {x["doc_id"]: x["keep"] for x in scored.collect()}
    assert len(got) == 241
    right = sum(got[i] == (i % 4 in (0, 3)) for i in range(160, 240))
    assert right >= 76
    assert quality.train(frame, marks.limit(0)) == {"quality": None, "toxic": None}


def test_license_scores_and_nearest_directory(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = spark.createDataFrame([
        (1, "a/LICENSE", mit), (2, "a/x.py", "code here"), (3, "a/b/y.py", gpl + "\nmany other words of code here and there, quite unlike any licence " * 3),
        (4, "a/b/LICENSE", gpl), (5, "a/b/c/z.py", None), (6, "top.py", "nothing"), (7, None, "nothing"), (8, "ab/q.py", ""), (2, "a/x.py", "code here")],
        "doc_id long, path string, text string")
    got = rows(license_scan.scan_licenses(files, license_scan.template_table(spark)))
    assert {k: (v["license"], v["inherited_from"]) for k, v in got.items()} == {
        1: ("MIT", None), 2: ("MIT", "a"), 3: ("GPL-3.0", None), 4: ("GPL-3.0", None), 5: ("GPL-3.0", "a/b"), 6: (None, None), 7: (None, None), 8: (None, None)}
    assert got[3]["license_file"] is False and got[1]["license_file"] is True
    assert license_scan.scan_licenses(files.limit(0), license_scan.template_table(spark)).count() == 0
    assert license_scan.scan_licenses(files, license_scan.template_table(spark).limit(0)).where("license is not null").count() == 0


def test_license_files_of_whole_texts(spark):
    texts = {r["license"]: r["text"] for r in license_scan.template_table(spark).collect() if license_scan.is_whole(r["text"])}
    mit = re.sub(r"<[^>]*>", "2021", "Copyright of Some One and Others\n" + texts["MIT"])
    files = spark.createDataFrame([
        (1, "m/LICENSE", mit), (2, "m/src/x.py", "code here"), (3, "a/LICENSE", " ".join(texts["Apache-2.0"].split())), (4, "a/x/y/z.py", "more code"),
        (5, "g/COPYING", texts["GPL-3.0"].replace("\n\n", "\n \n")), (6, "g/q.py", None), (7, "n/README", prose(random.Random(3), 500)), (8, "g/old/COPYING", texts["GPL-2.0"]), (9, "g/old/r.py", "")],
        "doc_id long, path string, text string")
    got = rows(license_scan.scan_licenses(files, license_scan.template_table(spark)))
    assert {k: (v["license"], v["inherited_from"], v["license_file"]) for k, v in got.items()} == {
        1: ("MIT", None, True), 2: ("MIT", "m", False), 3: ("Apache-2.0", None, True), 4: ("Apache-2.0", "a", False), 5: ("GPL-3.0", None, True),
        6: ("GPL-3.0", "g", False), 7: (None, None, False), 8: ("GPL-2.0", None, True), 9: ("GPL-2.0", "g/old", False)}


def test_quality_teaches_from_every_unlabelled_row(spark):
    r = random.Random(11)
    texts = [(" ".join(w.upper() + "!!" for w in prose(r, 40).split()) if i % 3 == 1 else prose(r, 40)) for i in range(300)] + [None, "", "same text"] + ["same text"] * 60
    frame = docs(spark, texts).repartition(5)
    found = quality.features(frame)
    pool = found.withColumn("weight", F.when(F.col("doc_id") >= 302, 0.25).otherwise(1.0))
    rows = pool.orderBy("doc_id").toPandas()
    assert len(rows) == len(texts)
    views = quality.rows_of(rows)
    # Lengths differ a little, so a weight on one number of each view leaves some rows sure and some not.
    weights = [np.linspace(-3, 3, v.size) for v in views]
    platt = [np.array([1.0, -float(np.median(v.times(w)))]) for v, w in zip(views, weights)]
    taught = quality.teach(pool, {"quality": {"weights": weights, "platt": platt}})["quality"]
    for view, other in ((0, 1), (1, 0)):
        score = quality.chances(views[view], weights[view], platt[view])
        for label, sure in ((0, score <= 1 - quality.SURE), (1, score >= quality.SURE)):
            for bucket in range(quality.GROUPS):
                own = sure & (rows["bucket"].to_numpy() == bucket)
                share, part = rows["weight"].to_numpy()[own], views[other].take(own)
                assert taught[other].counts[label, bucket] == share.sum()
                assert np.array_equal(taught[other].present[label, bucket], np.bincount(part.index, share[part.row] * (part.value != 0), part.size))
                assert np.allclose(taught[other].total[label, bucket], np.bincount(part.index, share[part.row] * part.value, part.size), atol=0.01)
        assert taught[other].counts.sum() > 0


def test_contamination_with_every_fourth_word_changed_and_against_all_pairs(spark):
    r = random.Random(12)
    words = prose(r, 90).split()
    item = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [item(n) for n in (3, 4, 12, 40, 61)]
    texts = [item(r.randint(0, 150)) for _ in range(20)]
    planted = set()
    for number, text in enumerate(items):
        own = text.split()
        changed = " ".join(w if place % 4 != 3 else "edited" for place, w in enumerate(own))
        for copy in (text, changed) if len(own) > 4 else (text,):
            planted.add((len(texts), number))
            texts.append(f"{item(70)} {copy} {item(50)}")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert planted <= set(got)
    hashed = decontaminate._hashed([x.split() for x in [*items, *texts]])
    runs = lambda text: [tuple(text.split()[i:i + 3]) for i in range(len(text.split()) - 2)]
    for i, text in enumerate(texts):
        for j, own in enumerate(items):
            true = decontaminate.smith_waterman([hashed[j]], [hashed[len(items) + i]])[0] / len(own.split()) if text else 0.0
            shared = len([x for x in runs(own) if x in set(runs(text))])
            if true >= decontaminate.SIMILAR and shared >= min(2, len(runs(own))):
                assert got[i, j] == true
            else:
                assert (i, j) not in got
