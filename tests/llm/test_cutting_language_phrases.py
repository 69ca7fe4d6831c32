"""Fill-in-middle, language identification and collocations against brute force, with nulls, repeats, empty tables and further columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from civiclake.llm import collocations, fill_in_middle, language_id
from civiclake.llm.suite import ship

DOCS = "doc_id long, text string, lang string, source string, n long, rank long, bucket long, form string"
ODD = [None, "", " ", "\n", "\n\n\n", "x", "a\nb", "a\nb\n", "<P>a", "a<S", "M>\n<", "<\n<P\n", "é🙂\n\r\n \x0b\nz", "a $1 \\ {2}\n" * 9, "line\n" * 40_000, "y" * 200_000, "\n" * 100_000, "<M>" * 3]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def docs(spark, rows):
    """Documents from (doc_id, text, lang) with clashing further columns."""
    return spark.createDataFrame([(i, t, lang, None, 1, 2, 3, "z") for i, t, lang in rows], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def cut_by_hand(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if text == "" or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", p, m, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", p, m, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("choice", [{}, {"seed": 3, "rate": 60, "spm": 20}])
def test_fill_in_middle_against_lines(spark, choice):
    r = random.Random(2)
    texts = ODD + ["".join(r.choice(["a", "bc", "\n", "<", "P>", "é"]) for _ in range(r.randint(0, 60))) for _ in range(300)]
    given = [(i, t, "en") for i, t in enumerate(texts)] + [(5, "x\ny\nz", "en"), (5, "x\ny\nz", "en"), (None, "p\nq\nr\n", None)]
    frame = fill_in_middle.restore(fill_in_middle.fill_in_middle(docs(spark, given).repartition(6), **choice))
    got = Counter((x["doc_id"], x["n"], x["form"], x["prefix"], x["middle"], x["output"]) for x in frame.collect())
    assert got == Counter((i, *cut_by_hand(i, t, **choice)) for i, t, _ in given)
    assert frame.filter("restored <> text").count() == 0
    assert {x["form"] for x in frame.collect()} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(docs(spark, [])).count() == 0


def test_fill_in_middle_stays_in_the_jvm(spark):
    plan = fill_in_middle.fill_in_middle(docs(spark, [(1, "a\nb", "en")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


ALPHABETS = {"aa": "abcdeéf", "bb": "fghijkla", "cc": "абвгде", "dd": "mnopqéß"}


def invented(r, lang, n):
    return " ".join("".join(r.choice(ALPHABETS[lang]) for _ in range(r.randint(1, 8))) for _ in range(n))


def folded_grams(text, bits):
    """The buckets of one text, one code point at a time."""
    text = " " + "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text) + " "
    code = [ord(c) if c != " " else 0 for c in text]
    out = Counter()
    for i in range(len(code)):
        held = 0
        for k in range(1, language_id.ORDER + 1):
            c = code[i + k - 1] if i + k - 1 < len(code) else 0
            held = ((held ^ c) * int(language_id.FACTOR)) & 0xFFFFFFFF
            held ^= held >> 15
            inner = all(code[i + j] if i + j < len(code) else 0 for j in range(1, k - 1))
            whole = c > 0 if k == 1 else inner and (k > 2 or c > 0 or code[i] > 0)
            if whole:
                out[((held * (0x85EBCA6B + 2 * k)) & 0xFFFFFFFF) >> (32 - bits)] += 1
    return out


def test_language_id_against_counting(spark, monkeypatch):
    r = random.Random(5)
    given = [(i, invented(r, lang, r.randint(1, 60)), lang) for i, lang in enumerate(r.choices(list(ALPHABETS), [6, 2, 1, 1], k=300))]
    given += [(900, None, "aa"), (901, "", "aa"), (902, "123 --", "bb"), (903, "abc", None), (904, "ÀÉ🙂 İ" * 50, "aa"), (None, "abc abc", "bb"), (3, given[3][1], given[3][2])]
    rows = language_id.known_rows(docs(spark, given))
    bits = 10
    model = language_id.train(rows, bits=bits)
    learned = [(t, lang) for i, t, lang in given if t is not None and lang is not None and zlib.crc32(str("" if i is None else i).encode()) % 5]
    langs = sorted({lang for _, lang in learned})
    assert model.langs == langs
    counts = {lang: Counter() for lang in langs}
    for t, lang in learned:
        counts[lang].update(folded_grams(t, bits))
    rates = {k: np.log((np.array([c[b] for b in range(1 << bits)]) + language_id.SMOOTH) / (sum(c.values()) + language_id.SMOOTH * (1 << bits))) for k, c in counts.items()}
    prior = {k: np.log(sum(x == k for _, x in learned) / len(learned)) for k in langs}
    got = {}
    for row in language_id.identify(rows.repartition(5), model).collect():
        got.setdefault(row["doc_id"], []).append(row)
    hits = 0
    for i, t, lang in given:
        row = got[i][0]
        assert row["held_out"] == (zlib.crc32(str("" if i is None else i).encode()) % 5 == 0)
        if t is None or not any(map(str.isalpha, t)):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        scores = {k: prior[k] + sum(n * rates[k][b] for b, n in folded_grams(t, bits).items()) for k in langs}
        best = max(langs, key=lambda k: scores[k])
        assert row["lang_pred"] == best
        assert row["score"] == pytest.approx(1 / sum(np.exp(s - scores[best]) for s in scores.values()), abs=1e-4)
        hits += best == lang
    assert hits > 0.98 * 300
    # Blocks that cut through words and texts change nothing.
    texts = [t or "" for _, t, _ in given]
    whole = model.log_likelihoods(texts)
    monkeypatch.setattr(language_id, "BLOCK", 37)
    assert np.allclose(model.log_likelihoods(texts), whole, atol=1e-6)


def test_language_id_reads_no_label_of_held_out_rows(spark):
    given = [(i, invented(random.Random(i), "aa" if i % 2 else "bb", 12), "aa" if i % 2 else "bb") for i in range(80)]
    other = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in given]
    results = []
    for x in (given, other):
        rows = language_id.known_rows(docs(spark, x))
        results.append(sorted(map(tuple, language_id.identify(rows, language_id.train(rows)).collect())))
    assert results[0] == results[1]
    null_ids = language_id.known_rows(docs(spark, [((1 << 60) + 1, "abc", "aa"), (None, "abc", "aa")]))
    assert {x["doc_id"] for x in language_id.identify(null_ids, language_id.train(null_ids)).collect()} == {(1 << 60) + 1, None}


def test_language_id_where_nothing_is_learned(spark):
    rows = language_id.known_rows(docs(spark, [(1, "abc", None), (2, None, "aa")]))
    assert {tuple(x)[2:] for x in language_id.identify(rows, language_id.train(rows)).collect()} == {("und", 0.0)}
    empty = language_id.known_rows(docs(spark, []))
    assert language_id.identify(empty, language_id.train(empty)).count() == 0


def test_language_id_folds_buckets_for_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "CELLS", 1 << 10)
    given = [(i, invented(random.Random(i), "cc" if i % 3 else "aa", 30), ("cc" if i % 3 else "aa") + str(i % 6)) for i in range(120)]
    model = language_id.train(language_id.known_rows(docs(spark, given)), bits=12)
    assert len(model.langs) << model.bits <= 1 << 10


def phrases_by_hand(given, least, top):
    counts, total = {}, Counter()
    for _, text, lang in given:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i:i + m])] += 1
    out = []
    for lang, f in counts.items():
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = {p[i:i + m] for p, b in some.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * b >= 80 * f[p[i:i + m]]}
        scored = []
        for p, a in some.items():
            if p not in covered:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, s[2].decode(), -s[1], s[3], s[4], total[lang], -s[0]) for i, s in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least,top,bucket", [(3, 25, 200), (2, 10_000, 6_000_000), (30, 50, 1_000)])
def test_collocations_against_counting(spark, monkeypatch, least, top, bucket):
    r = random.Random(least)
    vocabulary = ["The", "the", "of", "É", "é", "a\xa0b", "x1", "ΑΒ", "\x1c", "\x85", "l'", "-", "\x00"] + ["w%d" % i for i in range(12)]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]

    def text(n):
        return "".join(w + r.choice([" ", "  ", "\t", " ", " ", ". ", "\n", "\r\n", ",", ";x", "\x0b"]) for w in r.choices(vocabulary, weights, k=n))

    given = [(i, text(r.randint(0, 40)), r.choice(["en", "en", "de", None, "und"])) for i in range(150)]
    given += [(500, None, "en"), (501, "", "xx"), (502, " . ,", "yy"), (503, "same same same same same same " * 40, "en"), (504, text(3_000), "en")]
    given += [(600, "hot lead w1 w2 w3", "de")] * 60 + [(None, "hot lead %s" % w, "de") for w in vocabulary * 3]
    monkeypatch.setattr(collocations, "SLICE_CHARS", 700)
    frame = collocations.collocations(docs(spark, given).repartition(5), least=least, top=top, bucket_chars=bucket)
    assert sorted(map(tuple, frame.collect())) == phrases_by_hand(given, least, top)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs(spark, [])).count() == 0
    assert collocations.collocations(docs(spark, [(1, None, "en"), (2, "once only", None)])).count() == 0


def test_quicksort_partitions_are_counts():
    r = np.random.default_rng(1)
    columns = [r.integers(1, 5, 4_000)]
    for _ in range(3):
        columns.append(np.where(columns[-1] > 0, r.integers(0, 5, 4_000), 0))
    weights = r.integers(1, 4, 4_000)
    want, whole = Counter(), Counter()
    for *row, w in zip(*[c.tolist() for c in columns], weights.tolist()):
        row = [x for x in row if x]
        whole[tuple(row)] += w
        for d in range(1, len(row) + 1):
            want[tuple(row[:d])] += w
    for least, ends_only in ((1, False), (1, True), (25, False)):
        got = collocations.Sorted(columns, weights, least, ends_only)
        named = {tuple(int(c[p]) for c in columns[:d]): n for p, d, n in zip(got.pointer.tolist(), got.words.tolist(), got.weight.tolist())}
        if not ends_only:
            assert named == {k: n for k, n in want.items() if n >= least}
        ends = Counter()
        for p, n in zip(got.ends.tolist(), got.end_weight.tolist()):
            ends[tuple(int(c[p]) for c in columns if c[p])] += n
        assert ends == {k: n for k, n in whole.items() if n >= least}
