"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans (email, ip, card, phone), leftmost and not overlapping within a kind, without
retries for a match that fails its check. The field adds spans the patterns miss (a phone without a plus sign, say):
it is trained on the driver from a small labelled table, and tags runs of neighbouring words that hold a digit or
an at sign; every other word is outside by definition, so cutting there changes no decoding. Runs of a batch are
padded to one array per length and decoded together by Viterbi in numpy. An added span never overlaps a base span.

Whole texts are scanned in time linear in their length. Positions count code points, ends are exclusive.
Nulls: a null text counts as empty. Repeated rows and null doc_ids pass row by row. An empty table gives an empty
result; an empty labelled table adds no span. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civiclake.llm.common import text_or_empty
from civiclake.llm.suite import LLM

KINDS = ("email", "ip", "card", "phone")
LABELLED_ROWS = 5_000  # more rows of the labelled table than this are refused, not cut

# The patterns; possessive where that changes no match, so that no input takes quadratic time.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

# The default labelled table: [kind:words] marks a span.
LABELLED = """
Write to [email:anna.berg@mail.example.org] before Friday
mail me at [email:k_lo-pez+news@sub.example.co.uk], please
contact: <[email:info@example.com]> or call [phone:+44 20 7946 0958]
our office [phone:(212) 555-0147] is open from 9 to 5
phone [phone:212-555-0188] or [phone:1-800-555-0199], extension 12
tel. [phone:030 1234 5678] between 8 and 16
call [phone:+1 (415) 555-0132] or send a note
Fax [phone:(0) 20 555 01 99]; room 214
reach her on [phone:555-0123] after 18:00
mobile: [phone:0171 555 0142]
[phone:+33 1 55 50 12 34] is the number of the front desk
[phone:415.555.0110] rings twice
paid with card [card:4111 1111 1111 1111] on 12 May 2021
card number [card:5500-0000-0000-0004] expires 04/27
[card:340000000000009] was charged 25.00
Visa [card:4012888888881881] declined, 3 tries
charged to [card:6011 0000 0000 0004], total 19.99 EUR
credit card [card:4222222222222] kept on file
the server at [ip:192.168.10.24] went down at 03:15
ping [ip:10.0.0.1] and [ip:172.16.254.3] first
requests from [ip:203.0.113.77]: 5021 in one hour
host [ip:198.51.100.9] answers on port 8080
version 2.10.4 was built on 2020-11-30
chapter 3.2.1 covers pages 112-140
the price rose from 1,250 to 1,400 in 2019
about 3 of 10 people, or 30%, agreed
in 1999 there were 12 members; by 2005, 48
order 48213 of 5 items left on 2021-03-04
10 000 people and 25 000 visitors came
the ratio 0.25 to 1.75 held for 60 days
ISBN 978-3-16-148410-0 costs 35.50
at 10:30 the train 4711 left platform 7
see section 12.4 and table 3-1
room 101, floor 2, building 7B
@home and @work are tags, not addresses
follow @public_tag for news in 2022
flight LX1234 lands at 21:45
temperatures of 21.5 and 19.0 degrees
build 20210304.1 replaced build 20210228.7
3x4 and 5x5 grids of 64 cells
items 1 2 3 4 5 6 were drawn
between 1914 and 1918, 4 years
""".strip().splitlines()

LABELS = ["O"] + [f"{part}-{kind}" for kind in KINDS for part in "BI"]
NEVER = -1e9


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed patterns, by kind as listed, then start."""
    out = [("email", *span) for span in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign, with the run of local characters before it that no earlier match has taken."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        else:
            free = max(free, at)
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


WORD = re.compile(r"[^ \t-\r]+")
HINT = re.compile(r"[0-9@]")


def word_runs(text: str) -> list[list[tuple[str, int, str, str]]]:
    """Maximal runs of words that hold a digit or an at sign: (word, start, the word before, the word after)."""
    if not HINT.search(text):
        return []
    runs, last = [], None
    words = [(m[0], m.start()) for m in WORD.finditer(text)]
    for i, (word, start) in enumerate(words):
        if HINT.search(word):
            item = (word, start, words[i - 1][0] if i else "", words[i + 1][0] if i + 1 < len(words) else "")
            if last == i - 1:
                runs[-1].append(item)
            else:
                runs.append([item])
            last = i
    return runs


@lru_cache(maxsize=100_000)
def shape(word: str) -> str:
    """Runs of digits as d and their length (up to 9), of letters as X or x, other characters as they are."""
    if len(word) > 64:
        return f"long{len(HINT.findall(word)) > 8}"
    out = re.sub(r"[0-9]+", lambda m: f"d{min(len(m[0]), 9)}", word)
    out = re.sub(r"(?<!d)[A-Z]+(?![0-9])", "X", out) if out != word else re.sub(r"[A-Z]+", "X", word)
    return re.sub(r"[^\W\d_dX]{1,}", "x", out)


def features(word: str, before: str, after: str) -> list[str]:
    digits = sum(c.isdigit() for c in word)
    own = shape(word)
    coarse = re.sub(r"d[0-9]", "d", own)
    return [
        "bias", f"s={own}", f"c={coarse}", f"b={shape(before)}", f"a={shape(after)}", f"n={min(digits, 16)}",
        f"dots={min(word.count('.'), 4)}", f"dash={min(word.count('-'), 4)}", f"w={before.lower().strip('.,:;()')}" if not HINT.search(before) else "w=#",
        f"at={'@' in word[1:-1]}", f"plus={word[:1] == '+'}", f"paren={word[:1] == '('}",
    ]


def marked_rows(lines: list[str]) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Marked lines as (text, spans)."""
    out = []
    for line in lines:
        text, spans, at = "", [], 0
        for m in re.finditer(r"\[(\w+):([^\]]*)\]", line):
            text += line[at:m.start()]
            spans.append((m[1], len(text), len(text) + len(m[2])))
            text += m[2]
            at = m.end()
        out.append((text + line[at:], spans))
    return out


def labelled_table(spark: SparkSession, lines: list[str] = LABELLED) -> DataFrame:
    """The default labelled table: text, spans."""
    return spark.createDataFrame(marked_rows(lines), "text string, spans array<struct<kind:string,start:int,end:int>>")


class Field:
    """The trained field: weights of features by label, of neighbouring labels, and of first and last ones."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray, first: np.ndarray):
        self.names, self.emit, self.move, self.first = names, emit, move, first

    def scores(self, runs: list[list[tuple]]) -> np.ndarray:
        """Label scores of each word of runs of one length: (run, word, label)."""
        known = [[self.names[f] for f in features(w, b, a) if f in self.names] for run in runs for w, _, b, a in run]
        rows = np.repeat(np.arange(len(known)), [len(k) for k in known])
        flat = np.zeros((len(known), len(LABELS)))
        np.add.at(flat, rows, self.emit[[i for k in known for i in k]])
        return flat.reshape(len(runs), -1, len(LABELS))

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """The best label sequence of each run of one length."""
        best, back = scores[:, 0] + self.first, []
        for t in range(1, scores.shape[1]):
            paths = best[:, :, None] + self.move
            back.append(paths.argmax(1))
            best = paths.max(1) + scores[:, t]
        path = [best.argmax(1)]
        for step in reversed(back):
            path.append(step[np.arange(len(step)), path[-1]])
        return np.stack(path[::-1], axis=1)

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """What the field marks in each text."""
        out = [[] for _ in texts]
        by_length: dict[int, list] = {}
        for i, text in enumerate(texts):
            for run in word_runs(text):
                by_length.setdefault(len(run), []).append((i, run))
        for length, found in by_length.items():
            step = max(1, 50_000 // length)
            for k in range(0, len(found), step):
                part = found[k:k + step]
                for (i, run), labels in zip(part, self.viterbi(self.scores([r for _, r in part]))):
                    out[i] += _joined(run, labels.tolist())
        return [sorted(x, key=lambda s: s[1]) for x in out]


def _joined(run: list[tuple], labels: list[int]) -> Iterator[tuple[str, int, int]]:
    """Neighbouring words of one span, without the punctuation around them."""
    t = 0
    while t < len(run):
        label = LABELS[labels[t]]
        end = t + 1
        if label != "O":
            kind = label[2:]
            while end < len(run) and LABELS[labels[end]] == f"I-{kind}":
                end += 1
            start, stop = run[t][1], run[end - 1][1] + len(run[end - 1][0])
            head, tail = run[t][0], run[end - 1][0]
            start += len(head) - len(head.lstrip("<>[]{}\"',;:" + ("" if kind == "phone" else "()")))
            stop -= len(tail) - len(tail.rstrip("<>[](){}\"'.,;:!?"))
            if stop > start:
                yield kind, start, stop
        t = end


def allowed() -> np.ndarray:
    """Zero where a label may follow another, else a score that never wins."""
    move = np.zeros((len(LABELS), len(LABELS)))
    for j, label in enumerate(LABELS):
        if label[0] == "I":
            move[:, j] = NEVER
            move[[LABELS.index(f"B-{label[2:]}"), j], j] = 0
    return move


def train(rows: list[tuple[str, list[tuple[str, int, int]]]], steps: int = 150, rate: float = 0.2, decay: float = 0.01) -> Field | None:
    """Maximum likelihood with weight decay, by Adam, over all runs of the labelled rows."""
    runs, tags = [], []
    for text, spans in rows:
        for run in word_runs(text or ""):
            tag = []
            for word, start, *_ in run:
                label = "O"
                for kind, a, b in spans or []:
                    if kind in KINDS and start < b and a < start + len(word):
                        label = ("B-" if a >= start or not tag or tag[-1][2:] != kind else "I-") + kind
                tag.append(label)
            runs.append(run)
            tags.append([LABELS.index(x) for x in tag])
    if not runs:
        return None
    names: dict[str, int] = {}
    known = [[[names.setdefault(f, len(names)) for f in features(w, b, a)] for w, _, b, a in run] for run in runs]
    longest, n = max(map(len, runs)), len(runs)
    x = np.zeros((n, longest, len(names)))
    y = np.zeros((n, longest), np.int64)
    inside = np.zeros((n, longest), bool)
    for i, (run, tag) in enumerate(zip(known, tags)):
        for t, ids in enumerate(run):
            x[i, t, ids] = 1
        y[i, :len(tag)], inside[i, :len(tag)] = tag, True
    k, mask = len(LABELS), allowed()
    first_mask = np.array([NEVER if label[0] == "I" else 0.0 for label in LABELS])
    weights = [np.zeros((len(names), k)), np.zeros((k, k)), np.zeros(k)]
    moments = [[np.zeros_like(w) for w in weights] for _ in range(2)]
    gold = np.eye(k)[y] * inside[:, :, None]
    for step in range(1, steps + 1):
        emit, move, first = weights
        score = x @ emit
        grads = _gradient(score, move + mask, first + first_mask, gold, y, inside)
        grads[0] = np.tensordot(x, grads[0], ([0, 1], [0, 1]))
        for j, (w, g) in enumerate(zip(weights, grads)):
            g = g - decay * w
            moments[0][j] = 0.9 * moments[0][j] + 0.1 * g
            moments[1][j] = 0.99 * moments[1][j] + 0.01 * g * g
            w += rate * (moments[0][j] / (1 - 0.9**step)) / (np.sqrt(moments[1][j] / (1 - 0.99**step)) + 1e-8)
    return Field(names, weights[0], weights[1] + mask, weights[2] + first_mask)


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def _gradient(score, move, first, gold, y, inside) -> list[np.ndarray]:
    """Observed minus expected counts: (per word and label, moves, first labels); the forward-backward pass."""
    n, length, k = score.shape
    forward, backward = np.zeros((n, length, k)), np.zeros((n, length, k))
    forward[:, 0] = first + score[:, 0]
    for t in range(1, length):
        new = _sum_exp(forward[:, t - 1, :, None] + move, 1) + score[:, t]
        forward[:, t] = np.where(inside[:, t, None], new, forward[:, t - 1])
    for t in range(length - 2, -1, -1):
        new = _sum_exp(move[None] + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where(inside[:, t + 1, None], new, 0)
    total = _sum_exp(forward[:, -1], 1)
    words = np.exp(forward + backward - total[:, None, None]) * inside[:, :, None]
    moves = np.zeros((k, k))
    for t in range(1, length):
        pair = np.exp(forward[:, t - 1, :, None] + move + (score[:, t] + backward[:, t])[:, None, :] - total[:, None, None])
        moves -= (pair * inside[:, t, None, None]).sum(0)
        np.add.at(moves, (y[:, t - 1][inside[:, t]], y[:, t][inside[:, t]]), 1)
    return [gold - words, moves, (gold[:, 0] - words[:, 0]).sum(0)]



def find_pii(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id, ``base`` and ``added``: arrays of (kind, start, end)."""
    rows = [(r["text"], [tuple(s) for s in r["spans"] or []]) for r in labelled.select("text", "spans").limit(LABELLED_ROWS + 1).collect()]
    if len(rows) > LABELLED_ROWS:
        raise ValueError(f"the labelled table holds more than {LABELLED_ROWS} rows")
    field = train(rows)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part["text"].tolist()
            base = [base_spans(x) for x in texts]
            added = [[] for _ in texts]
            if field is not None:
                for i, spans in enumerate(field.spans(texts)):
                    added[i] = [s for s in spans if not any(s[1] < b[2] and b[1] < s[2] for b in base[i])]
            yield pd.DataFrame({"doc_id": part["doc_id"], "base": base, "added": added})

    span = "array<struct<kind:string,start:int,end:int>>"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    return texts.mapInPandas(run, f"doc_id long, base {span}, added {span}")


@LLM.query("op2_pii")
def op2_pii(t) -> DataFrame:
    found = find_pii(t.documents, labelled_table(t.spark))
    order = F.expr("array('email', 'ip', 'card', 'phone')")

    def line(spans):
        listed = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(listed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(line(F.col("base")), 256).alias("base_sha256"),
        line(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
