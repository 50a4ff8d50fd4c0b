"""Spelling variants against brute force."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deckhouse.llm import spelling

from .cases import LONG, ROWS, docs


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_words(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    best, met = {}, {}
    for w, n in counts.items():
        found = sorted((-m, v) for v, m in counts.items() if near(w, v))
        met[w] = len(found)
        if found and -found[0][0] >= 5 * n:
            best[w] = found[0][1]
    out = set()
    for w, n in counts.items():
        root = w
        while root in best:
            root = best[root]
        form = best.get(w)
        out.add((w, n, met[w], form, counts[form] if form else None, root))
    return out


def test_variants_match_brute_force(spark):
    rng = random.Random(4)
    letters = "abcdeéÿ"
    counts = {}
    for _ in range(60):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 9)))
        for _ in range(6):
            counts.setdefault(w, rng.choice([1, 5, 5, 30, 150, 150, 4000]))
            at = rng.randrange(len(w) + 1)
            w = rng.choice([w[:at] + rng.choice(letters) + w[at:], w[:at] + w[at + 1 :] or "a", w[:at] + rng.choice(letters) + w[at + 1 :]])
    long = "".join(rng.choice(letters) for _ in range(20_000))
    counts |= {long: 50, long[:777] + long[778:]: 2, "": 3}
    want = brute_variants({w: n for w, n in counts.items() if len(w) < 100})
    want |= {(long, 50, 1, None, None, long), (long[:777] + long[778:], 2, 1, long, 50, long)}
    rows = [*counts.items(), (None, 3), ("nothing", None)]
    got = spelling.variants(spark.createDataFrame(rows, "word string, n long"))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_query_matches_brute_force_on_a_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = {(w, form, root, n, met, form_n) for w, n, met, form, form_n, root in brute_variants(brute_words(rows))}
    got = spelling.op13_spelling_variants(spark, sf_dir)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in got.collect()]
    assert set(got) == want and len(got) == len(want) and any(r[1] for r in got)


def test_words_of_any_rows(spark):
    rows = [(*r[:2], "") for r in ROWS] + [(20, "Straßen×÷ÀÿŒuvre " * 5, ""), (21, "abcdefg " * 5 + LONG, "")]
    assert {tuple(r) for r in spelling.words(docs(spark, rows)).collect()} == set(brute_words([r[:2] for r in rows]).items())
    assert spelling.words(docs(spark, [])).count() == 0 and spelling.variants(spelling.words(docs(spark, []))).count() == 0


@given(st.lists(st.text(alphabet="abé", min_size=0, max_size=12), min_size=1, max_size=6))
@settings(deadline=None)
def test_keys_tell_what_is_left(texts):
    keys, ids, places = spelling.key_rows(np.arange(len(texts)), texts)
    left = {}
    for key, i, place in zip(keys.tolist(), ids.tolist(), places.tolist(), strict=True):
        w = texts[i]
        what = (place, w[:place] + w[place + 1 :]) if place >= 0 else (-1, w if place == -1 else w[: -2 - place] + w[-1 - place :])
        assert left.setdefault(key, what) == what
    assert len(set(left.values())) == len(left)
    assert len(keys) == sum(1 + len(w) + sum(i == 0 or w[i] != w[i - 1] for i in range(len(w))) for w in texts)


@pytest.mark.parametrize("place", [0, 3])
def test_colliding_keys_are_told_apart(place):
    rows = [(1, place, "abcdef", 9), (2, place, "abcdef"[:place] + "x" + "abcdef"[place + 1 :], 50), (3, place, "zzzzzz", 70), (4, -1, "qqqqqq", 2), (5, -2, "aabcdef", 8)]
    assert list(spelling.meetings(rows)) == [(1, 1, 50, rows[1][2]), (2, 1, 9, "abcdef")]
