"""Decks by content, against brute force."""

import random

import pytest

from deckhouse.operators import content

PARTS = "extra int, path string, part string, content binary, digest string"


def parts(spark, decks):
    rows = [(1, path, part, data, "mine") for path, members in decks for part, data in members]
    random.Random(7).shuffle(rows)
    return spark.createDataFrame(rows, PARTS)


def test_packages_compare_by_members_in_any_order(spark):
    a = [("ppt/slides/slide1.xml", b"one"), ("b", b"two")]
    decks = [("/3", a), ("/1", a[::-1]), ("/2", [("ppt/slides/slide1.xml", b"two"), ("b", b"one")]), ("/4", a + [("c", None)]), ("/5", a + [("c", None)]), ("/6", [(None, None)]), ("/7", a + a), ("/8", [("b", b"")]), (None, a)]
    got = {r.path: (r.digest, r.parts, r.same_as, r.copies) for r in content.duplicates_by_content(content.package_digests(parts(spark, decks))).collect()}
    assert sorted(got) == [f"/{i}" for i in range(1, 9)]
    assert {p: x[2:] for p, x in got.items()} == {"/1": (None, 3), "/3": ("/1", 3), "/7": ("/1", 3), "/2": (None, 1), "/4": (None, 1), "/5": (None, 1), "/6": (None, 1), "/8": (None, 1)}
    assert got["/4"][0] is None and got["/6"][:2] == (None, 0) and got["/1"][0] != got["/2"][0]


@pytest.mark.parametrize("seed", [1, 2])
def test_slides_against_brute_force(spark, seed):
    r = random.Random(seed)
    pool = [b"cover", b"thanks", *(str(i).encode() for i in range(12)), b""]
    decks = {f"/d{i:03}": [b"cover"] * r.randint(0, 1) + r.sample(pool, r.randint(0, 4)) for i in range(120)}
    rows = parts(spark, [(p, [(f"ppt/slides/slide{k}.xml", s) for k, s in enumerate(slides, 1)] + [("ppt/theme/theme1.xml", b"t"), ("ppt/slides/slide99.xml", None)]) for p, slides in decks.items()])
    slides = content.slide_digests(rows)
    sets = {p: frozenset(s) for p, s in decks.items() if s}
    first = {s: min(p for p in sets if s in sets[p]) for s in set().union(*sets.values())}
    want: dict = {}
    for p, s in sets.items():
        for x in s:
            if first[x] != p:
                want[p, first[x]] = want.get((p, first[x]), 0) + 1
    assert {(x.deck, x.origin): x.shared for x in content.slide_origins(slides.union(slides)).collect()} == want
    shared = {x.first: 0 for x in content.shared_slides(slides).collect()}
    assert set(shared) == {first[s] for s in first if sum(s in o for o in sets.values()) > 1}
    larger = {p: {o for o in sets.values() if s < o} for p, s in sets.items()}
    expected = {p: (len(s), sum(o == s for o in sets.values()), len(larger[p]), min((q for q, o in sets.items() if o in larger[p]), default=None)) for p, s in sets.items()}
    assert {x.deck: (x.slides, x.alike, x.containers, x.container) for x in content.contained_decks(slides.union(slides)).collect()} == expected


def test_empty(spark):
    none = spark.createDataFrame([], PARTS)
    slides = content.slide_digests(none)
    assert [df.count() for df in (content.duplicates_by_content(content.package_digests(none)), slides, content.slide_origins(slides), content.shared_slides(slides), content.contained_decks(slides))] == [0] * 5
