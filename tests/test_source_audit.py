"""A library written as files and audited from there, against the audit of the same parts as a table."""

import re

from deckhouse.plans import queries

SF = "/root/testdata/sf0.001"
FROM_FILES = {"path", "bytes", "media_bytes", "duplicate_of", "duplicate_group_size", "error", "readable"}


def test_files_are_audited_as_their_parts(spark):
    want = queries.QUERIES["d36_audit"](spark, SF).collect()
    got = {r.path: r for r in queries.QUERIES["d61_source_audit"](spark, SF).collect()}
    number = lambda path: int(re.search(r"deck(\d+)", path)[1])
    assert {p: number(p) for p in got} == {f"g{number(w.path) % 16}/deck{number(w.path)}.pptx": number(w.path) for w in want}
    columns = [c for c in want[0].asDict() if c not in FROM_FILES]
    for w in want:
        g = got[f"g{number(w.path) % 16}/deck{number(w.path)}.pptx"]
        cut = number(w.path) % 10 == 9
        assert g.readable != cut
        if cut:
            assert (g.slides, g.fonts, g.build_states) == (0, "", 0)
        else:
            assert [g[c] for c in columns] == [w[c] for c in columns]
    assert any(number(w.path) % 10 == 9 for w in want) and any(number(w.path) % 10 == 7 for w in want)
