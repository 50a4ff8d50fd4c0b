"""Chat formatting, licences, audio, packing, toxicity, language model: against brute force and round trips."""

import hashlib
import math
import os
import random
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deckhouse.llm import audio, chat, hpylm, licenses, packing, toxicity

from .cases import CLASHING, LONG, ROWS, docs
from .seating import Seating

# ---------------------------------------------------------------- chat


def render(source, **scope):
    return "".join(t or "" for t, _ in chat.compile_template(source)(scope))


def test_template_language():
    assert render("{# c #}a{{ 1 + 2 }}b") == "a3b"
    assert render("{% for x in xs %}{{ loop.index }}{{ x.n }}{% if not loop.last %},{% endif %}{% else %}none{% endfor %}", xs=[{"n": "p"}, {"n": "q"}]) == "1p,2q"
    assert render("{% for x in xs %}{{ x }}{% else %}none{% endfor %}", xs=[]) == "none"
    assert render("{% if a == 'x' and not b %}1{% elif c in 'xyz' %}2{% else %}3{% endif %}", a="x", b=True, c="z") == "2"
    assert render("a {%- set y = x|upper -%} b{{ y ~ 1 }}", x="q") == "abQ1"
    assert render("{{ 'yes' if n > 2 else 'no' }}{{ d['k'][0] }}{{ missing }}", n=3, d={"k": "vw"}) == "yesv"


def test_template_is_folded_and_closed():
    assert chat.fold(chat.parse("a{{ 'b' ~ 1 }}{% if 1 == 1 %}c{% else %}{{ x }}{% endif %}d")) == ("block", [("text", "ab1cd")])
    assert render("{{ x.__class__ }}{{ x.real }}", x=1) == ""  # no attributes of objects
    for bad in ("{{ f() }}", "{% import os %}", "{{ x|eval }}", "{% for x in y %}", "{{ 1 ? 2 }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


@given(st.text(alphabet="\\<>/turnoc\n aé", max_size=30))
@settings(deadline=None)
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape_line(text)) == text and chat.unescape(chat.escape(text)) == text
    assert "</turn>" not in chat.escape(text) and "\n" not in chat.escape_line(text)


TALK = [(1, 0, "user", "hi </turn>\nthere"), (1, 1, "assistant", "\\c <turn> ok<"), (1, 2, "assistant", None), (2, None, None, "x"), (2, 0, "assistant", ""), (None, 1, "assistant", "lost"), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, 0, "assistant", LONG)]


@pytest.mark.parametrize("part_chars", [4 << 20, 40])
def test_formatted_turns_read_back(spark, part_chars):

    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("part", "spans", "last")})
    formatted = chat.format_conversations(df, part_chars=part_chars)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for key, r in got.items():
        turns = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in TALK if c == key))
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode()).hexdigest()
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = formatted.where("conv_id = 1").orderBy("part").collect()
    assert sum(len(r.text) for r in whole) == got[1].formatted_chars and [r.last for r in whole] == [False] * (len(whole) - 1) + [True]
    assert sum(len(r.spans) for r in whole) == 2
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


# ---------------------------------------------------------------- licences


def test_license_scan(spark):
    known = spark.createDataFrame([("B", "Some Licence\n(c) 2001 X\ntext"), ("A", "some license; TEXT"), ("E", ""), (None, "q")], "license_id string, text string")
    rows = [(1, "Copyright (c) 2020 Me\nSome license -- text!"), (2, "some license texts"), (3, None), (4, ""), (5, "copyright notice"), (None, "some LICENCE text"), (6, "All rights reserved.\nSOME\n\n  licence\ntext"), (6, "All rights reserved.\nSOME\n\n  licence\ntext")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, digest string, license_id string")
    got = licenses.scan(df, known).collect()
    assert sorted((r.doc_id or 0, r.license_id) for r in got if r.license_id) == [(0, "A"), (1, "A"), (6, "A"), (6, "A")]
    assert {r.doc_id: r.canonical_chars for r in got}[5] == len("copyright notice") and len(got) == len(rows)
    assert licenses.scan(df.limit(0), known).count() == 0 and licenses.scan(df, known.limit(0)).where("license_id is not null").count() == 0


def test_known_licenses_are_distinct(spark):
    known = spark.createDataFrame(list(licenses.LICENSES.items()), "license_id string, text string")
    assert licenses.known_digests(known).count() == len(licenses.LICENSES)
    rewrapped = [(1, " ".join(licenses.LICENSES["BSD-3-Clause"].split()).upper())]
    assert licenses.scan(spark.createDataFrame(rewrapped, "doc_id long, text string"), known).first().license_id == "BSD-3-Clause"


def test_planted_licenses_match_the_sql(spark):
    """Every known licence, rewrapped, re-cased, with other copyright lines and British spelling, among texts that only quote them."""
    rows = []
    for i, (name, text) in enumerate(licenses.LICENSES.items()):
        changed = [text, " ".join(text.split()).upper(), "Copyright (c) 2019 Some One\nAll rights reserved.\n\n" + text.replace("license", "licence").replace(". ", " ; "), f"* {text}\n\n(c) 2001 X"]
        rows += [(10 * i + j, t, name) for j, t in enumerate(changed)] + [(10 * i + 7, "See below. " + text, None), (10 * i + 8, text[:-30], None)]
    rows += [(5000, None, None), (5001, "", None), (5002, " ".join(["licence"] * 400_000), None)]
    docs_ = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs_, spark.createDataFrame(list(licenses.LICENSES.items()), "license_id string, text string")).collect()}
    assert {i: got[i].license_id for i, _, _ in rows} == {i: name for i, _, name in rows}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r[:2] for r in rows], columns=["doc_id", "text"]))
    want = con.sql(licenses.OP3_SQL).fetchall()
    assert sorted(want, key=str) == sorted(((r.doc_id, r.canonical_chars, r.digest, r.license_id) for r in got.values()), key=str)


PUBLISHED = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(PUBLISHED), reason="no published texts on this machine")
def test_long_licenses_are_known_by_digest(spark):
    """The published texts, rewrapped and re-cased, whole and without what follows their terms; a changed word makes another text."""
    files = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}
    rows = []
    for i, (name, file) in enumerate(files.items()):
        with open(f"{PUBLISHED}/{file}") as f:
            text = f.read()
        end = text.find("END OF TERMS AND CONDITIONS")
        for j, t in enumerate([text, text.upper(), "\n".join(line.strip() for line in text.splitlines()).replace("license", "licence"), *([text[:end]] if end > 0 else [])]):
            rows.append((10 * i + j, t, name))
        rows.append((10 * i + 8, text.replace("Program", "Recipe").replace("Work", "Recipe").replace("Covered Software", "Recipe").replace("Library", "Recipe"), None))
        rows.append((10 * i + 9, text[: len(text) // 2], None))
    known = licenses.catalogue(spark)
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), known.texts, digests=known.digests).collect()}
    assert got == {i: name for i, _, name in rows}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r[:2] for r in rows], columns=["doc_id", "text"]))
    assert {r[0]: r[3] for r in con.sql(licenses.OP3_SQL).fetchall()} == got


# ---------------------------------------------------------------- audio


def ima_reference(data: bytes) -> list[int]:
    """One block, one nibble at a time."""
    value, index = int.from_bytes(data[:2], "little", signed=True), min(data[2], 88)
    out = [value]
    for byte in data[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = audio.IMA_STEPS[index]
            diff = step >> 3
            for bit, shift in ((4, 0), (2, 1), (1, 2)):
                if nibble & bit:
                    diff += step >> shift
            value = max(-32768, min(32767, value - diff if nibble & 8 else value + diff))
            index = max(0, min(88, index + audio.IMA_INDEX[nibble & 7]))
            out.append(value)
    return out


def test_codecs():
    mu, a = audio.mulaw_table(), audio.alaw_table()
    assert (mu[0], mu[0x7F], mu[0x80], mu[0xFF]) == (-32124, 0, 32124, 0)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256
    blocks = np.random.default_rng(3).integers(0, 256, (20, 68), np.uint8)
    assert audio.decode_ima(blocks).tolist() == [ima_reference(b.tobytes()) for b in blocks]


def test_resampling():
    tone = (12000 * np.sin(np.arange(4000) * 0.2)).astype(np.int16)
    up = audio.resample(tone, 8000, 16000)
    assert len(up) == 8000 and np.abs(up[::2][8:-8].astype(int) - tone[8:-8]).max() <= 2
    assert np.abs(up[17:-17:2] - 12000 * np.sin((np.arange(8.5, 3991.5)) * 0.2)).max() < 120
    assert len(audio.resample(tone, 11025, 16000)) == 4000 * 16000 // 11025 and len(audio.resample(tone[:0], 8000, 16000)) == 0
    assert audio.resample(tone, 8000, 8000).tolist() == tone.tolist()


def carried(df):
    in_steps = audio.store_pcm(audio.carry_texts(df))
    whole = audio.carried_and_stored(df)
    assert whole.columns == in_steps.columns and Counter(map(str, whole.collect())) == Counter(map(str, in_steps.collect()))
    return audio.described(whole)


def test_carried_texts(spark):
    got = carried(docs(spark)).collect()
    assert len(got) == len(ROWS)
    for r, (key, text, _) in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.payload_sha256)), sorted(ROWS, key=lambda x: (x[0] or 0, payload_digest(x[1]))), strict=True):
        assert (r.doc_id, r.n_bytes, r.payload_sha256) == (key, len((text or "").encode()), payload_digest(text))
        assert r.payload_bytes % 64 == 0 and r.payload_bytes >= max(64, r.n_bytes) and r.media_bytes > r.payload_bytes
        payload = (text or "").encode() + b"\0" * (r.payload_bytes - r.n_bytes)
        file = audio.carry(payload)
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest())
    same = {r.payload_sha256: r for r in got}
    assert all((same[r.payload_sha256].feature, same[r.payload_sha256].media_sha256) == (r.feature, r.media_sha256) for r in got)
    assert carried(docs(spark, [])).count() == 0


def test_carried_texts_have_stored_pcm(spark):
    for r in carried(docs(spark)).collect():
        codec, rate, _, data = audio.read_wave(bytes(r.pcm))
        assert (codec, rate) == (audio.PCM, audio.TARGET_RATE)
        assert f"pcm={len(data) // 2}@{rate} pcm_crc32={zlib.crc32(data)}" in r.feature


def payload_digest(text):
    raw = (text or "").encode()
    return hashlib.sha256(raw + b"\0" * (64 if not raw else -len(raw) % 64)).hexdigest()


def plain_resample(samples, rate, target):
    """One output sample at a time, each from its eight neighbours."""
    up, down = target // math.gcd(rate, target), rate // math.gcd(rate, target)
    taps, out = audio._taps(up, down), []
    for j in range(len(samples) * up // down):
        at, phase = divmod(j * down, up)
        near = [samples[i] if 0 <= i < len(samples) else 0 for i in range(at - 3, at + 5)]
        out.append(max(-32768, min(32767, (sum(int(x) * int(t) for x, t in zip(near, taps[phase], strict=True)) + (1 << 13)) >> 14)))
    return out


@pytest.mark.parametrize("rate, target", [(8000, 16000), (11025, 16000), (16000, 8000), (8000, 11025)])
def test_resampling_matches_one_sample_at_a_time(rate, target):
    samples = np.random.default_rng(1).integers(-32768, 32768, 333).astype(np.int16)
    assert audio.resample(samples, rate, target).tolist() == plain_resample(samples, rate, target)


def test_stored_pcm(spark):
    files = [(i, audio.write_wave(c, bytes(range(68)) * 4)) for i, c in enumerate((audio.MULAW, audio.ALAW, audio.IMA_ADPCM, audio.PCM))]
    rows = [*files, (8, b"no wave"), (9, None), (None, b"")]
    df = spark.createDataFrame([(*r, "x", -1) for r in rows], "id long, media binary, codec string, extra int")  # a column of an added name goes
    got = {r.id: r for r in audio.store_pcm(df).collect()}
    assert all(r.extra == -1 for r in got.values()) and audio.store_pcm(df.limit(0)).count() == 0
    assert [bytes(got[i].payload)[:68] for i in (0, 1, 3)] == [bytes(range(68))] * 3 and got[2].payload == b"".join(bytes(range(4, 68)) for _ in range(4))
    assert [got[i].codec for i in range(4)] == ["mulaw", "alaw", "ima_adpcm", "pcm"] and [got[i].n_samples for i in range(4)] == [272, 272, 4 * 129, 136]
    codec, rate, _, data = audio.read_wave(bytes(got[0].pcm))
    assert (codec, rate, len(data)) == (audio.PCM, 16000, 2 * 2 * 272)
    assert got[8].error and got[9].error and got[None].error and got[8].pcm is None


# ---------------------------------------------------------------- packing


def test_pieces_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary())
    got = packing.tokenize(docs(spark), with_ids=True).collect()
    by_text = Counter()
    for key, text, _ in ROWS:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        by_text.update((key, i, i * 4096, tuple(ids[i * 4096 : (i + 1) * 4096])) for i in range(-(-len(ids) // 4096)))
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in got) == by_text
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in got)


ODD = ["don't stop", "e\u0301a\u0301 Ab\u0301c", "ΣΑΣ Σ", "İstanbul", "ﬁne ½ x² 12ab", "tab\tline\nfeed\rreturn\x1cfs\u2003em", "&&&. ### a###, (b)", "<|endoftext|> <|startoftext|>x", "<|ENDOFTEXT|>. A", "a.,b ,c. d.e 3.5,6 _. ._ x.\u0301 A\u0301. end.", "word. word, word; (word). \"Word.\"", "한글 ᄒ", "", " ", "x" * 5000]


def test_chunks_encode_as_whole_texts():
    e = packing.ChunkEncoder(packing.vocabulary())
    want = [np.array(e.encoder.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in ODD]
    assert e.encode(ODD) == want and e.encode(ODD) == want


@given(st.one_of(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=("Cs",)), max_size=40), st.text(alphabet="aB.,;' \n\t_1éÉ\u0301<|#Σß", max_size=40)))
@settings(max_examples=800, deadline=None)
def test_any_text_encodes_as_whole(text):
    e = packing.encoder_for(packing.vocabulary())
    assert e.encode([text])[0] == np.array(e.encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def whole_ids(encoder, text):
    return np.array(encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_signs_that_normalising_changes_before_punctuation():
    """Every sign with a canonical decomposition, of two cases or that combines, beside all ASCII punctuation."""
    e = packing.ChunkEncoder(packing.vocabulary())
    signs = [c for i in range(0x110000) if not 0xD800 <= i < 0xE000 for c in [chr(i)] if (d := unicodedata.decomposition(c)) and d[0] != "<" or c.lower() != c or unicodedata.category(c)[0] == "M"]
    assert len(signs) > 5000
    for c in signs:
        text = " ".join(f"a{c}{p}b {c}{p} {c}a{p} J{c}{p}{p}" for p in packing._PUNCTUATION)
        assert e.encode([text])[0] == whole_ids(e.encoder, text), hex(ord(c))


def test_random_texts_of_changing_signs():
    e, rng = packing.ChunkEncoder(packing.vocabulary()), random.Random(1)
    alphabet = [*"aBİıΣσßJ .,;'\n_-1éÉ<|#\u0301\u030c\u0307\u0345\x85\xa0\x1c", *map(chr, [*range(0x9DC, 0x9E0), *range(0x958, 0x960), *range(0xFB1D, 0xFB4F)])]
    for _ in range(100_000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(1, 14)))
        assert e.encode([text])[0] == whole_ids(e.encoder, text), text


def test_best_fit():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 101, 4000).tolist()
    for bins in (1, 7, 500):
        packer = packing.BestFit(100, bins)
        places = [packer.place(n) for n in lengths]
        ends: dict[int, int] = {}
        for (number, offset), n in zip(places, lengths, strict=True):
            assert ends.get(number, 0) == offset and offset + n <= 100
            ends[number] = offset + n
    assert packer.opened <= 1.05 * sum(lengths) / 100 + 2
    small = packing.BestFit(10, 2)
    assert [small.place(n) for n in (6, 7, 5, 3, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6), (2, 5)]  # bin 1, the fullest, closed for bin 2


def test_packed(spark):
    got = packing.pack(packing.tokenize(docs(spark))).collect()
    again = packing.pack(packing.tokenize(docs(spark))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    by_sequence: dict[int, list] = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by_sequence) <= sum(r.length for r in got) // 4096 + 2
    assert packing.pack(packing.tokenize(docs(spark, []))).count() == 0


# ---------------------------------------------------------------- toxicity


def test_ordinal_fit_orders_and_generalises():
    rng = np.random.default_rng(2)
    bad, plain = [10, 11, 12], list(range(100, 160))
    rows, grades = [], []
    for i in range(900):
        g = int(rng.integers(0, 4)) if i % 3 == 0 else 0
        rows.append(sorted({*rng.choice(plain, 8), *bad[:g]}))
        grades.append(g)
    indptr = np.cumsum([0, *map(len, rows)])
    model = toxicity.fit(indptr, np.concatenate(rows).astype(np.uint32), np.array(grades))
    assert set(model.weights) <= set(bad) | set(plain) and set(bad) <= set(model.weights)
    assert model.thresholds == sorted(model.thresholds)
    severity = [sum(model.above(sum(model.weights.get(k, 0.0) for k in bad[:g]))) for g in range(4)]
    assert severity == sorted(severity) and severity[0] < 0.3 and severity[3] > 2.4


def test_fit_matches_brute_force():
    """Small proximal steps on dense features, for a very long time, reach the same weights, thresholds and probabilities."""
    rng = np.random.default_rng(6)
    x = (rng.random((300, 5)) < [0.5, 0.4, 0.3, 0.5, 0.2]).astype(float)
    grades = np.clip(np.round(x @ [1.5, 1.0, -0.5, 0.0, 1.2] + rng.logistic(0, 0.6, 300) - 0.4), 0, 2).astype(int)
    rows = [np.flatnonzero(r) + 10 for r in x]
    model = toxicity.fit(np.cumsum([0, *map(len, rows)]), np.concatenate(rows).astype(np.uint32), grades, l1=1e-3, rounds=20_000)
    w, b = np.zeros(5), np.array([0.0, 1.0])
    above = grades[:, None] > np.arange(2)
    for _ in range(60_000):
        error = (1 / (1 + np.exp(b - (x @ w)[:, None])) - above) / 300
        w = w - 0.3 * x.T @ error.sum(1)
        w = np.sign(w) * np.maximum(np.abs(w) - 0.3 * 1e-3, 0)
        b = np.maximum.accumulate(b + 0.3 * error.sum(0))
    got = np.array([model.weights.get(k, 0.0) for k in range(10, 15)])
    assert np.abs(got - w).max() < 0.01 and np.abs(np.array(model.thresholds) - b).max() < 0.01
    for r in x[:40]:
        logit = r @ w
        assert np.abs(np.array(model.above(float(r @ got))) - 1 / (1 + np.exp(b - logit))).max() < 0.01


def test_grades_and_telling_features(spark):
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (3, 1, 0), (4, 1, None), (2, 0, 1), (None, 1, 1), (6, None, 1)], "doc_id long, toxic int, quality int")
    assert {r.doc_id: r.grade for r in toxicity.graded(labels).collect()} == {1: 0, 2: 1, 3: 2, 4: 2}
    assert {r.doc_id: r.grade for r in toxicity.graded(labels.withColumn("grade", F.col("doc_id") * 2)).collect()} == {1: 2, 2: 4, 3: 6, 4: 8, 6: 12}
    rows = [(i % 4 == 0, " ".join(["bad"] * (i % 4 == 0 and i % 8 == 0) + [f"word{i % 7}", f"only{i}"])) for i in range(200)]
    df = spark.createDataFrame([(int(g), t) for g, t in rows], "grade int, text string")
    count, dirty = Counter(), Counter()
    for g, t in rows:
        for k in {k for w in t.split() for k in toxicity.features_of(w)}:
            count[k] += 1
            dirty[k] += g

    def statistic(k):
        cells = [(dirty[k], count[k] * 0.25), (count[k] - dirty[k], count[k] * 0.75), (50 - dirty[k], (200 - count[k]) * 0.25), (150 - count[k] + dirty[k], (200 - count[k]) * 0.75)]
        return 2 * sum(n * math.log(n / e) for n, e in cells if n)

    want = {k for k in count if count[k] >= toxicity.LEAST_TEXTS and statistic(k) >= toxicity.LEAST_G}
    assert set(toxicity.telling_features(df).tolist()) == want and len(want) >= 1
    assert len(toxicity.telling_features(df.limit(0))) == 0


def test_held_out_labels_of_the_tables(spark):
    """A fifth of the labels, fixed by hash, is never fitted on."""
    sf_dir = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = toxicity.train(documents, labels.where(~held))
    got = toxicity.score(documents.join(labels.where(held).select("doc_id"), "doc_id"), model).join(toxicity.graded(labels).withColumnRenamed("doc_id", "id"), F.col("doc_id") == F.col("id")).collect()
    bad, clean = [r for r in got if r.grade > 0], [r for r in got if r.grade == 0]
    found, alarms = sum(r.toxic for r in bad), sum(r.toxic for r in clean)
    print(f"held out: {found} of {len(bad)} found, {alarms} of {len(clean)} clean ones flagged; mean severity {sum(r.severity for r in bad) / len(bad):.3f} against {sum(r.severity for r in clean) / len(clean):.3f}")
    assert found >= 0.8 * len(bad) and alarms <= 0.02 * len(clean)


def test_toxic_texts_are_found(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"{a}{b}" for a in ("re", "in", "tor", "al") for b in ("na", "bel", "sun", "kir", "mo")]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        words = [*rng.choice(vocabulary, 20), *(rng.choice(["scumo", "scumel", "idiot"], 3) if toxic else [])]
        rows.append((i, " ".join(rng.permutation(words)), "s"))
        labels.append((i, int(toxic)))
    df, marks = docs(spark, rows + [(900, None, "s"), (901, "", "s"), (None, "idiot idiot scumnew", "s"), (902, LONG, "s")]), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(df.where("doc_id < 300"), marks)
    got = toxicity.score(df, model).collect()
    assert len(got) == 404 and all(r.toxic == (r.doc_id % 5 == 0) for r in got if r.doc_id is not None and r.doc_id < 400)
    assert {r.doc_id: r.toxic for r in got if r.doc_id is None or r.doc_id >= 900} == {900: False, 901: False, None: True, 902: False}
    assert next(r for r in got if r.doc_id == 0).severity > next(r for r in got if r.doc_id == 1).severity
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == sum(not r.toxic for r in got)
    nothing = toxicity.train(df.limit(0), marks)
    assert not any(r.toxic for r in toxicity.score(df, nothing).collect()) and toxicity.score(df.limit(0), model).count() == 0


# ---------------------------------------------------------------- language model


def test_gibbs_reaches_the_exact_posterior():
    d, weight, n, customers = 0.5, 0.8, 20_000, 4
    partitions = {(4,): 1, (3, 1): 4, (2, 2): 3, (2, 1, 1): 6, (1, 1, 1, 1): 1}  # sizes of tables and ways to seat
    mass = {p: ways * math.prod(weight * math.prod(j - d for j in range(1, s)) for s in p) for p, ways in partitions.items()}
    seating, rng = Seating(np.full(n, customers)), np.random.default_rng(1)
    for _ in range(80):
        seating.reseat(np.arange(n), np.full(n, weight), d, rng)
    at = seating.starts()
    seen = Counter(tuple(sorted(seating.sizes[at[i] : at[i] + seating.tables[i]].tolist(), reverse=True)) for i in range(n))
    for p, m in mass.items():
        assert abs(seen[p] / n - m / sum(mass.values())) < 0.015


@pytest.mark.parametrize("discount", [0.2, 0.75])
def test_table_counts_of_one_draw(discount):
    """All customers of a pair are seated anew: exact by the Stirling numbers, whatever number of customers."""
    ways, rng = hpylm._stirling(discount), np.random.default_rng(3)
    for customers in (30, 1024):
        t = np.unique(np.linspace(1, customers, 40).astype(int))
        got = hpylm.log_ways(np.full(len(t), customers), t, discount) + math.lgamma(customers)
        assert np.abs(got - ways[customers, t]).max() < 1e-4
    for customers, weight in ((2, 0.4), (40, 3.0), (1000, 0.3), (1000, 60.0), (1000, 4000.0)):
        log_p = ways[customers, 1 : customers + 1] + np.log(weight) * np.arange(1, customers + 1)
        p = np.exp(log_p - log_p.max())
        mean = p @ np.arange(1, customers + 1) / p.sum()
        deviation = np.sqrt(p @ (np.arange(1, customers + 1) - mean) ** 2 / p.sum())
        for draw in (hpylm.draw_tables, hpylm._many_tables) if customers > 100 else (hpylm.draw_tables,):
            seen = draw(np.full(2000, customers), np.full(2000, weight), discount, rng)
            assert abs(seen.mean() - mean) < 5 * deviation / 2000**0.5 + 1e-9 and (seen >= 1).all() and (seen <= customers).all()


def test_frequent_pairs_get_their_tables():
    """One sweep takes pairs of thousands of customers from a table each to their posterior, and production has five."""
    words, count, discount = 400, 5000, 0.5
    shape = {"child": discount, "parent": 0.5, "words": words}
    names = hpylm._gaps(np.array([7], np.uint64))
    drawn = hpylm._pack(np.ones(words, np.uint32), hpylm._gaps(np.arange(words)), np.zeros(words, np.uint32), np.full(words, count, np.uint32), names, np.array([0]))
    tables, totals = 1_000_000, (10_000, 400)
    weight = (hpylm.THETA + discount * tables) * hpylm.parent_probability(np.ones(1), np.ones(1), *totals, 0.5, words)[0]
    log_p = np.full(count + 1, -np.inf)  # by the recursion of the Stirling numbers, weights in it
    log_p[1] = 0.0
    for c in range(1, count):
        log_p[1:] = np.logaddexp(log_p[:-1] + math.log(weight), log_p[1:] + np.log(np.maximum(c - discount * np.arange(1, count + 1), 1e-300)))
    p = np.exp(log_p - log_p.max())
    mean = p @ np.arange(count + 1) / p.sum()
    seated = hpylm.swept(0, drawn, hpylm.first_seating(drawn)[0], None, np.array([tables]), 0, 2, shape, totals, 1)[4][0]
    assert mean > 2 * 16 and abs(seated / words / mean - 1) < 0.05


def test_contexts_are_words(spark):
    """What follows a word is learnt for it alone, however many other words there are: 3000 words with one follower each."""
    rows = [(k, f"head{k % 3000} tail{k % 3000}", "s") for k in range(12_000)]
    got = [r for r in hpylm.score_texts(docs(spark, rows)).collect() if r.held_out and r.n_known == 3]
    assert sum(10 ** (r.score + math.log10(3000)) > 0.25 for r in got) > 0.9 * len(got) > 900


def sequential_scores(texts, train, discounts, burn_in, samples, rng):
    """One customer after the other, over tables as lists: averaged probabilities of every token."""
    child, parent = discounts
    rooms, above = {}, {}  # (context, word) -> sizes of tables; word -> sizes of the parent's tables
    inside, tokens = Counter(), Counter()  # tables and customers of a context
    vocabulary = {w for i in train for w in texts[i]}

    def base(w):
        sizes = above.get(w, [])
        everything = sum(map(sum, above.values()))
        return (sum(sizes) - parent * len(sizes) + (1 + parent * sum(map(len, above.values()))) / (len(vocabulary) + 1)) / (1 + everything)

    def seat(sizes, weight, d):
        """Whether a new table is taken."""
        masses = [s - d for s in sizes] + [weight]
        at = rng.choices(range(len(masses)), masses)[0]
        if at < len(sizes):
            sizes[at] += 1
            return False
        sizes.append(1)
        return True

    def leave(sizes):
        at = rng.choices(range(len(sizes)), sizes)[0]
        sizes[at] -= 1
        if not sizes[at]:
            del sizes[at]
            return True
        return False

    def join_parent(w):
        top = (1 + parent * sum(map(len, above.values()))) / (len(vocabulary) + 1)
        seat(above.setdefault(w, []), top, parent)

    customers = [(c, w) for i in train for c, w in zip([b" ", *texts[i]], texts[i], strict=False)]
    sums = None
    for number in range(burn_in + samples + 1):
        for c, w in customers:
            if number:
                if leave(rooms[c, w]):
                    inside[c] -= 1
                    leave(above[w])
                tokens[c] -= 1
            if seat(rooms.setdefault((c, w), []), (1 + child * inside[c]) * base(w), child):
                inside[c] += 1
                join_parent(w)
            tokens[c] += 1
        if number > burn_in:
            memo = {}

            def p(c, w):
                if (c, w) not in memo:
                    sizes = rooms.get((c, w), [])
                    memo[c, w] = (sum(sizes) - child * len(sizes) + (1 + child * inside[c]) * base(w)) / (1 + tokens[c])  # noqa: B023
                return memo[c, w]

            now = [[p(c, w) for c, w in zip([b" ", *t], t, strict=False)] for t in texts]
            sums = now if sums is None else [[x + y for x, y in zip(a, b, strict=True)] for a, b in zip(sums, now, strict=True)]
    return [sum(math.log10(x / samples) for x in t) for t in sums]


def test_ranks_are_those_of_unique():
    rng = np.random.default_rng(2)
    for x in (rng.integers(0, 50, 300), rng.integers(0, 1 << 62, 300), rng.integers(0, 1 << 63, 300, np.uint64) * np.uint64(2), np.repeat(np.arange(9, dtype=np.uint64) + np.uint64(1 << 63), 7), np.empty(0, np.int64), np.array([5])):
        for values in (x, x[rng.integers(0, len(x), 2 * len(x))] if len(x) else x):
            got, want = hpylm._ranked(values), np.unique(values, return_inverse=True)
            assert (got[0] == want[0]).all() and (got[1] == want[1]).all() and len(got[0]) == len(want[0])


def test_scores_are_those_of_a_sequential_sampler(spark):
    """Parallel sweeps with totals of the sweep before reach what customers seated one by one do: within 0.01 a token on average, 0.06 on any text."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(25)]
    follows = {w: rng.choices(words, [1 / (1 + i) for i in range(25)], k=5) for w in words}
    rows = []
    for k in range(90):
        text = [rng.choice(words[:5])]
        while len(text) < 14:
            text.append(rng.choice(follows[text[-1]] if rng.random() < 0.8 else words))
        rows.append((k, " ".join(text), "s"))
    texts = [[*t.encode().split(), b" "] for _, t, _ in rows]
    train = [i for i, (k, _, _) in enumerate(rows) if not hpylm.held_out(k)]
    pairs = Counter((c, w) for i in train for c, w in zip([b" ", *texts[i]], texts[i], strict=False))
    unigrams = Counter(w for i in train for w in texts[i])
    discount = lambda n: (n := Counter(n.values()), n[1] / (n[1] + 2 * n[2]) if n[2] else 0.5)[1]
    want = sequential_scores(texts, train, (discount(pairs), discount(unigrams)), 20, 60, rng)
    got = {r.doc_id: r for r in hpylm.score_texts(docs(spark, rows), burn_in=4, samples=12).collect()}
    apart = [(got[k].score - w) / len(t) for (k, _, _), w, t in zip(rows, want, texts, strict=True)]
    assert abs(sum(apart) / len(apart)) < 0.01 and max(map(abs, apart)) < 0.06
    assert sum(not math.isclose(got[k].score, got[k].base_score) for k, _, _ in rows) == len(rows)


def test_resizing_keeps_the_books():
    rng = np.random.default_rng(2)
    start = rng.integers(1, 6, 500)
    seating, weight = Seating(start), np.full(500, 0.4)
    wanted = np.maximum(1, start + rng.integers(-3, 4, 500))
    wanted[7] = 900
    seating.resize(wanted, weight, 0.6, rng)
    owner = np.repeat(np.arange(500), seating.tables)
    assert (np.bincount(owner, seating.sizes, 500) == wanted).all() and (seating.customers == wanted).all() and (seating.sizes > 0).all()


def test_scores(spark):
    rows = [*ROWS, *((100 + i, f"the cat {'sat on' if i % 2 else 'ran to'} the mat number {i % 9}", "web") for i in range(300))]
    got = hpylm.score_texts(docs(spark, rows)).collect()
    tokens = [(k, [*(t or "").encode().lower().split(), b" "]) for k, t, _ in rows]
    train = [w for k, w in tokens if not hpylm.held_out(k)]
    counts = Counter(x for w in train for x in w)
    n, v = sum(counts.values()), len(counts)
    want = Counter((k, hpylm.held_out(k), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 4)) for k, w in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    held = [r for r in got if r.held_out and r.doc_id >= 100]
    assert sum(r.score for r in held) > 0.5 * sum(r.base_score for r in held)  # half the bits
    assert all(abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity and r.score < 0 for r in got)
    assert hpylm.score_texts(docs(spark, [])).count() == 0
    alone = hpylm.score_texts(docs(spark, [(k, "a b", "s") for k in range(200) if hpylm.held_out(k)][:2])).collect()
    assert all((r.score, r.base_score, r.train_tokens) == (0.0, 0.0, 0) for r in alone)


def test_probabilities_sum_to_one():
    customers, tables = np.array([5, 2, 1]), np.array([2, 1, 1])
    known = hpylm.parent_probability(customers, tables, 8, 4, 0.4, 3)
    unknown = hpylm.parent_probability(np.zeros(1), np.zeros(1), 8, 4, 0.4, 3)
    assert abs(known.sum() + unknown[0] - 1) < 1e-12


def test_no_clashing_name_is_an_input():
    assert not {"doc_id", "text", "source"} & set(CLASHING)
