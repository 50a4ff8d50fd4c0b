"""Queries d36 to d53: whole packages, their notes, media, fonts and faults, over the virtual library, with DuckDB SQL.

Packages are tables of parts with real markup, made from the driver's tables, so the operators parse what they would
find in a library; the SQL states what the markup says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import faces, text
from ..functions.rows import by_rows
from ..operators import builds, export, fonts, library, media, notes, pages, sinks
from . import synthetic
from .queries import _VREL, VPAGES, VSLIDE, _gif_bytes, _long, _read, query, vpages, vrel, vslide

# ---------------------------------------------------------------- packages as parts

_MARK = 987654  # a number that templates are filled in for


def _each(n: Column, template: str) -> Column:
    """A template for every i from 0 to n - 1, with the shape id 3 + i."""
    some = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.replace(F.lit(template), F.lit(str(_MARK)), (i + 3).cast("string")))
    return F.when(n > 0, F.array_join(some, "")).otherwise("")


def slide_markup(n_steps: Column, hidden: Column, face: Column) -> Column:
    """A slide with a title and a shape for each click, as ``synthetic.slide`` writes it, all in the JVM."""
    shapes = F.concat(F.lit(synthetic.shape(2, "Title", "t")), _each(n_steps, synthetic.shape(_MARK, "s", "x")), face)
    clicks = F.when(n_steps > 0, F.concat(F.lit("<p:timing>"), _each(n_steps, synthetic.click(_MARK)), F.lit("</p:timing>"))).otherwise("")
    plain, shut = (F.lit(synthetic.slide(["@"], hidden=h).replace("</p:sld>", "#</p:sld>")) for h in (False, True))
    return F.replace(F.replace(F.when(hidden, shut).otherwise(plain), F.lit("@"), shapes), F.lit("#"), clicks)


def vparts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a package for every conversation, a slide for each turn. Notes say "note n &amp; more" for turns of users; every third slide
    has a video, every fifth a GIF, every fourth (from the second) a link, every fourth (from the first) a face."""
    slides = vslide(spark, sf_dir).withColumn("n", F.col("slide_no").cast("string")).withColumn("path", F.concat(F.lit("/lib/deck"), F.col("deck").cast("string"), F.lit(".pptx")))
    i, n = F.col("slide_no"), F.col("n")
    joined = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in c))
    part = lambda name, body, size=None: F.struct(name.alias("part"), body.alias("content"), (size if size is not None else F.octet_length(body)).cast("long").alias("part_bytes"))
    named = lambda before, after: joined(before, n, after)
    none = F.lit(None).cast("binary")
    body = slide_markup(F.col("n_steps"), F.col("hidden"), F.when(i % 4 == 1, '<a:latin typeface="Inter"/>').otherwise(""))
    rel = lambda when, kind, target, external=False: F.when(when, joined(f'<Relationship Id="{kind}" Type="http://x/{kind}" Target="', target, '" TargetMode="External"/>' if external else '"/>')).otherwise("")
    rels = joined(
        '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">', rel(F.lit(True), "slideLayout", F.lit("../slideLayouts/slideLayout1.xml")),
        rel(F.col("role") == "user", "notesSlide", named("../notesSlides/notesSlide", ".xml")), rel(i % 3 == 0, "media", named("../media/clip", ".mp4")),
        rel(i % 4 == 2, "video", joined("https://www.youtube.com/watch?v=", F.col("deck").cast("string"), "&amp;t=", n), True), "</Relationships>",
    )
    note = F.replace(F.lit(synthetic.notes("@")), F.lit("@"), named("note ", " &amp; more"))
    gif = F.when(i % 5 == 0, _gif_bytes(F.when(i % 5 == 0, F.col("n_lines") % 3).otherwise(0)))
    per_slide = F.array(
        part(named("ppt/slides/slide", ".xml"), body.cast("binary")), part(named("ppt/slides/_rels/slide", ".xml.rels"), rels.cast("binary")),
        F.when(F.col("role") == "user", part(named("ppt/notesSlides/notesSlide", ".xml"), note.cast("binary"))),
        F.when(i % 3 == 0, part(named("ppt/media/clip", ".mp4"), none, F.lit(1000))), F.when(i % 5 == 0, part(named("ppt/media/g", ".gif"), gif, i)),
    )
    of_slides = slides.select("path", F.explode(F.filter(per_slide, lambda p: p.isNotNull())).alias("p"))
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slide_no", c.alias("x")))), lambda s: s["x"]), "")
    decks = slides.groupBy("deck", "path").agg(in_order(joined('<p:sldId id="', (i + 255).cast("string"), '" r:id="rId', n, '"/>')).alias("entries"), in_order(joined('<Relationship Id="rId', n, '" Target="slides/slide', n, '.xml"/>')).alias("rels"))
    embedded = F.when(F.col("deck") % 3 == 0, '<p:embeddedFontLst><p:embeddedFont><p:font typeface="Graphik"/></p:embeddedFont></p:embeddedFontLst>').otherwise("")
    per_deck = F.array(
        part(F.lit("ppt/presentation.xml"), joined("<p:presentation><p:sldIdLst>", F.col("entries"), '</p:sldIdLst><p:sldSz cx="12192000" cy="6858000"/>', embedded, "</p:presentation>").cast("binary")),
        part(F.lit("ppt/_rels/presentation.xml.rels"), joined("<Relationships>", F.col("rels"), "</Relationships>").cast("binary")),
        part(F.lit("ppt/theme/theme1.xml"), joined('<a:minorFont><a:latin typeface="', F.when(F.col("deck") % 2 == 0, "Helvetica").otherwise("Graphik"), '"/></a:minorFont>').cast("binary")),
    )
    sizes = slides.groupBy("path").agg(F.sum(F.length("text")).cast("long").alias("bytes"))
    parts = of_slides.union(decks.select("path", F.explode(per_deck))).join(sizes, "path")
    return parts.select("path", text.base_name(F.col("path")).alias("name"), "bytes", "p.part", "p.part_bytes", "p.content", F.xxhash64("p.part").alias("ordinal"), F.lit(None).cast("string").alias("error"))


VAUDIT = (
    VSLIDE
    + """,
deck AS (
  SELECT deck, '/lib/deck' || deck || '.pptx' AS path, sum(length(text))::BIGINT AS bytes, count(*)::INT AS slides, (count(*) FILTER (n_steps > 0))::INT AS animated_slides, sum(n_steps)::INT AS build_states,
    (count(*) FILTER (hidden))::INT AS hidden_slides, (count(*) FILTER (slide_no % 5 = 0 AND n_lines % 3 = 2))::INT AS gifs, (count(*) FILTER (slide_no % 3 = 0))::INT AS videos,
    (count(*) FILTER (slide_no % 4 = 2))::INT AS links, (coalesce(sum(1000) FILTER (slide_no % 3 = 0), 0) + coalesce(sum(slide_no) FILTER (slide_no % 5 = 0 AND n_lines % 3 = 2), 0))::BIGINT AS media_bytes,
    (count(*) FILTER (role = 'user'))::INT AS noted_slides, coalesce(sum(length('note ' || slide_no || ' &amp; more')) FILTER (role = 'user'), 0)::INT AS notes_chars
  FROM vslide GROUP BY deck),
same AS (SELECT bytes, slides, min(path) AS first, count(*) AS n FROM deck GROUP BY bytes, slides),
audit AS (
  SELECT d.*, CASE WHEN deck % 2 = 0 THEN 'Helvetica,Inter' ELSE 'Graphik,Inter' END AS fonts, CASE WHEN deck % 3 = 0 THEN 'Graphik' ELSE '' END AS fonts_embedded,
    CASE WHEN deck % 2 = 1 AND deck % 3 <> 0 THEN 'Graphik,Inter' ELSE 'Inter' END AS fonts_missing,
    CASE WHEN first <> path THEN first END AS duplicate_of, n AS duplicate_group_size
  FROM deck d JOIN same s ON s.bytes = d.bytes AND s.slides = d.slides)"""
)


def vaudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.audit(vparts(spark, sf_dir), spark.createDataFrame([("helvetica",)], "key string"))


@query("d36_audit", VAUDIT + """
SELECT path, bytes, slides, 1280::INT AS width_px, 720::INT AS height_px, '16:9' AS aspect, fonts, fonts_embedded, fonts_missing, animated_slides, build_states, hidden_slides, gifs, videos, 0::INT AS audio, links,
  media_bytes, noted_slides, notes_chars, NULL::VARCHAR AS error, duplicate_of, duplicate_group_size FROM audit""")  # fmt: skip
def d36(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TV9, TV10: the flagship over whole packages."""
    records = vaudit(spark, sf_dir).withColumn("links", F.size("external_media")).withColumns({c: F.array_join(c, ",") for c in ("fonts", "fonts_embedded", "fonts_missing")})
    return records.drop("name", "external_media")


@query("d37_audit_summary", VAUDIT + f"""
SELECT count(*) AS decks, sum(slides)::BIGINT AS slides, sum(bytes)::BIGINT AS bytes, 0::BIGINT AS unreadable, count(*) AS font_risk_decks, count(*) FILTER (fonts_embedded <> '') AS decks_embedding_fonts,
  count(*) FILTER (animated_slides > 0) AS animated_decks, sum(animated_slides)::BIGINT AS animated_slides, sum(hidden_slides)::BIGINT AS hidden_slides, count(*) FILTER (hidden_slides > 0) AS decks_with_hidden,
  sum(build_states)::BIGINT AS build_states, count(*) FILTER (gifs > 0 OR videos > 0 OR links > 0) AS decks_with_media, sum(gifs)::BIGINT AS animated_gifs, sum(videos)::BIGINT AS videos,
  sum(links)::BIGINT AS external_media, sum(noted_slides)::BIGINT AS noted_slides, sum(notes_chars)::BIGINT AS notes_chars, 0::BIGINT AS oversized_decks, {text.OVERSIZED_BYTES}::BIGINT AS oversized_bytes_threshold,
  (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM same) AS redundant_copies FROM audit""")  # fmt: skip
def d37(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.summary(vaudit(spark, sf_dir))


@query("d53_audit_missing_faces", VAUDIT + " SELECT 'Inter' AS face, count(*) AS decks FROM audit HAVING count(*) > 0 UNION ALL SELECT 'Graphik', count(*) FROM audit WHERE fonts_missing = 'Graphik,Inter' HAVING count(*) > 0")
def d53(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 over whole packages."""
    return library.missing_faces(vaudit(spark, sf_dir))


@query("d38_presentation_slides", VSLIDE + " SELECT '/lib/deck' || deck || '.pptx' AS deck, slide_no::BIGINT AS slide_no, 'ppt/slides/slide' || slide_no || '.xml' AS part, hidden FROM vslide")
def d38(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(notes.presentation_slides(vparts(spark, sf_dir)), "slide_no")


@query("d39_slide_notes", VSLIDE + " SELECT '/lib/deck' || deck || '.pptx' AS deck, slide_no::BIGINT AS slide_no, 'note ' || slide_no || ' & more' AS text FROM vslide WHERE role = 'user'")
def d39(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(notes.slide_notes(vparts(spark, sf_dir)), "slide_no")


@query("d40_notes_json", VSLIDE + """,
seen AS (SELECT deck, slide_no, role, row_number() OVER (PARTITION BY deck ORDER BY slide_no) AS page FROM vslide WHERE NOT hidden)
SELECT '/lib/deck' || deck || '.pptx' AS deck, '{' || string_agg('"' || page || '":"note ' || slide_no || ' & more"', ',' ORDER BY page) || '}' AS json FROM seen WHERE role = 'user' GROUP BY deck""")  # fmt: skip
def d40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.notes_json(notes.notes_on_pages(vparts(spark, sf_dir)))


@query("d41_audit_links", _VREL + f" SELECT deck, slide, url FROM ext WHERE e IN ({', '.join(repr(e) for e in text.VIDEO + text.AUDIO)}) OR regexp_matches(lower(url), '{text.AUDIT_HOSTS}')")
def d41(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.external_links(vrel(spark, sf_dir), text.AUDIT_HOSTS, quotes=False)


@query("d42_extract_media", VSLIDE + """
SELECT '/lib/deck' || deck || '.pptx' AS deck, 'deck' || deck || '-slide' || lpad(slide_no::VARCHAR, greatest(3, length(slide_no::VARCHAR))::INT, '0') || '-clip' || slide_no || '.mp4' AS file, 'video' AS kind, slide_no::VARCHAR AS slides, 1000::BIGINT AS bytes, NULL::INT AS frames
FROM vslide WHERE slide_no % 3 = 0
UNION ALL SELECT '/lib/deck' || deck || '.pptx', 'deck' || deck || '-unplaced-g' || slide_no || '.gif', 'animated-gif', '', slide_no, 2 FROM vslide WHERE slide_no % 5 = 0 AND n_lines % 3 = 2""")  # fmt: skip
def d42(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = media.extract_media(vparts(spark, sf_dir))
    return items.select("deck", "file", "kind", F.array_join(F.transform("slides", lambda s: s.cast("string")), ",").alias("slides"), "bytes", F.col("frames").cast("int").alias("frames"))


@query("d43_page_map_json", VPAGES + """,
several AS (SELECT deck, slide_no, n_steps + 1 AS n FROM vslide WHERE n_steps > 0 AND NOT hidden),
e AS (SELECT deck, string_agg('{"slide":' || slide_no || ',"pages":' || n || '}', ',' ORDER BY slide_no) AS j FROM several GROUP BY deck),
p AS (SELECT deck, string_agg('{"page":' || page || ',"slide":' || slide || ',"state":' || coalesce(state::VARCHAR, 'null') || ',"of":' || coalesce("of"::VARCHAR, 'null') || '}', ',' ORDER BY page) AS j FROM vpages GROUP BY deck)
SELECT p.deck, '{"source":"' || p.deck || '","expanded_slides":[' || coalesce(e.j, '') || '],"pages":[' || p.j || ']}' AS json FROM p LEFT JOIN e ON e.deck = p.deck""")  # fmt: skip
def d43(spark: SparkSession, sf_dir: str) -> DataFrame:
    expanded = vslide(spark, sf_dir).where("n_steps > 0 and not hidden").select("deck", "slide_no", (F.col("n_steps") + 1).alias("n_states"))
    return sinks.page_map_json(vpages(spark, sf_dir), expanded)


# ---------------------------------------------------------------- package rules

_BROKEN = ["", "V2", "V3", "V4", "V5", "V6", "V7", "V8", "V9", "V10", "V11", "V1"]


def _broken(number: int) -> bytes:
    """A deck of two slides that breaks the rule at a place of _BROKEN; the first is whole."""
    from ..functions import package as p

    if _BROKEN[number] == "V1":
        return b"no package"
    deck = p.Package(synthetic.deck([synthetic.slide([synthetic.shape(2, "a", "b")]), synthetic.slide([])]))
    one, rels = "ppt/slides/slide1.xml", p.rels_of("ppt/slides/slide1.xml")
    gone = {"V4": {rels}, "V6": {p.TYPES}, "V8": {p.PRESENTATION_RELS}}.get(_BROKEN[number], frozenset())
    changes = {
        "V2": (one, b"</p:sld>", b""), "V3": (one, b"<a:p><a:r><a:t>b</a:t></a:r></a:p>", b""), "V5": (rels, b"slideLayout", b"other"), "V7": (p.TYPES, b"slide2.xml", b"s.xml"),
        "V9": (p.PRESENTATION, b'id="257"', b'id="256"'), "V10": (p.PRESENTATION, b'r:id="rId2"', b'r:id="rId9"'), "V11": (p.PRESENTATION_RELS, b"slide2.xml", b"slide9.xml"),
    }
    if change := changes.get(_BROKEN[number]):
        part, old, new = change
        deck.parts[part] = deck.parts[part].replace(old, new)
    return deck.write(without=gone)


_broken_decks = by_rows(T.BinaryType())(_broken)


@query("d44_package_faults", f"SELECT DISTINCT conv_id AS deck, list_extract([{', '.join(repr(r) for r in _BROKEN)}], (conv_id % 12 + 1)::INT) AS rule FROM conversations WHERE conv_id % 12 <> 0")
def d44(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TV5: each package breaks one rule or none."""
    decks = _read(spark, sf_dir, "conversations", "conv_id").distinct().select(F.col("conv_id").alias("deck"), _broken_decks((F.col("conv_id") % 12).cast("int")).alias("content"))
    return decks.select("deck", F.explode(builds.deck_faults("content")).alias("f")).select("deck", "f.rule").distinct()


# ---------------------------------------------------------------- faces

_SUFFIXES = {" Semi Bold": ("SemiBold", None, None), "-Lt": ("Light", None, None), "LTStd-Bold": ("Bold", None, None), " 75": ("Bold", None, None), " Display": (None, None, "Display"), " Cn Light": ("Light", "Condensed", None), " Book Italic": ("Regular", None, None), "LT": ("Light", None, None)}


def _picked(values: list, number: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (number % len(values) + 1).cast("int"))


def _listed(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else repr(v) for v in values) + "]"


_CUTS = list(_SUFFIXES)
_CUT_OF = f"(p_partkey % {len(_CUTS)} + 1)::INT"


@query("d45_face_parts", f"""
SELECT DISTINCT 'Fam' || chr((97 + p_partkey % 26)::INT) || list_extract({_listed(_CUTS)}, {_CUT_OF}) AS face, 'Fam' || chr((97 + p_partkey % 26)::INT) AS family,
  list_extract({_listed([_SUFFIXES[c][0] for c in _CUTS])}, {_CUT_OF}) AS style, list_extract({_listed([_SUFFIXES[c][1] for c in _CUTS])}, {_CUT_OF}) AS width,
  list_extract({_listed([_SUFFIXES[c][2] for c in _CUTS])}, {_CUT_OF}) AS optical FROM part""")  # fmt: skip
def d45(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    named = _read(spark, sf_dir, "part", "p_partkey").select(F.concat(F.lit("Fam"), F.char(97 + key % 26), _picked(_CUTS, key)).alias("face")).distinct()
    return named.select("face", faces.face_parts(F.col("face")).alias("p")).select("face", "p.*")


_PLAN = """
WITH v AS (
  SELECT p_partkey, p_partkey % 7 AS k, chr((97 + p_partkey % 26)::INT) AS c, 'd' || (p_partkey % 50) AS path FROM part),
m AS (
  SELECT *, CASE k WHEN 0 THEN 'serif' WHEN 1 THEN 'Own' || c WHEN 2 THEN 'Sys' || c WHEN 3 THEN 'Base' || c || ' Bold' WHEN 4 THEN 'Off' || c || ' Light' WHEN 5 THEN 'Sub' || c || ' Light' ELSE 'Sub' || c END AS face FROM v)
SELECT face, CASE k WHEN 0 THEN 'noise' WHEN 5 THEN 'substitute' WHEN 6 THEN 'substitute' ELSE 'alias' END AS verdict,
  CASE k WHEN 0 THEN 'CSS keyword, not a font - pasted in from a web page' WHEN 1 THEN 'own' || c || '.otf' WHEN 2 THEN 'Sys' || c WHEN 3 THEN 'Base' || c WHEN 4 THEN 'Off' || c || '-Light' END AS detail,
  CASE k WHEN 1 THEN 'installed' WHEN 2 THEN 'system' WHEN 3 THEN 'system' WHEN 4 THEN 'office' END AS kind, CASE WHEN k >= 5 THEN 'Sub' || c END AS family,
  CASE k WHEN 5 THEN 'Light' WHEN 6 THEN 'Regular' END AS style, CASE k WHEN 5 THEN 300 WHEN 6 THEN 400 END::INT AS weight, count(DISTINCT path)::INT AS decks
FROM m GROUP BY ALL"""


@query("d46_face_plan", _PLAN.replace("GROUP BY ALL", "GROUP BY face, k, CASE WHEN k = 0 THEN '' ELSE c END").replace("|| c", "|| CASE WHEN k = 0 THEN '' ELSE c END"))
def d46(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TV11: noise, own substitutes, system and office aliases, substitutes."""
    key = F.col("p_partkey")
    letter, kind = F.char(97 + key % 26), key % 7
    rows = _read(spark, sf_dir, "part", "p_partkey")
    with_letter = lambda before, after="": F.concat(F.lit(before), letter, F.lit(after))
    face = F.when(kind == 0, "serif").when(kind == 1, with_letter("Own")).when(kind == 2, with_letter("Sys")).when(kind == 3, with_letter("Base", " Bold")).when(kind == 4, with_letter("Off", " Light")).when(kind == 5, with_letter("Sub", " Light")).otherwise(with_letter("Sub"))
    missing = rows.select(F.concat(F.lit("d"), (key % 50).cast("string")).alias("path"), face.alias("face"))
    letters = spark.range(26).select(F.char(97 + F.col("id")).alias("c"))
    named = lambda before, after="": F.concat(F.lit(before), F.col("c"), F.lit(after))
    system = letters.select(F.explode(F.array(named("Sys"), named("Base"))).alias("face")).withColumn("key", text.plain_key(F.col("face")))
    office = letters.select(named("/office/Off", "-Light.ttf").alias("path"), F.concat(F.lit("off"), "c", F.lit("light")).alias("key"))
    ours = letters.select(named("own").alias("key"), named("own", ".otf").alias("source"))
    return fonts.face_plan(missing, system, office, ours).drop("paths").withColumn("weight", F.col("weight").cast("int")).withColumn("decks", F.col("decks").cast("int"))


_ANCHOR = 500.0
_POOL = [(name, genre, i, 400.0 + 37 * i % 200) for i, (name, genre) in enumerate(faces.CANDIDATES.items())]


@query("d47_recommend", f"""
WITH pool AS (SELECT * FROM (VALUES {', '.join(f"('{n}', '{g}', {i}, {w})" for n, g, i, w in _POOL)}) AS t(candidate, genre, pool, width) WHERE genre NOT IN ('display', 'mono')),
g AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'Muli' WHEN 1 THEN 'Graphik' WHEN 2 THEN 'Proxima Nova' ELSE 'Other' END || CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE ' ' || n_nationkey END AS family, n_nationkey::INT AS deck_count,
  CASE n_nationkey % 4 WHEN 1 THEN 'grotesque' WHEN 2 THEN 'geometric' END AS wanted FROM nation WHERE n_nationkey % 4 <> 0 OR n_nationkey = 0),
r AS (
  SELECT family, deck_count, candidate, width / {_ANCHOR} AS ratio, row_number() OVER (PARTITION BY family ORDER BY width > {_ANCHOR}, coalesce(genre <> wanted, true), CASE WHEN width <= {_ANCHOR} THEN -width ELSE width END, pool) AS rank FROM g CROSS JOIN pool)
SELECT family, deck_count, CASE WHEN family = 'Muli' THEN 'Mulish' ELSE candidate END AS pick, CASE WHEN family <> 'Muli' THEN round((ratio - 1) * 100, 6) END AS delta_pct,
  CASE WHEN family = 'Muli' THEN 'the same design, free' ELSE 'measured on 1000 characters from these decks' END AS why FROM r WHERE rank = 1""")  # fmt: skip
def d47(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TV13: successors, genres and widths."""
    key = F.col("n_nationkey")
    family = F.when(key % 4 == 0, "Muli").otherwise(F.concat(_picked(["", "Graphik", "Proxima Nova", "Other"], key), F.lit(" "), key.cast("string")))
    groups = _read(spark, sf_dir, "nation", "n_nationkey").where("n_nationkey % 4 <> 0 or n_nationkey = 0").select(family.alias("family"), key.cast("int").alias("deck_count"))
    widths = spark.createDataFrame([(n, w) for n, _, _, w in _POOL], "candidate string, width double")
    return fonts.recommend(groups, widths, _ANCHOR, 1000).select("family", "deck_count", "pick", F.round("delta_pct", 6).alias("delta_pct"), "why")


_WEIGHTS = {"Thin": (100, 300), "Light": (300, 500), "Bold": (700, 700), "Black": (900, 900), "Odd": (400, 600)}
_GENRES = {"Graphik X": "grotesque", "Proxima Nova": "geometric", "My Transport New": "signage", "Transport Y": "signage", "Other": None}
_TWINS = {"Muli": "Mulish", "SourceSansPro": None, "Source Sans Pro": "Source Sans 3", "montserrat": "Montserrat", "Other": None}


@query("d48_face_values", f"""
SELECT p_partkey, list_extract({[w for w, _ in _WEIGHTS.values()]}, (p_partkey % 5 + 1)::INT)::INT AS weight, list_extract({[b for _, b in _WEIGHTS.values()]}, (p_partkey % 5 + 1)::INT)::INT AS bold,
  list_extract({_listed(list(_GENRES.values()))}, (p_partkey % 5 + 1)::INT) AS genre, list_extract({_listed(list(_TWINS.values()))}, (p_partkey % 5 + 1)::INT) AS twin,
  'Fam' || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN ' +1 weight' ELSE ' +2 weights' END AS label FROM part""")  # fmt: skip
def d48(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P22, P23, J10, P38."""
    rows = _read(spark, sf_dir, "part", "p_partkey", "p_size")
    key = F.col("p_partkey")
    weight = faces.weight_of(_picked(list(_WEIGHTS), key))
    listed = F.sequence(F.lit(0), (F.col("p_size") % 3).cast("int"))
    return rows.select(
        "p_partkey", weight.cast("int").alias("weight"), faces.bold_of(weight).cast("int").alias("bold"), faces.genre_of(_picked(list(_GENRES), key)).alias("genre"),
        faces.successor_of(_picked(list(_TWINS), key)).alias("twin"), fonts.group_label(F.lit("Fam"), listed, F.lit(None).cast("double")).alias("label"),
    )


@query("d49_installed_faces", """
WITH l AS (SELECT p_partkey AS number, CASE WHEN p_partkey % 5 = 1 THEN 'Fam' || chr((97 + p_partkey % 26)::INT) END AS named, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE 'Face ' || (p_partkey % 300) END AS full_name FROM part),
f AS (SELECT number, last_value(named IGNORE NULLS) OVER (ORDER BY number ROWS UNBOUNDED PRECEDING) AS family, coalesce(named, full_name) AS face FROM l WHERE named IS NOT NULL OR full_name IS NOT NULL),
k AS (SELECT *, regexp_replace(lower(face), '[^a-z0-9]', '', 'g') AS key, row_number() OVER (PARTITION BY regexp_replace(lower(face), '[^a-z0-9]', '', 'g') ORDER BY number) AS r FROM f WHERE family IS NOT NULL)
SELECT key, family, face FROM k WHERE r = 1""")  # fmt: skip
def d49(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A font listing of families and their faces."""
    key = F.col("p_partkey")
    line = F.when(key % 5 == 1, F.concat(F.lit("Family: Fam"), F.char(97 + key % 26))).when(key % 5 == 0, "Version: 1").otherwise(F.concat(F.lit("  Full Name: Face "), (key % 300).cast("string")))
    return fonts.installed_faces(_read(spark, sf_dir, "part", "p_partkey").select(key.alias("number"), line.alias("line")))


# ---------------------------------------------------------------- runs


@query("d50_recovery", """
WITH a AS (
  SELECT 'd' || user_id AS path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, CASE event_type WHEN 'purchase' THEN 'nofonts' WHEN 'error' THEN 'flat' ELSE 'deck' END AS feed, event_id % 3 = 0 AS ok FROM events),
b AS (SELECT path, min(attempt) FILTER (ok) AS attempt FROM a GROUP BY path)
SELECT b.path, CASE WHEN b.attempt IS NULL THEN 'fail' ELSE 'ok' END AS status,
  CASE WHEN a.feed = 'nofonts' THEN 'fonts stripped' WHEN a.feed = 'flat' THEN 'build states flattened' WHEN b.attempt > 1 THEN 'retried' END AS recovery
FROM b LEFT JOIN a ON a.path = b.path AND a.attempt = b.attempt""")  # fmt: skip
def d50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TV16, K13, U5: the first attempt that worked."""
    rows = _read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    feed = F.when(F.col("event_type") == "purchase", "nofonts").when(F.col("event_type") == "error", "flat").otherwise("deck")
    attempt = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return export.recovery(rows.select(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("path"), attempt.alias("attempt"), feed.alias("feed"), (F.col("event_id") % 3 == 0).alias("ok")))


@query("d51_image_names", VPAGES + """,
wide AS (SELECT *, greatest(2, length(max(slide) OVER (PARTITION BY deck)::VARCHAR)) AS w, greatest(2, length(max(coalesce("of", 1)) OVER (PARTITION BY deck)::VARCHAR)) AS sw FROM vpages)
SELECT deck, page, 'x-' || lpad(slide::VARCHAR, w::INT, '0') || CASE WHEN state IS NULL THEN '' ELSE '.' || lpad((state + 1)::VARCHAR, sw::INT, '0') END || '.png' AS file,
  CASE page % 3 WHEN 0 THEN 1000 ELSE 500 END::INT AS width, CASE page % 3 WHEN 0 THEN 500 ELSE 1000 END::INT AS height FROM wide WHERE page % 3 <> 2""")  # fmt: skip
def d51(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J18, P37, K11; every third page has no extent and so no image."""
    page = F.col("page")
    found = vpages(spark, sf_dir)
    boxes = found.select("deck", "page", F.when(page % 3 == 0, 800.0).when(page % 3 == 1, 400.0).otherwise(0.0).alias("box_width"), F.when(page % 3 == 0, 400.0).otherwise(800.0).alias("box_height"))
    return _long(pages.image_names(boxes, pages.labels(found), "x", 1000), "page")


@query("d52_notes_total", VPAGES + """
SELECT p.deck, count(*) AS notes, sum(length(v.text) + CASE WHEN p.state IS NULL THEN 0 ELSE length('[build ' || p.state || ' of ' || (p."of" - 1) || ']') + 1 END)::BIGINT AS chars
FROM vpages p JOIN vslide v ON v.deck = p.deck AND v.slide_no = p.slide WHERE v.text <> '' GROUP BY p.deck""")  # fmt: skip
def d52(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21, over TV7 with a page map."""
    return notes.notes_total(pages.page_notes(vpages(spark, sf_dir), vslide(spark, sf_dir).select("deck", "slide_no", "text")))
