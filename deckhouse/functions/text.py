"""Text rules as Column expressions, JVM-side.

"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Trailing words that a file name may carry and a face name may not (fixed values).
STYLE_SUFFIXES = (
    "Regular Bold Italic BoldItalic Oblique Light Medium SemiBold Semibold DemiBold Black Heavy Thin ExtraLight ExtraBold "
    "Condensed Roman Book MT LT Std Pro"
).split()
VIDEO = [".mp4", ".mov", ".m4v", ".avi", ".wmv", ".mpg", ".mpeg", ".mkv", ".webm", ".asf", ".3gp"]
AUDIO = [".mp3", ".wav", ".m4a", ".aac", ".wma", ".aiff", ".au", ".mid", ".midi"]
#: Never extracted as media: stills and effect sidecars.
STILLS = [".wdp", ".emf", ".wmf", ".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".webp"]
#: Faces that are not text faces.
SYMBOL_FACES = ["Wingdings", "Wingdings 2", "Wingdings 3", "Webdings", "Symbol", "Arial Unicode MS"]
EMU_PER_PIXEL = 9525
OVERSIZED_BYTES = 200_000_000


def strip(c: Column) -> Column:
    """White space of any script off both ends; Spark's trim takes spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def plain_key(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def face_key(c: Column) -> Column:
    """Font extension and one trailing style word off, then ``plain_key``."""
    bare = F.regexp_replace(c, r"(?i)\.(ttf|otf|ttc|dfont)$", "")
    return plain_key(F.regexp_replace(bare, rf"[-_ ]?({'|'.join(STYLE_SUFFIXES)})$", ""))


def extension(c: Column) -> Column:
    """Lower-case extension with its dot; empty for none. Leading dots of a name start no extension."""
    return F.regexp_extract(F.lower(c), r"(?s)^(?:.*/)?\.*[^/.][^/]*?(\.[^./]*)$", 1)


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, "([^/]*)$", 1)


def folder_name(c: Column) -> Column:
    """Everything before the last slash; ``.`` for a bare name and ``/`` for one at the root."""
    cut = F.regexp_extract(c, "^(.*)/[^/]*$", 1)
    return F.when(cut != "", cut).when(F.startswith(c, F.lit("/")), "/").otherwise(".")


def stem(c: Column) -> Column:
    """Base name up to its last dot; the whole name if it has none."""
    return F.regexp_replace(base_name(c), r"\.[^.]*$", "")


def unslash(c: Column) -> Column:
    """Trailing slashes off, but never the root's own."""
    return F.when(F.regexp_replace(c, "/+$", "") == "", F.when(c == "", c).otherwise("/")).otherwise(F.regexp_replace(c, "/+$", ""))


def pixels(emu: Column) -> Column:
    """Half-even, as null for what is not a number."""
    return F.bround(emu / EMU_PER_PIXEL).cast("int")


def named_ratio(r: Column) -> Column:
    """P2, the named ones: 16:9 and 4:3 within 0.01, A4 within 0.02; else null."""
    return F.when(F.abs(r - F.lit(16 / 9)) < 0.01, "16:9").when(F.abs(r - F.lit(4 / 3)) < 0.01, "4:3").when(F.abs(r - F.lit(2**0.5)) < 0.02, "A4")


def pdf_string(c: Column) -> Column:
    """UTF-16BE hex string of any text."""
    return F.concat(F.lit("<FEFF"), F.hex(F.encode(c, "UTF-16BE")), F.lit(">"))


def is_playable(url: Column, patterns: str) -> Column:
    return extension(url).isin(VIDEO + AUDIO) | F.rlike(url, F.lit(f"(?i){patterns}"))


#: P14 and P15 differ in their patterns (Q3); both are substring tests.
AUDIT_HOSTS = r"youtube|youtu\.be|vimeo|wistia|loom"
MEDIA_HOSTS = AUDIT_HOSTS + r"|\.mp4|\.mov"


def replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)
