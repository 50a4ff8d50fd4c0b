"""Decks by what they hold (Q15): equal packages, slides that several decks share, decks whose slides another one has.

Sizes and slide counts (``library.with_duplicates``) call decks alike that differ, and copies that were packed anew different. Here
members are compared by SHA-256 of their bytes, so the order and compression of a package don't count.

All functions take rows in any order, with repeats, and leave out rows without a deck; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import xml


def package_digests(parts: DataFrame) -> DataFrame:
    """``path, digest, parts`` from ``parts(path, part, content)``: one digest of all members of a package, whatever their order.

    A member's digest is that of its name's and its bytes' digests; a package's, that of its members' in order, by line feeds.
    ``digest`` is null where a member has no ``content`` (it wasn't read), as nothing can be said of such a deck; a row
    without a ``part`` stands for a package that can't be opened or is empty, and has a null digest, too.
    """
    member = F.sha2(F.concat(F.sha2(F.col("part").cast("binary"), 256), F.sha2("content", 256)).cast("binary"), 256)
    known = parts.where("path is not null").select("path", "part", member.alias("member"))
    members = F.collect_set("member")  # of one package, 64 bytes each
    whole = (F.count("*") > 0) & (F.count("*") == F.count("member"))
    return known.groupBy("path").agg(F.when(whole, F.sha2(F.array_join(F.array_sort(members), "\n").cast("binary"), 256)).alias("digest"), F.count_distinct("part").alias("parts"))


def duplicates_by_content(packages: DataFrame) -> DataFrame:
    """Adds ``same_as`` (the first path with the digest; null for that deck itself) and ``copies`` (decks with the digest) to
    ``packages(path, digest)``. A null digest equals none.

    A digest's group is a minimum and a count, made before anything is shuffled, so a deck that a third of a library copies costs no task more.
    """
    groups = packages.where("digest is not null").groupBy("digest").agg(F.min("path").alias("first"), F.count("*").alias("n")).where("n > 1")
    met = packages.join(groups, "digest", "left")
    return met.withColumn("same_as", F.when(F.col("first") != F.col("path"), F.col("first"))).withColumn("copies", F.coalesce("n", F.lit(1)).cast("long")).drop("first", "n")


def slide_digests(parts: DataFrame) -> DataFrame:
    """``deck, digest`` of the distinct slides of each deck, from ``parts(path, part, content)``; slides that weren't read are left out."""
    slides = parts.where((xml.part_kind(F.col("part")) == "slide") & F.col("content").isNotNull() & F.col("path").isNotNull())
    return slides.select(F.col("path").alias("deck"), F.sha2("content", 256).alias("digest")).distinct()


def shared_slides(slides: DataFrame) -> DataFrame:
    """``digest, decks, first`` of the slides of ``slides(deck, digest)`` that several decks have, with the first of these decks by path."""
    return slides.distinct().groupBy("digest").agg(F.count("*").alias("decks"), F.min("deck").alias("first")).where("decks > 1")


def slide_origins(slides: DataFrame) -> DataFrame:
    """``deck, origin, shared``: how many slides of a deck are first found (by path) in which earlier deck.

    Decks that share a slide all point at its first deck instead of at each other, so there are at most as many rows as slides,
    however many decks a slide is in; decks with a common slide are those with a common origin.
    """
    rows = slides.distinct()
    met = rows.join(shared_slides(rows), "digest").where(F.col("deck") != F.col("first"))
    return met.groupBy("deck", F.col("first").alias("origin")).agg(F.count("*").alias("shared"))


def contained_decks(slides: DataFrame) -> DataFrame:
    """``deck, slides, alike, containers, container`` from ``slides(deck, digest)``: distinct slides, decks with exactly the same ones (itself included),
    the number of different larger sets of slides that have all of these, and the first deck (by path) with such a set; null if none.

    Decks with the same slides are one class. An inverted index holds classes by slide, and a class asks only the postings of its
    rarest slide: whoever contains it must be there. So only classes without a rarer slide ask for one that nearly all decks have, and
    what they find there contains at least that slide. What meets is compared in full.
    """
    sets = slides.distinct().groupBy("deck").agg(F.array_sort(F.collect_set("digest")).alias("set"))
    decks = sets.select("deck", "set", F.sha2(F.array_join("set", ",").cast("binary"), 256).alias("class"))
    classes = decks.groupBy("class").agg(F.min("deck").alias("first"), F.count("*").alias("alike"), F.first("set").alias("set"))
    postings = classes.select("class", F.size("set").alias("n"), F.explode("set").alias("digest"))
    often = postings.groupBy("digest").agg(F.count("*").alias("often"))
    rarest = postings.join(often, "digest").groupBy("class", "n").agg(F.min(F.struct("often", "digest")).alias("r")).where("r.often > 1")
    asked = rarest.select(F.col("class").alias("inner"), F.col("n").alias("inner_n"), F.col("r.digest").alias("digest"))
    met = asked.join(postings, "digest").where("n > inner_n").select("inner", F.col("class").alias("outer"))
    mine = classes.select(F.col("class").alias("inner"), F.col("set").alias("inner_set"))
    theirs = classes.select(F.col("class").alias("outer"), F.col("set").alias("outer_set"), F.col("first").alias("outer_first"))
    held = met.join(mine, "inner").join(theirs, "outer").where(F.size(F.array_except("inner_set", "outer_set")) == 0)
    found = held.groupBy(F.col("inner").alias("class")).agg(F.count("*").alias("containers"), F.min("outer_first").alias("container"))
    about = classes.select("class", "alike", F.size("set").cast("long").alias("slides")).join(found, "class", "left")
    return decks.select("deck", "class").join(about, "class").select("deck", "slides", "alike", F.coalesce("containers", F.lit(0)).cast("long").alias("containers"), "container")
