"""Operators over decks, slides, pages, notes, media, links, fonts and export plans: DataFrame in, DataFrame out."""
