"""deckhouse: analytics over libraries of presentation files, as DataFrames."""

__version__ = "0.3.0"
