"""tesserel: SQL feature transforms that are fitted and applied as Spark plans."""

__version__ = "0.1.0"
