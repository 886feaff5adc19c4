"""tabweave: prepare, encode, generate, mix, score and report on labelled
tables, as Spark DataFrame jobs."""

__version__ = "0.1.0"
