"""codequarry: facts, search, ranking and evidence over text and code corpora, as Spark jobs."""

__version__ = "0.1.0"
