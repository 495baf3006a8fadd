"""tessera: Spark-native analytics over annotated text corpora.

Corpora (CoNLL-family blocks, delimited text, sentence pairs, embeddings and
dependency graphs) are DataFrames with explicit sequence keys; every operator
is a function ``DataFrame -> DataFrame`` built from Spark SQL expressions,
joins, windows and aggregates, so Catalyst plans the work.
"""

__version__ = "0.1.0"
