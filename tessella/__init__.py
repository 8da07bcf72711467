"""Analytics over combinatorial datasets and text corpora, on PySpark."""
