"""kelpline: document and source-code corpora as DataFrames, on PySpark only."""
