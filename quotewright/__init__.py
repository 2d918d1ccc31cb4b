"""quotewright: evidence checking and corpus processing on PySpark DataFrames."""
