"""pagetally: document-extraction quality analytics on PySpark DataFrames."""
