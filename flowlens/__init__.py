"""flowlens: labelled-table analytics on PySpark."""
