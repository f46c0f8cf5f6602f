"""Landing parsers: files already on storage become typed rows.

Line formats take a DataFrame with a `value` column (one line per row, as `spark.read.text` gives), document formats one
with the whole text per row. Bad lines and sentinels are dropped or NULL, never an error.
"""
