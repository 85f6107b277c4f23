"""Repair and analysis of speech transcripts on Spark.

Transcripts, lexicons, rules and language models are DataFrames; every public
function takes and returns DataFrames or Columns.
"""
