"""Training-data operators: personal data, mixing, deduplication, tokens, toxicity, secrets, shards.

Every operator takes and returns DataFrames.  Column names that an operator
does not name in its signature are ignored, so tables may carry any others.
"""
