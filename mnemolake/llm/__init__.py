"""Training-data operators: search, packing, deduplication, toxicity, licences, WARC and mixing.

Nothing outside this subpackage imports it. Every operator takes DataFrames, selects the columns it
needs by name (so extra columns never clash) and returns a new DataFrame.
"""
