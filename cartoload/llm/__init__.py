"""Operators of a training-data pipeline: archive, deduplication, filters, tokens, privacy, chat, packing.

One module per operator, each with a general interface on DataFrames; ``queries`` registers the
thin queries over the given tables. Nothing outside this package imports it.
"""
