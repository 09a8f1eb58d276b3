"""Operators over DataFrames: filters, entries and indexes, id sets and merges, threads, results, tables, cues."""
