"""Operators on DataFrames: subword models, lookups, logits, generation, merges."""
