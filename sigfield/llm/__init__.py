"""Operators of a training-data pipeline: token output, BPE, quality, deduplication, search, personal
data, secrets, decontamination and token counts. Nothing else in the library imports this package."""
