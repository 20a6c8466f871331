"""Operators for training-data pipelines (deduplication, decontamination,
personal data, quality, toxicity, chat formatting, packing).

Nothing else in the library imports this package.
"""
