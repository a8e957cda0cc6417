"""Operators for large training-data pipelines: dedup, scoring, language, packing, decontamination, archives, tokens."""
