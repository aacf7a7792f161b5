"""Operators of a training-data pipeline (language ID, sharding, substring and
near-duplicate detection, token files, toxicity, URL lists, decontamination,
top-k search, source mixing) and the queries that apply them."""
