"""Operators for text corpora: scoring, deduplication, decontamination, packing and sharding."""
