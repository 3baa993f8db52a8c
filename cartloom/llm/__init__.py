"""Preparation of training data: splits, pairs, overlaps, packing, mixing, languages."""
