"""Indexes, candidates, features, scores, rankings."""
