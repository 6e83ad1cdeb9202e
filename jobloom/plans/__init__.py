"""Composed jobs: each registered query is a lazy DataFrame over the driver tables."""
