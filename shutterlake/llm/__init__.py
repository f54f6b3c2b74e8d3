"""Operators of a training-data pipeline: filters, duplicate removal, decontamination, mixing, counts."""
