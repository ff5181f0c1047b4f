"""Operators of a training-data pipeline: chat formatting, personal data,
language labels, quality rules, near-duplicates, decontamination, secrets,
toxicity, packed token matrices and packing.  Nothing else in the library
imports this subpackage."""
