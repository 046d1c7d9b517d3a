"""Relational operators of the analysis: matching, annotation, scoring, rule merging, report aggregates."""
