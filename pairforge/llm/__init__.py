"""Operators of a training-data pipeline: dedup, quality, language, decontamination, scoring, tokens, archives.

``queries`` binds each to the shared tables. Nothing outside this subpackage imports it.
"""
