"""Operators of a training-data pipeline: scoring, deduplication, decontamination,
mixing, quality, secrets, fingerprints, URL, license and personal-data scans.

Nothing else in the library imports this subpackage; its queries are in
``ebbflow.llm.queries``.
"""
