"""Registered queries: name -> (callable of (spark, sf_dir), SQL or None)."""

from __future__ import annotations

from . import corpus, evaluation, retrieval, structure, text

ALL = {**text.QUERIES, **retrieval.QUERIES, **evaluation.QUERIES, **structure.QUERIES, **corpus.QUERIES}
