"""Spark jobs that prepare parallel code corpora and judge translation models."""

from corpuslab.config import CorpusSpec

__all__ = ["CorpusSpec"]
