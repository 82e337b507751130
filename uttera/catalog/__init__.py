"""Importing this package fills the registry."""

from uttera.catalog import batches, ctc, decoding, evaluate, language, prepare, storage, streams, texts, views  # noqa: F401
from uttera.catalog.base import REGISTRY

__all__ = ["REGISTRY"]
