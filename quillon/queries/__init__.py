"""Every query over the driver's tables, beside the SQL that it is held against."""

from __future__ import annotations

from quillon.queries import bio, clustering, embedding, learning, markov, mining, network, sources, streams, vectors
from quillon.queries._registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "bio", "clustering", "embedding", "learning", "markov", "mining", "network", "sources", "streams", "vectors"]
