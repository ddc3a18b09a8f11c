"""loomlog: session-log analytics expressed as Spark DataFrame transforms.

Transcripts of coding agents (JSON Lines) become rows of one numbered line
table; checks, statistics, rewrites and monitoring are joins, aggregations and
bounded windows over that table.
"""

from loomlog.session import configure

__all__ = ["configure"]
