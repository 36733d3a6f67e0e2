"""Size bound of lookup joins."""

from __future__ import annotations

# Lookup tables (lexicons, topic word weights) at or below this many rows, which are counted first, are broadcast; larger
# ones are looked up block by block (``operators.blocks``).  A broadcast passes the driver, whose memory bounds it.
DEFAULT_MAX_BROADCAST_ROWS = 200_000
