from shelfwise.streaming.ingest import (
    compact_grains,
    read_ingested,
    read_quarantine,
    snapshot_stream,
    start_ingest,
)

__all__ = ["compact_grains", "read_ingested", "read_quarantine", "snapshot_stream", "start_ingest"]
