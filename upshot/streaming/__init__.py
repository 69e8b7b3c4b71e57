"""Streaming.

The analyses this library rebuilds are batch analyses over warehouse
snapshots: there is no watermark, event-time window, state or late data in
any of them, so no streaming operator is provided. Batch operators accept
any DataFrame, so a caller can apply them per micro-batch via
``foreachBatch`` if a refreshed panel arrives as a stream.
"""
