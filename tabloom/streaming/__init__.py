"""Streams: fitted projections run unchanged; daily aggregates get a watermark."""
