"""Streams: keyed upserts and clocks by micro-batch."""
