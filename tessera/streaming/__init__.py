"""Structured Streaming landing: each micro-batch goes through the keyed landing with guards."""

from tessera.streaming.land import land_stream

__all__ = ["land_stream"]
