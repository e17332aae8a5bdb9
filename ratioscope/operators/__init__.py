"""Operators over streams: frames of keys, ``us`` (microseconds, bigint) and values."""
