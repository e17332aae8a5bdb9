"""Operators over unbounded streams.  The batch operators' results are reached as data arrive."""
