"""Streaming forms of operators that suit an unbounded input."""
