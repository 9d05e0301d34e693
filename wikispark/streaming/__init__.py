"""The row-level operators over a stream of notes."""
