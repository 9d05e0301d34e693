"""Readers of notes, atoms, page heads, logs and journals; writers of stage tables and pages."""
