"""The query language has no streams; nothing is needed here."""
