"""Incremental operators on streams of edits."""
