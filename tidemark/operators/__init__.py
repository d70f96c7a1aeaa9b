"""Relational, window and signal operators over track tables."""
