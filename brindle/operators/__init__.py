"""Statements that change tables: every change is a new snapshot."""
