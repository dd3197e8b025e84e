"""Keyed table reconciliation as Spark plans."""
