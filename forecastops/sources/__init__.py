"""Readers, sinks, calendar spines and the stand-in tables."""
