"""Sinks: the stored form of collections, and exports of hits."""
