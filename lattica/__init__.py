"""Lattica: analytics over versioned documents and text corpora, written for Spark."""
