"""Readers, versioned tables and the history of analysis results."""
