"""Workbooks as a stream."""
