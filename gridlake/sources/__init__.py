"""Workbook parsers and the Spark data source."""
