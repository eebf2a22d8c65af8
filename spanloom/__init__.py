"""spanloom: finding, governing and measuring sensitive data in text, on Spark."""
