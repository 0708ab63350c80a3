"""codelens: qualitative-coding agreement analytics on Spark."""
