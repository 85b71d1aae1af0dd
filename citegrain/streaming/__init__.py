"""The request log as a stream: totals, windowed metrics, answer reuse and ingest."""
