"""Job queue, rate limits and incremental indexing, in batch and Structured Streaming form."""
