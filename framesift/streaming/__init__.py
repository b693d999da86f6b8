"""Structured Streaming: result logs as they are written. Beyond the batch operators."""
