"""Streaming entry points (Structured Streaming)."""

from logweave.streaming.matcher import match_micro_batch, start_matcher, unmatched_pattern_counts

__all__ = ["match_micro_batch", "start_matcher", "unmatched_pattern_counts"]
