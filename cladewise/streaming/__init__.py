"""Evaluation of trees as they arrive."""

from cladewise.streaming.trees import stream_pair_summary

__all__ = ["stream_pair_summary"]
