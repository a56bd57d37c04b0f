"""Whole detections: the pipeline, replays of history, and the registered queries."""
