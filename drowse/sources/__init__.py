"""Readers and writers of series, events, folds and detections."""
