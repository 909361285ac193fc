"""Operators on detections, tracks, intervals, votes, vectors and labels."""
