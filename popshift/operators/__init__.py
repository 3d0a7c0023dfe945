"""Profiles, drift, segments, scoring, generators and trends: DataFrame in, DataFrame out."""
