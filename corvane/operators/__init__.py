"""Operators over DataFrames: scoring, search, fusion, graphs, topics, workflows."""
