"""Splitting, preprocessing, MLlib models, metrics and explanations."""
