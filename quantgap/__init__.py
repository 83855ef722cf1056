"""Distributional-inequality analysis on Spark DataFrames.

Groups inside cells are compared as whole distributions: exact one-dimensional
Wasserstein distances, quantile-mapping counterfactuals, decompositions,
re-weighting, bootstrap intervals and cell-level models.  Everything is a
``DataFrame -> DataFrame`` function built from DataFrame and window operations.
"""
