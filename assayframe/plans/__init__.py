"""Whole workflows: evaluate, generate, tune."""
