"""Strategies, annotators, prompts and whole runs."""
