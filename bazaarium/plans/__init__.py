"""Declarative plans: quality checks, the model, marts, questions, headlines, measures."""
