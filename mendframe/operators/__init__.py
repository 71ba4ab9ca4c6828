"""Operators: profile, detect, repair, validate, score, query, inject, report."""
