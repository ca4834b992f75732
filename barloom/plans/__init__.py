"""Queries by inventory id; importing all_plans registers those of every module."""
