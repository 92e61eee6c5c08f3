"""Whole workflows: labelling a run, building and auditing a campaign; the registered queries."""
