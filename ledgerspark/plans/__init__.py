"""Decisions, audits and reports over recorded observations."""
