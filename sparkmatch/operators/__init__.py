"""Candidate filters, the candidate index, and enumeration engines."""
