"""Findings, their roll-up to a risk, and the registered queries."""
