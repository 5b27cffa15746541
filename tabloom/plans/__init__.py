"""Fitted artefacts: parameter tables that replay as projections, and the stores that keep them."""
