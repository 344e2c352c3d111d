"""Facility-location models as iterative distributed jobs."""
