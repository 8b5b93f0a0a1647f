"""Readers of change packages, genesis allocations and probe samples; histories from event tables."""
