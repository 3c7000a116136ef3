"""Linkage of streams against static targets."""
