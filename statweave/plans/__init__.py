"""Reusable distributed building blocks (ranks, quantiles, cross products...)."""
