"""Part of the portfolio engine."""
