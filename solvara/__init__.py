"""Solvara: credit-portfolio analytics and corpus preparation as Spark jobs."""
