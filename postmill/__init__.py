"""Postmill: job-posting analytics as Spark table operators."""
