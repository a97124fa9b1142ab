"""Relational de-identification on Spark: profile, classify, plan, rewrite, check, publish."""
