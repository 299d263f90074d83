"""Cambium: curation, de-duplication, selection and scoring of tables on Spark."""
