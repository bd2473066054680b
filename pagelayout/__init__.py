"""Corpus-scale page-layout, translation-alignment and job-telemetry operators on Spark."""
