"""Readers, writers, staging and the star-schema adapter."""
