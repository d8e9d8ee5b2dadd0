"""Readers, writers and the audits that run over files."""
