"""Readers and writers of market records, facts, panels and reports."""
