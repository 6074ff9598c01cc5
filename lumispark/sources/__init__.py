"""Readers and writers of image stacks and measurement tables."""
