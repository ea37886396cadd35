"""Readers, generators and writers of points."""
