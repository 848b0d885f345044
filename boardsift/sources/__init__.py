"""Readers, generators and writers of boards."""
