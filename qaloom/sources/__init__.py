"""Readers and writers for the file shapes of a question/answer dataset."""
