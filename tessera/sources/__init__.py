"""Readers and writers: conversations, questions, logs, reports."""
