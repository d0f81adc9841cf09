"""Readers: report files, stored tables, JSON stores and item exports."""
