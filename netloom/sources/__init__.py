"""Readers and writers: sensor logs, split-ready CSV, annotations, JSON lines, file inventories, captures."""
