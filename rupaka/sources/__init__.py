"""Readers of lexicons, rule files and treebanks."""
