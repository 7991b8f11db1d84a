"""Relational operators over lines, blocks, records, issues and decisions."""
