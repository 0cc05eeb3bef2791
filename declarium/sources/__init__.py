"""Scans: file trees, build declarations, package metadata, notices, archives, tool output."""
