"""Micro-batch forms of syncing and uploading: an extension."""
