"""Operators over tables of files, objects, trees, histories and stores."""
