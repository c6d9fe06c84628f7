"""Operators for building training corpora from a `documents` table at cluster scale."""
