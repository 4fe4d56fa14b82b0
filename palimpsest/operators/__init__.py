"""Operators over turns, spans, facts, requests and passes."""
