"""Operators: deltas and watermarks, guards and landing, checks, verification, profiling, closed reads."""
