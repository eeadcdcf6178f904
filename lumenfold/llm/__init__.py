"""Operators that a large text-training pipeline needs beside the journal analytics.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries only
where it is there.
"""
