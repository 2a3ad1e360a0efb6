"""Compiled plans: tokenizers and chat templates."""
