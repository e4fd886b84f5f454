"""Distributed plan recipes shared by several operators."""
