"""Registered queries: each operator over tables derived from the given ones, with SQL to compare against."""
