"""Spark jobs for combinatorial categorical data: landscapes, contrasts, selections, audits."""
