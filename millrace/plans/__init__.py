"""Whole plans: runners, dataset pipelines and the registered queries."""
