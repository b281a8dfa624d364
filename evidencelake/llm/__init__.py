"""Operators of a training-data pipeline. Nothing else in evidencelake imports this subpackage."""
