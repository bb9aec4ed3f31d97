"""Operators that prepare text for training language models. Nothing else in sluice imports this subpackage."""
