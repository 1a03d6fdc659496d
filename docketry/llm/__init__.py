"""Operators for training data: leakage, splits, pair defects, quotas, scan noise, packing, mixing, look-alikes."""
