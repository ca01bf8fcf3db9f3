"""Training-data operators: licence scan, SimHash and line and suffix dedup,
PII, mixing, sharding, decontamination, chat formatting, quality rules.

Nothing else in the library imports this subpackage; the driver contract adds
its queries when it is present.
"""
