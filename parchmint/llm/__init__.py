"""Training-data operators: sharding, mixing, decontamination, scoring, scanning and near-duplicate joins.

Nothing outside this folder imports it; deleting it leaves the rest of the library whole.
"""
