"""Training-data operators over whole corpora (language ID, near-duplicate joins, mixing, sharding, ...).

Each module holds one operator with its own general interface; ``queries``
applies them to the test tables. Nothing outside this package imports it.
"""
