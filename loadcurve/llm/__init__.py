"""Training-data operators: fingerprints, classifiers, extraction, joins, filters, mixing.

Each module holds one operator with a general interface; ``queries`` registers
the thin queries over the test tables.  Nothing else in the library imports
this subpackage.
"""
