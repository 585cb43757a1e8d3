"""Operators for training-data pipelines over tables of documents and vectors.

Nothing outside this package imports it.  Conventions shared by every operator:

* rows whose key (``doc_id`` or ``vec_id``) is null take no part and are not returned;
* a null text counts as empty;
* repeated rows each count as a row of their own;
* only the columns an operator names are read, so extra columns never clash.
"""
