"""Operators for preparing training corpora at scale.

Ids (``doc_id``, ``item_id``, ``page_id``) are whole numbers; an id of another
type that isn't one, such as a text without digits, counts as null.
"""
