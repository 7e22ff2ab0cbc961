"""Hashed character n-grams of words, as training rows and as fast linear scores.

A word is written between two boundary bytes, and its n-grams are hashed into
``2**bits`` rows. A linear score of a bag of n-grams is a sum over words, so at
scoring time every row of the table is reduced to the few numbers that the
classifier takes from it, distinct words of a slice are looked up once, and
texts only add up their words.
"""

from __future__ import annotations

import numpy as np

from .text import Slice, mix, prefix_hash, span_hash

BOUNDARY = 32


def bounded_words(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: the distinct words' bytes, each between boundaries, their offsets, every word's index among them, and the first word of each document."""
    start, end, first = part.words()
    if not len(start):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64), first
    word = span_hash(prefix_hash(part.data), start, end)
    _, one, index = np.unique(word, return_index=True, return_inverse=True)
    start, size = start[one], end[one] - start[one]
    offset = np.append(0, np.cumsum(size + 2))
    out = np.full(offset[-1], BOUNDARY, dtype=np.uint8)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(offset[:-1] + 1, size) + at] = part.data[np.repeat(start, size) + at]
    return out, offset, index, first


def ngrams(data: np.ndarray, offset: np.ndarray, sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of all n-grams within each word and, as an n-gram of its own, of each whole word; and the word of each. n counts bytes."""
    prefix = prefix_hash(data)
    word = np.repeat(np.arange(len(offset) - 1), np.diff(offset))
    last = offset[1:][word] if len(word) else word
    rows, owner = [], []
    for n in sizes:
        at = np.flatnonzero(np.arange(len(data)) + n <= last)
        rows.append(span_hash(prefix, at, at + n))
        owner.append(word[at])
    whole = span_hash(prefix, offset[:-1], offset[1:])
    rows.append(mix(whole + np.uint64(1)))
    owner.append(np.arange(len(offset) - 1))
    return (np.concatenate(rows) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(owner)


def word_scores(data: np.ndarray, offset: np.ndarray, sizes: tuple[int, ...], bits: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word, the sums of the table's rows over its n-grams, a column each; and how many n-grams it has."""
    rows, owner = ngrams(data, offset, sizes, bits)
    n = len(offset) - 1
    out = np.zeros((n, table.shape[1]))
    for k in range(table.shape[1]):
        out[:, k] = np.bincount(owner, weights=table[rows, k], minlength=n)
    return out, np.bincount(owner, minlength=n)
