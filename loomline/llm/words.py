"""Words of whole Arrow batches as numpy arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

GAP = r"[^\p{L}\p{N}]+"


def split_words(texts: pa.Array, gap: str = GAP, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words of the batch and the row of each. Null texts have none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    lists = pc.split_pattern_regex(texts, gap)
    flat, rows = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), rows.filter(full).to_numpy(zero_copy_only=False)


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same on every machine; a word is hashed once a batch."""
    coded = words.dictionary_encode()
    hashes = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    return hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
