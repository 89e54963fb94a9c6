"""Terms of texts by Arrow kernels: A-Z lower-cased, then maximal runs of letters, digits and non-ASCII characters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text: A-Z are gone


def dictionary_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms, term number of every occurrence in order, occurrences of every text); a null text has none."""
    split = pc.split_pattern_regex(pc.ascii_lower(texts.fill_null("")), pattern=SEPARATORS)
    flat = pc.list_flatten(split)
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(flat)
    terms, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    # a text that starts or ends with a separator, or is empty, yields empty strings there
    empty = pc.index(terms, pa.scalar("", terms.type)).as_py()
    if empty < 0:
        return terms, index.astype(np.int64), sizes
    real = index != empty
    owner = np.repeat(np.arange(len(sizes)), sizes)[real]
    return terms, index[real].astype(np.int64), np.bincount(owner, minlength=len(sizes))
