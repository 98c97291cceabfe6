"""Token ids of texts for the token-file operators (rank-file vocabularies)."""

from __future__ import annotations

import base64

import numpy as np

from strata.llm.bpe import PRETOKEN, load_vocab
from strata.llm.common import ships_by_value

__all__ = ["encoder", "id_type", "load_vocab"]


def encoder(ranks: bytes):
    """``text -> array of ids`` for the content of a rank file. Texts are taken
    as ordinary text; null has no tokens. Also returns the number of ids."""
    import tiktoken

    table = {base64.b64decode(t): int(r) for t, r in (line.split() for line in ranks.splitlines() if line)}
    enc = tiktoken.Encoding("ranks", pat_str=PRETOKEN, mergeable_ranks=table, special_tokens={})

    def encode(text: str | None) -> np.ndarray:
        return enc.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.uint32)

    return encode, 1 + max(table.values())


def id_type(n_ids: int) -> np.dtype:
    """Little-endian ids of 2 bytes if they fit, else 4."""
    return np.dtype("<u2" if n_ids <= 1 << 16 else "<u4")


ships_by_value(__name__)
