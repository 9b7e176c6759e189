"""Token counts by the whole-token shortcut.

Which strings of a byte-level vocabulary encode alone as one token is proved once, by merging each of them. Pieces of a
text that are such strings count 1 without a merge; the others are merged, each once per worker while remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.bpe import ByteBpe, Encoder, chunks, split

_ENCODERS: dict[str, Encoder] = {}  # of this worker, by the vocabulary's name


def count_texts(texts: list[str], encoder: Encoder, specials: tuple[str, ...] = ()) -> np.ndarray:
    """Tokens of each text; each string of ``specials`` in it is one token, the longer one first."""
    out = np.zeros(len(texts), np.int64)
    cut = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
    for group in chunks(texts):
        pieces, ends = [], []
        for n in group:
            between = cut.split(texts[n]) if cut and cut.search(texts[n]) else [texts[n]]
            out[n] = len(between) - 1
            for part in between:
                pieces += split(part)
            ends.append(len(pieces))
        rows = encoder.rows(pieces)
        total = np.append(0, np.cumsum(encoder.counts[rows]))
        out[group] += np.diff(total[np.append(0, ends)])
    return out


def count_tokens(docs: DataFrame, path: str, text: str = "text", into: str = "_n_tokens", special_tokens: bool = True) -> DataFrame:
    """``docs`` with a long column ``into``: the tokens of the whole text, as the file's library counts them.

    ``path`` is a file of plain byte-level BPE, read on the driver only; its rules and proved whole tokens are broadcast
    and don't grow with the data. With ``special_tokens`` their strings inside texts are one token each, else ordinary
    text. Null and empty texts have 0 tokens. Rows are counted one by one: repeated rows get equal counts, an empty table
    stays empty, other columns pass through. A word of any length takes n log n steps.
    """
    bpe = ByteBpe.load(path)
    shipped = docs.sparkSession.sparkContext.broadcast((path, bpe, bpe.whole))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        name, rules, whole = shipped.value
        if name not in _ENCODERS:
            _ENCODERS[name] = Encoder(rules.encode_pieces, whole)
        for texts in batches:
            yield pd.Series(count_texts([t or "" for t in texts], _ENCODERS[name], rules.specials if special_tokens else ()))

    return docs.withColumn(into, count(F.col(text)))
