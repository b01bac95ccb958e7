"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.session import ship_package

TOKENIZER = os.environ.get("TALLYWEIR_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
_LOADED: dict = {}


def load_tokenizer(path: str):
    """The tokenizer of a file, once per worker process. Special tokens in a text count as ordinary text."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.encode_special_tokens = True
        _LOADED[path] = loaded
    return _LOADED[path]


def count_tokens(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = TOKENIZER, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the columns ``keep``, n_tokens) for every text that is not null or blank; whole texts are read."""
    ship_package(documents.sparkSession)
    source = documents.where(F.col(text).isNotNull() & F.col(text).rlike(r"(?U)\S")).select(doc_id, *keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in (doc_id, *keep)) + ", n_tokens bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = load_tokenizer(path)
        for pdf in batches:
            # copies of a text in one batch are counted once
            code, texts = pd.factorize(pdf["__text"])
            sizes: list[int] = []
            for at in range(0, len(texts), 256):
                sizes += [len(e.ids) for e in tokenizer.encode_batch_fast(list(texts[at : at + 256]), add_special_tokens=False)]
            yield pdf.drop(columns="__text").assign(n_tokens=np.asarray(sizes, dtype=np.int64)[code])

    return source.mapInPandas(run, schema)
