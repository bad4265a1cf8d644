"""Encoding a corpus with a public byte-level BPE tokenizer, and decoding it again."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the public vocabularies lie; a parameter of every operator here.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Texts handed to the library at once; bounds what it holds, whatever the size of an Arrow batch.
TEXTS_AT_ONCE = 128


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a vocabulary file, loaded once per Python worker. Special tokens' strings are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # an executor's cores are already busy with its tasks
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@lru_cache(maxsize=1)
def byte_of_character() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table = {chr(b): b for b in printable}
    for k, b in enumerate(b for b in range(256) if b not in set(printable)):
        table[chr(256 + k)] = b
    return table


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id."""
    t, table = tokenizer(path), byte_of_character()
    out: list[bytes] = [b""] * t.get_vocab_size(with_added_tokens=True)
    for piece, k in t.get_vocab(with_added_tokens=True).items():
        out[k] = bytes(table[c] for c in piece) if all(c in table for c in piece) else piece.encode()
    return out


def byte_spans(text: str, ids: list[int], path: str) -> list[tuple[int, int]]:
    """The half-open span of code points that each token touches; a character split over tokens belongs to all of them."""
    pieces = token_bytes(path)
    owner: list[int] = []  # of each byte, its character
    for k, c in enumerate(text):
        owner.extend([k] * len(c.encode("utf-8", "surrogatepass")))
    spans, at = [], 0
    for i in ids:
        n = len(pieces[i])
        spans.append((owner[at], owner[at + n - 1] + 1) if n else (0, 0))
        at += n
    return spans


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json", directory: str = TOKENIZER_DIR, offsets: bool = False) -> DataFrame:
    """(key, ids[, starts, ends]): the token ids of each whole text, without special tokens.

    A narrow map over Arrow batches: no shuffle, one row out for each row in, memory bounded by a few texts. An empty
    and a null text both give an empty list. A null key stays null; repeated rows give repeated rows (documents' keys
    are unique). Other columns are ignored. With ``offsets``, starts and ends hold each token's span of code points;
    spans overlap where tokens split one character.
    """
    path = os.path.join(directory, vocabulary)
    key_type = documents.schema[key].dataType.simpleString()
    extra = ", starts array<int>, ends array<int>" if offsets else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, ints = tokenizer(path), pa.list_(pa.int32())
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                texts = [x or "" for x in part.column(1).to_pylist()]
                ids = [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
                columns = [part.column(0), pa.array(ids, ints)]
                if offsets:
                    spans = [byte_spans(x, i, path) for x, i in zip(texts, ids)]
                    columns += [pa.array([[s[k] for s in one] for one in spans], ints) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "ids", "starts", "ends"][: len(columns)])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {key_type}, ids array<int>{extra}")


def decode(encoded: DataFrame, key: str = "doc_id", vocabulary: str = "byte_bpe_50k.json", directory: str = TOKENIZER_DIR) -> DataFrame:
    """(key, text): the text of each list of ids, by joining the tokens' bytes before reading them as UTF-8.

    So a character split over tokens comes back whole; bytes that are no UTF-8 (a list cut inside a character) become
    U+FFFD. A null or empty list gives an empty text; unknown ids raise.
    """
    path = os.path.join(directory, vocabulary)
    key_type = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = token_bytes(path)
        for batch in batches:
            texts = [b"".join([pieces[i] for i in ids or ()]).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {key_type}, text string")
