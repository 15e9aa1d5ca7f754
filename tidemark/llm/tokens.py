"""Token ids of texts by a public tokenizer, in Arrow batches.

The tokenizer cuts a text into pieces (words, digits, runs of marks) and encodes each by itself. Texts are split at white
space, over which it never joins anything, and a block of texts is reduced to its distinct chunks, each encoded once. Ids
of pieces are remembered for the life of a worker. Plain letters, digits and marks are cut
into pieces here, and only new pieces go to the tokenizer's model; any other chunk goes through the whole tokenizer. The
ids are those of the tokenizer on the whole text (``tests/llm`` compare them).
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark.llm.common import give_back, worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOCABULARY = "word_bpe_49k.json"
#: Id that ends a document; pieces that a worker remembers (and a quarter as many chunks of several).
END, REMEMBERED = 1, 400_000
#: Bytes of text that are reduced to distinct chunks at a time.
BLOCK = 12 << 20
#: The same where pieces are cut, whose rows take memory of their own.
CUT = 4 << 20

#: Fixed values of the tokenizer's format: its white space, plain text, and the pieces of plain text in lower case.
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")
MARKS = (r"([a-zß-öø-ÿ0-9])([.,;:!?]+[\t-\r ])", r"\1 \2")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it is printable, else the next free one above 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Pieces(dict):
    """Ids of pieces of plain text, as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model, self.letters, self.chunks = self.whole.model, byte_letters(), {}
        with open(path) as f:
            # Strings such as an end marker may be tokens of their own, anywhere in a text.
            self.added = [x["content"] for x in json.load(f)["added_tokens"]]

    def __missing__(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        if len(self) < REMEMBERED and len(piece) < 100:
            self[piece] = ids
        return ids

    def of_chunk(self, chunk: str) -> bytes:
        if (ids := self.get(chunk)) is None and (ids := self.chunks.get(chunk)) is None:
            if not PLAIN.fullmatch(chunk):
                return self.by_tokenizer(chunk)
            pieces = PIECES.findall(chunk.lower())
            ids = b"".join(map(self.__getitem__, pieces))
            if len(pieces) > 1 and len(self.chunks) < REMEMBERED // 4 and len(chunk) < 100:
                self.chunks[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if any(x in text for x in self.added):
            return self.by_tokenizer(text)
        return b"".join(map(self.of_chunk, SPACES.split(text)))

    def reduced(self, texts: list[str]) -> tuple[list[bool], list[bytes], np.ndarray, np.ndarray]:
        """Which texts are plain; ids of their distinct chunks; the chunks of all of them in order; each text's bounds there."""
        plain = [bool(PLAIN.fullmatch(t)) and not any(x in t for x in self.added) for t in texts]
        block = pa.array([t.lower() if p else "" for t, p in zip(texts, plain, strict=True)], pa.large_string())
        # Marks that end a word are pieces of their own; apart from it, fewer chunks differ.
        chunks = pc.ascii_split_whitespace(pc.replace_substring_regex(block, *MARKS))
        found = chunks.flatten().dictionary_encode()
        known = list(map(self.of_chunk, found.dictionary.to_numpy(zero_copy_only=False)))
        return plain, known, found.indices.to_numpy(), chunks.offsets.to_numpy()

    def of_block(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text."""
        plain, known, at, offsets = self.reduced(texts)
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        every, start, count = np.frombuffer(b"".join(known), "<u4"), np.cumsum(size) - size, size[at]
        ends = np.cumsum(count)
        ids = every[
            np.repeat((start[at] - ends + count).astype(np.int32), count)
            + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
        ]
        bounds = np.concatenate([[0], ends])[offsets]
        for text, p, a, b in zip(texts, plain, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield ids[a:b].tobytes() if p else self.ids(text)

    def counts(self, texts: list[str]) -> Iterator[int]:
        """Number of ids of each text."""
        plain, known, at, offsets = self.reduced(texts)
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ends = np.concatenate([[0], np.cumsum(size[at])])[offsets]
        for text, p, n in zip(texts, plain, np.diff(ends).tolist(), strict=True):
            yield n if p else len(self.ids(text)) // 4

    def by_tokenizer(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def known_pieces(vocabulary: str) -> Pieces:
    cache = worker_cache()
    if vocabulary not in cache:
        cache[vocabulary] = Pieces(vocabulary_path(vocabulary))
    return cache[vocabulary]


def blocks(batch: pa.Array, size: int = BLOCK) -> Iterator[list[str]]:
    """The texts of a batch, null as empty, some bytes at a time."""
    block, held = [], 0
    for value in batch:
        block.append(text := value.as_py() or "")
        held += len(text)
        if held > size:
            yield block
            block, held = [], 0
    yield block


PIECE = "struct<piece: int, start: long, length: int, ids_crc32: long, ids: binary>"


def pieces(size: int, vocabulary: str = VOCABULARY, end: int = END, with_ids: bool = False):
    """Expression of a text: its ids and ``end``, cut into pieces of at most ``size``.

    ``ids`` are little-endian 32-bit numbers, null unless asked for; ``ids_crc32`` is their checksum.
    """
    last = array("I", [end]).tobytes()
    kind = pa.struct(
        [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
    )

    def cut(ids: bytes) -> list[dict]:
        from zlib import crc32

        parts = [ids[at : at + 4 * size] for at in range(0, len(ids), 4 * size)]
        return [
            {"piece": k, "start": k * size, "length": len(p) // 4, "ids_crc32": crc32(p), "ids": p if with_ids else None}
            for k, p in enumerate(parts)
        ]

    @F.arrow_udf(f"array<{PIECE}>")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = known_pieces(vocabulary)
        for batch in texts:
            yield pa.array([cut(ids + last) for block in blocks(batch, CUT) for ids in known.of_block(block)], pa.list_(kind))
            give_back()

    return of
