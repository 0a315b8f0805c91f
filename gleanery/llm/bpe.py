"""BPE encoding and decoding with content-defined chunk reuse.

A gear rolling hash cuts every text into chunks.  A chunk that came up before, in whichever document, is not encoded
again: its inner words' tokens are kept by its bytes.  A cut may fall inside a word, so nothing is assumed of the ends
of a chunk: each join is repaired by widening it to the next white space on both sides, where this tokenizer ends every
token, and encoding the word in between anew.  From there on both sides agree with the encoding of the whole text.

The kept chunks and words live in the task's own process and are bounded in number; a lost executor loses only them.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm import gear
from gleanery.llm import hashing as H
from gleanery.llm.registry import query, table

CUT_BITS = 7
KEPT_CHUNKS = 6_000
KEPT_WORDS = 60_000
KEPT_PIECES = 40_000
_SPACE = b" \t\n\v\f\r"
# Words of letters that neither normalisation nor case can join or split, and signs after them; no apostrophe, which
# starts tokens of its own, and no sign of a special token.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-Þß-öø-ÿ]*)([.,!?;:%$&*#|()-]*)")


class Kept(dict):
    """What ``make`` gives for a key, kept for at most two generations of ``size``: those not asked for in one go."""

    def __init__(self, size: int, make: Callable):
        super().__init__()
        self.size, self.make, self.older = size, make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value

    def rest(self) -> None:
        """Drop the older generation."""
        self.older = {}


class ChunkEncoder:
    """Encodes whole texts; one for each tokenizer file and process."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            self.plain = _splits_plainly(json.load(file))
        self.model = self.tokenizer.model
        # Most words are known, so these are looked up without a call of Python's.
        self.pieces = Kept(KEPT_PIECES, self._piece)
        self.words = Kept(KEPT_WORDS, self._word)
        self.chunks = Kept(KEPT_CHUNKS, self._chunk)
        # How byte-level tokenizers write a byte: visible ones as themselves, the others from 256 on.
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in seen]
        self.written = {b: b for b in seen} | {b: 256 + k for k, b in enumerate(hidden)}

    def rest(self) -> None:
        """At the end of a task: a worker process lives on and may next do something else."""
        for kept in (self.chunks, self.words, self.pieces):
            kept.rest()

    def _library(self, text: str) -> tuple[list[int], list[str]]:
        encoded = self.tokenizer.encode(text, add_special_tokens=False)
        return encoded.ids, encoded.tokens

    def _piece(self, piece: str) -> tuple[bytes, str]:
        # ASCII letters and signs are written as themselves.
        written = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.written)
        tokens = self.model.tokenize(written)
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens]), " ".join([t.value for t in tokens])

    def _word(self, word: bytes) -> tuple[bytes, str]:
        """Token ids and decoded text of what lies between two white spaces."""
        text = word.decode()
        plain = self.plain and _PLAIN.fullmatch(text)
        if not plain:
            ids, tokens = self._library(text)
            return np.array(ids, "<u4").tobytes(), " ".join(tokens)
        letters, signs = plain.groups()
        if not signs:
            return self.pieces[letters.lower()]
        if not letters:
            return self.pieces[signs]
        first, second = self.pieces[letters.lower()], self.pieces[signs]
        return first[0] + second[0], f"{first[1]} {second[1]}"

    def _chunk(self, chunk: bytes) -> tuple[bytes, bytes, str, bytes] | tuple[bytes]:
        """First word's end, ids and text of the words inside, last word's beginning; or all of a chunk without space."""
        words = chunk.split()
        if len(words) < 2 and not any(s in chunk for s in _SPACE):
            return (chunk,)
        head = words.pop(0) if words and chunk[0] not in _SPACE else b""
        tail = words.pop() if words and chunk[-1] not in _SPACE else b""
        if not words:
            return head, b"", "", tail
        ids, texts = zip(*map(self.words.__getitem__, words))
        return head, b"".join(ids), " ".join(filter(None, texts)), tail

    def encode(self, data: bytes) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the decoded text, of one whole text."""
        if not self.plain:
            ids, tokens = self._library(data.decode())
            return np.array(ids, "<u4").tobytes(), self.tokenizer.decode(ids, skip_special_tokens=False)
        ids: list[bytes] = []
        texts: list[str] = []

        def join(word: bytes) -> None:
            if word:
                known = self.words[word]
                ids.append(known[0])
                texts.append(known[1])

        start, open_word = 0, b""
        for end in [*gear.cuts(np.frombuffer(data, np.uint8), CUT_BITS).tolist(), len(data)]:
            known = self.chunks[data[start:end]] if end > start else (b"",)
            start = end
            if len(known) == 1:  # no white space yet: the join grows
                open_word += known[0]
                continue
            join(open_word + known[0])
            ids.append(known[1])
            texts.append(known[2])
            open_word = known[3]
        join(open_word)
        return b"".join(ids), " ".join(filter(None, texts))


def _splits_plainly(tokenizer: dict) -> bool:
    """True where no token crosses white space and decoding puts a space between tokens: then chunks can be reused."""
    steps = (tokenizer.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = steps[0] if steps else {}
    pattern = split.get("pattern", {}).get("Regex", "")
    return bool(
        tokenizer.get("decoder") is None and tokenizer["model"]["type"] == "BPE" and split.get("type") == "Split"
        and split.get("behavior") == "Removed" and split.get("invert") and pattern.endswith(r"[^\s\p{L}\p{N}]+"))


_encoders: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


SCHEMA = "n_tokens long, ids binary, decoded string"


def encode_documents(documents: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row, ``n_tokens``, ``ids`` (little-endian 32-bit integers) and ``decoded``.

    ``path`` names a tokenizer file every executor has.  Null and empty texts have no tokens; repeated rows are
    encoded one by one; other columns are ignored; an empty table gives an empty one.
    """
    rows = documents.select(*keep, F.col("text").alias("__text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for first, stop, texts in H.slices(batch.column("__text")):
                data, offsets = texts.data.tobytes(), texts.offsets.tolist()
                made = [encoder.encode(data[a:b]) for a, b in zip(offsets, offsets[1:])]
                kept = {name: batch.column(name).slice(first, stop - first) for name in keep}
                yield pa.RecordBatch.from_pydict(kept | {
                    "n_tokens": pa.array([len(m[0]) // 4 for m in made], pa.int64()),
                    "ids": pa.array([m[0] for m in made], pa.binary()),
                    "decoded": pa.array([m[1] for m in made], pa.string())})
        encoder.rest()
        H.give_back()

    schema = T.StructType([*rows.drop("__text").schema.fields, *T._parse_datatype_string(SCHEMA).fields])
    return rows.mapInArrow(encode, schema)


@query("op10_chunked_bpe")
def chunked_bpe(spark, folder):
    import public_tokenizers

    encoded = encode_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
