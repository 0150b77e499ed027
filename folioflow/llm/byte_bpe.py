"""Byte-level BPE: texts to token ids with offsets, and ids back to bytes and texts."""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import table
from folioflow.llm.words import blocks

#: The characters that `\\s` stands for in patterns (White_Space of Unicode).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space and what follows it up to the next white space; or white space at the end.
_PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_CUT = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
#: Characters of a text that are cut into pieces at once, and characters of pieces that the library encodes at once.
SEGMENT, BATCH = 1 << 18, 1 << 16
#: Strings of up to so many characters are remembered by a worker, so many of them in each of two generations.
SHORT, REMEMBERED = 48, 3 << 17


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones of Latin-1 for themselves, the rest from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


def _last_parts(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What is left of a token's bytes before the merge that would make the token itself."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, i = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)))
        if rank == len(ranks):
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """The vocabulary as a tokenizer of the tokenizers library.

    Ranks name merged tokens, the library wants the merged pairs. Merges go by rank and from left to right, so what
    happens inside the bytes of a future token doesn't depend on what is around them; each token can only come from the
    one pair that its own bytes end in, and that pair gets its rank. A match that is a token as a whole is taken as it is.
    """
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    if sorted(ranks.values()) != list(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must run from 0 without gaps and hold every byte")
    chars = byte_characters()
    shown = {token: "".join(chars[b] for b in token) for token in ranks}
    pairs = (_last_parts(token, ranks) for token in sorted(ranks, key=ranks.get) if len(token) > 1)
    merges = [(shown[p[0]], shown[p[1]]) for p in pairs if len(p) == 2]
    made = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), behavior="removed", invert=True),  # only what matches is encoded
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return made.to_str()


class _Encoder:
    """The tokenizer of a Python worker, with the ids of pieces that it has met; Spark's tasks are the threads.

    Ids and offsets are the bytes of 32-bit integers: these join fast and cost no walks of Python's garbage collector.
    With offsets a piece has three such, else one. When enough recent pieces are kept they become the old ones, and the
    older go."""

    def __init__(self, json: str, offsets: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.made, self.offsets, self.recent, self.old = Tokenizer.from_str(json), offsets, {}, {}

    def _learn(self, pieces: list[str]) -> Iterator[bytes | tuple[bytes, ...]]:
        """Encode pieces, a bounded number of characters at a time, as the library holds some hundred bytes a token."""
        encode = self.made.encode_batch if self.offsets else self.made.encode_batch_fast
        sizes = np.cumsum([len(p) for p in pieces]) // BATCH
        edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(pieces)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            for e in encode(pieces[a:b], add_special_tokens=False):
                ids = array("i", e.ids).tobytes()
                yield (ids, *(array("i", [x[k] for x in e.offsets]).tobytes() for k in (0, 1))) if self.offsets else ids

    def _found(self, pieces: list[str]) -> list:
        found = list(map(self.recent.get, pieces))
        if missing := dict.fromkeys([p for p, f in zip(pieces, found, strict=True) if f is None]):
            made = {p: f for p in missing if (f := self.old.get(p)) is not None}
            fresh = [p for p in missing if p not in made]
            made.update(zip(fresh, self._learn(fresh), strict=True))
            self.recent.update([(p, f) for p, f in made.items() if len(p) <= SHORT])
            if len(self.recent) > REMEMBERED:
                self.old, self.recent = self.recent, {}
            found = [made[p] if f is None else f for p, f in zip(pieces, found, strict=True)]
        return found

    def __call__(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of consecutive pieces on end; with offsets also where each token starts and ends."""
        found = self._found(pieces)
        if not self.offsets:
            return [np.frombuffer(b"".join(found), np.int32)]
        ids, *spans = (np.frombuffer(b"".join([f[k] for f in found]), np.int32) for k in range(3))
        starts = np.cumsum([0, *map(len, pieces)])[:-1].astype(np.int32)
        base = np.repeat(starts, [len(f[0]) // 4 for f in found])
        return [ids, *(x + base for x in spans)]


@lru_cache(maxsize=4)
def _encoder(json: str, offsets: bool) -> _Encoder:
    return _Encoder(json, offsets)


def segments(text: str, size: int = SEGMENT) -> Iterator[tuple[int, str]]:
    """(start, part) of a text, cut only where white space follows another character, at the first such place `size`
    characters on."""
    a = 0
    while len(text) - a > size and (cut := _CUT.search(text, a + size)):
        yield a, text[a : cut.start()]
        a = cut.start()
    yield a, text[a:]


def _encode(batches: Iterator[pa.RecordBatch], json: str, offsets: bool, at_space: bool) -> Iterator[pa.RecordBatch]:
    encoder, names = _encoder(json, offsets), ["ids", "starts", "ends"] if offsets else ["ids"]
    for batch in blocks(batches, "_text"):
        columns = [[] for _ in names]
        for text in batch.column("_text").to_pylist():
            got = [[np.zeros(0, np.int32)] for _ in names]
            for start, part in segments(text or "") if at_space else [(0, text or "")]:
                for k, v in enumerate(encoder(_PIECE.findall(part) if at_space else [part])):
                    got[k].append(v + np.int32(start) if k else v)
            for k, v in enumerate(got):
                columns[k].append(np.concatenate(v))
        keep = [c for c in batch.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *map(_lists, columns)], [*keep, *names])


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    bounds = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(rows), pa.int32()))


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text",
    offsets: bool = False, at_space: bool = True,
) -> DataFrame:
    """Token ids of each whole text, each match of `pattern` encoded for itself, without special tokens.

    Returns the id column and ids (array of int), with `offsets` also starts and ends: the characters of the text that
    each token stands for; tokens that share a character give that character, so spans may overlap. With
    `at_space` a text is encoded in pieces that begin where white space follows another character, and each piece that
    a worker remembers only once. That needs a pattern with no match across such a place and none that looks behind it,
    as in the usual ones; for others set it False. Null and empty texts have empty arrays. Rows are taken as
    they are, whatever their ids repeat; other columns aren't read. The vocabulary is read on the driver and broadcast:
    its size is that of the rank file.
    """
    json = docs.sparkSession.sparkContext.broadcast(tokenizer_json(ranks, pattern))
    names = ["ids", "starts", "ends"] if offsets else ["ids"]
    schema = T.StructType([docs.schema[id_col], *[T.StructField(n, T.ArrayType(T.IntegerType())) for n in names]])
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return rows.mapInArrow(lambda it: _encode(it, json.value, offsets, at_space), schema)


def _tables(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The byte table backwards: the bytes of all tokens on end, and where each begins."""
    tokens = sorted(ranks, key=ranks.get)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)])


def token_bytes(ids: np.ndarray, letters: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The bytes of many tokens on end."""
    n = first[ids + 1] - first[ids]
    ends = np.cumsum(n)
    return letters[np.arange(ends[-1] if len(n) else 0) + np.repeat(first[ids] - ends + n, n)]


def _decode(batches: Iterator[pa.RecordBatch], letters: np.ndarray, first: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            values = batch.column("_ids")[row].values
            ids = np.zeros(0, np.int64) if values is None else values.drop_null().to_numpy().astype(np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(first) - 1):
                raise ValueError(f"no token has the id {ids.min() if ids.min() < 0 else ids.max()}")
            raw = b"".join(token_bytes(ids[a : a + SEGMENT], letters, first).tobytes() for a in range(0, len(ids), SEGMENT))
            keep = [c for c in batch.schema.names if c != "_ids"]
            out = [pa.array([raw], pa.binary()), pa.array([raw.decode("utf-8", "replace")], pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(row, 1) for c in keep], *out], [*keep, "decoded", "decoded_text"])


def decode(tokens: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """The rows of `tokens` with decoded, the bytes that the ids in `ids_col` stand for, and decoded_text.

    Characters that several tokens share come together, as bytes are joined before they are read as UTF-8; where a
    list begins or ends inside a character (a window cut from a text), decoded has its bytes and decoded_text has
    U+FFFD for them. Null lists decode to nothing, null ids are left out, unknown ids are an error.
    """
    if clash := {"decoded", "decoded_text", "_ids"} & set(tokens.columns):
        raise ValueError(f"columns {sorted(clash)} are those of the result")
    parts = tokens.sparkSession.sparkContext.broadcast(_tables(ranks))
    schema = T.StructType([*tokens.schema, T.StructField("decoded", T.BinaryType()), T.StructField("decoded_text", T.StringType())])
    return tokens.withColumn("_ids", F.col(ids_col)).mapInArrow(lambda it: _decode(it, *parts.value), schema)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", at_space: bool = True) -> DataFrame:
    """`encode` and `decode` of its ids in one pass, so that no ids go back to Spark between them: the id column, ids,
    decoded and decoded_text."""
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json(ranks, pattern), _tables(ranks)))
    fields = {"ids": T.ArrayType(T.IntegerType()), "decoded": T.BinaryType(), "decoded_text": T.StringType()}
    schema = T.StructType([docs.schema[id_col], *[T.StructField(n, t) for n, t in fields.items()]])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        json, tables = shared.value
        for batch in _encode(batches, json, False, at_space):
            ids = pa.RecordBatch.from_arrays([*batch.columns, batch.column("ids")], [*batch.schema.names, "_ids"])
            yield from _decode(iter([ids]), *tables)

    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(both, schema)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids and back."""
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    back = round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
