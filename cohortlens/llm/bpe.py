"""Byte-level BPE encoding and decoding with tree concatenation for long texts.

A long text is cut into leaves that are encoded in parallel by different tasks. The
leaves' token lists are then concatenated pairwise up a tree. At each join a window that
grows to both sides is encoded anew until both of its ends agree exactly with the lists
around it (see `Codec.concat`), so the result equals that of encoding the whole text.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import fresh, prepare

#: Texts of more code points are cut into leaves of that length.
LEAF_CHARS = 8_192

# Fixed value: the public pattern that splits text before byte-level merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Between a visible character and white space the pattern always splits, whatever else is near.
SURE_SPLIT = regex.compile(r"(?<=[\p{L}\p{N}!-/:-@\[-`{-~])(?=[ \t\n\r 　])")
ONE_WORD = regex.compile(r"\p{L}{4,}")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies, by their rule."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of one tokenizer file (the JSON of a byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["normalizer"] or spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        letters = _byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        ranks = {as_bytes(token): number for token, number in spec["model"]["vocab"].items()}
        merged = [ranks[as_bytes("".join(m if isinstance(m, list) else m.split(" ")))] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{path}: ids do not follow the order of the merges")
        self.special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        self.pieces = {number: token for token, number in ranks.items()}
        self.pieces |= {number: text.encode() for text, number in self.special.items()}
        self.bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def encode_plain(self, text: str) -> list[int]:
        """Ids of a text in which strings of special tokens are ordinary text."""
        return self.bpe.encode_ordinary(text)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.split(text):
            ids += [self.special[part]] if part in self.special else self.encode_plain(part)
        return ids

    def split(self, text: str) -> list[str]:
        """The text cut at special tokens, those included."""
        if not any(token in text for token in self.special):
            return [text]
        longest = sorted(self.special, key=len, reverse=True)
        return [part for part in regex.split(f"({'|'.join(map(regex.escape, longest))})", text) if part]

    def bytes_of(self, ids: list[int]) -> bytes:
        return self.bpe.decode_bytes(ids)

    def decode(self, ids) -> str:
        return self.bytes_of(ids).decode("utf-8", "replace")

    def _agrees(self, a: int, b: int) -> bool:
        """Whether two neighbours inside one word are what their joint bytes encode to."""
        return self.bpe._encode_single_piece(self.pieces[a] + self.pieces[b]) == [a, b]

    def concat(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of the joint text of two encoded neighbours.

        The window starts with one token on each side and doubles. It may end

        * at a sure split (a visible character, then white space), where the pattern splits
          in every context: the text between two such places encodes to the same ids alone
          as in the whole; or
        * inside a word, if the new ids of the window and the old ids next to it encode
          jointly to themselves on both sides. A token list all of whose neighbours do so
          is the encoding of its bytes.
        """
        size = 1
        while True:
            tail, head = left[-size:], right[:size]
            before, after = self.bytes_of(tail), self.bytes_of(head)
            whole_left, whole_right = size >= len(left), size >= len(right)
            # A token may begin or end inside a character; such rests at the outer ends are left out.
            text_before, text_after = before.decode("utf-8", "ignore"), after.decode("utf-8", "ignore")
            full = len(text_before.encode()) == len(before) and len(text_after.encode()) == len(after)
            inner = full and not whole_left and not whole_right
            if inner and ONE_WORD.fullmatch(text_before) and ONE_WORD.fullmatch(text_after):
                window = self.bpe._encode_single_piece(before + after)
                if self._agrees(left[-size - 1], window[0]) and self._agrees(window[-1], right[size]):
                    return left[:-size] + window + right[size:]
            a = 0 if whole_left else self._last_split(before, text_before)
            b = len(after) if whole_right else self._first_split(text_after)
            if a is not None and b is not None:
                kept_left = left[: len(left) - self._count_from(tail, a)]
                kept_right = right[self._count_to(head, b) :]
                return kept_left + self.encode_plain((before[a:] + after[:b]).decode()) + kept_right
            size *= 2

    @staticmethod
    def _last_split(data: bytes, text: str) -> int | None:
        """Bytes before the last sure split; counted from the end, where ``text`` is complete."""
        found = list(SURE_SPLIT.finditer(text))
        return len(data) - len(text[found[-1].start() :].encode()) if found else None

    @staticmethod
    def _first_split(text: str) -> int | None:
        found = SURE_SPLIT.search(text)
        return None if found is None else len(text[: found.start()].encode())

    def _count_from(self, tail: list[int], start: int) -> int:
        """How many of the last tokens begin at or after byte ``start`` of the tail."""
        ends = np.cumsum([0] + [len(self.pieces[t]) for t in tail])
        return len(tail) - int(np.searchsorted(ends, start))

    def _count_to(self, head: list[int], end: int) -> int:
        ends = np.cumsum([0] + [len(self.pieces[t]) for t in head])
        return int(np.searchsorted(ends, end))

    def concat_tree(self, parts: list[list[int]]) -> list[int]:
        """Pairwise concatenation, level by level."""
        while len(parts) > 1:
            pairs = zip(parts[::2], parts[1::2], strict=False)
            parts = [self.concat(a, b) for a, b in pairs] + ([parts[-1]] if len(parts) % 2 else [])
        return parts[0] if parts else []


@functools.cache
def codec(path: str) -> Codec:
    """One codec for each worker and file."""
    return Codec(path)


IDS = pa.list_(pa.int32())


def _lists(rows: pa.Array) -> Iterator[list[int]]:
    """The rows of a list column; a null row is an empty list."""
    values, offsets = rows.values.to_numpy(), rows.offsets.to_numpy()
    for start, end in zip(offsets[:-1], offsets[1:], strict=True):
        yield values[start:end].tolist()


def encoder(path: str):
    def encode(texts: pa.Array) -> pa.Array:
        own = codec(path)
        return pa.array([own.encode(t.as_py() or "") for t in texts], IDS)

    return F.arrow_udf(encode, "array<int>")


def decoder(path: str):
    def decode(rows: pa.Array) -> pa.Array:
        own = codec(path)
        texts = [own.decode(ids) for ids in _lists(rows)]
        return pa.array([t if v else None for t, v in zip(texts, rows.is_valid().to_pylist(), strict=True)], pa.string())

    return F.arrow_udf(decode, "string")


def encode(docs: DataFrame, path: str, into: str = "token_ids", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``docs`` with the ids of each whole ``text`` in the array column ``into``.

    A null text counts as empty and an empty text has no ids. Texts up to ``leaf_chars`` are
    encoded where they are. Longer ones are cut into leaves, spread over all tasks, encoded,
    and joined again for each document; only those texts are shuffled. All other columns
    pass through; repeated rows stay repeated; a column named ``into`` is replaced. Ids of
    documents may be null or repeated: rows are told apart by all their columns. The file in
    ``path`` must exist on every executor.
    """
    prepare(docs.sparkSession)
    docs = docs.drop(into)
    size = F.length(F.coalesce(F.col("text"), F.lit("")))
    short = docs.where(size <= leaf_chars).withColumn(into, encoder(path)(F.col("text")))
    return short.unionByName(_encode_long(docs.where(size > leaf_chars), path, into, leaf_chars))


def _encode_long(docs: DataFrame, path: str, into: str, leaf_chars: int) -> DataFrame:
    row, mark, other, proof, part_no, part, leaf_no, leaf = fresh(docs, "row", "mark", "other", "proof", "part_no", "part", "leaf_no", "leaf")
    own = codec(path)
    others = [c for c in docs.columns if c != "text"]
    packed = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("none"))
    # The special tokens are hard borders: parts between them never touch.
    borders = "|".join(rf"\Q{token}\E" for token in sorted(own.special, key=len, reverse=True)) or r"\z\A"
    parts = (
        docs.select(
            packed.alias(row), F.xxhash64(packed, "text").alias(mark), F.xxhash64(F.lit(1), packed, "text").alias(other),
            F.sha2(F.col("text").cast("binary"), 256).alias(proof), "text"
        ).select(
            row, mark, other, proof,
            F.posexplode(F.split("text", borders)).alias(part_no, part),
            F.regexp_extract_all("text", F.lit(f"({borders})"), F.lit(1)).alias("hard"),
        )
    )
    leaves = parts.select(
        row, mark, other, proof, part_no,
        F.get("hard", F.col(part_no) - 1).alias("hard"),
        F.posexplode_outer(F.regexp_extract_all(part, F.lit(f"(?s).{{1,{leaf_chars}}}"), F.lit(0))).alias(leaf_no, leaf),
    )
    encoded = (
        leaves.repartition(mark, part_no, leaf_no)
        .withColumn("ids", leaf_encoder(path)(F.col(leaf)))
        .drop(leaf)
    )
    fields = docs.select(packed.alias(row)).schema[0].dataType
    schema = T.StructType([T.StructField(row, fields), T.StructField(proof, T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def join(rows: pa.Table) -> pa.Table:
        own = codec(path)
        rows = rows.sort_by([(part_no, "ascending"), (leaf_no, "ascending")])
        where = list(zip(rows[part_no].to_pylist(), [x or 0 for x in rows[leaf_no].to_pylist()], strict=True))
        copies = where.count((0, 0))
        ids = [own_ids for chunk in rows["ids"].chunks for own_ids in _lists(chunk)]
        hard = rows["hard"].to_pylist()
        lists: dict[int, list[list[int]]] = {}
        token: dict[int, str | None] = {}
        for i in range(0, len(where), copies):  # equal rows have equal leaves
            lists.setdefault(where[i][0], []).append(ids[i])
            token[where[i][0]] = hard[i]
        whole: list[int] = []
        for number, parts in sorted(lists.items()):
            whole += ([own.special[token[number]]] if number else []) + own.concat_tree(parts)
        return pa.table({row: rows[row].slice(0, copies), proof: rows[proof].slice(0, copies), "ids": pa.array([whole] * copies, IDS)})

    joined = encoded.groupBy(mark, other).applyInArrow(join, schema)
    back = [F.col(f"{row}.`{c}`").alias(c) for c in others]
    # The text is returned from its ids, so they have to give the text that was read.
    decoded = joined.withColumn("decoded", decoder(path)(F.col("ids")))
    same = F.sha2(F.col("decoded").cast("binary"), 256) == F.col(proof)
    text = F.when(same, F.col("decoded")).otherwise(F.raise_error(F.lit("token ids do not decode to their text")).cast("string"))
    return decoded.select(*back, text.alias("text"), F.col("ids").alias(into)).select(*docs.columns, into)


def leaf_encoder(path: str):
    def encode_leaf(texts: pa.Array) -> pa.Array:
        own = codec(path)
        return pa.array([own.encode_plain(t.as_py() or "") for t in texts], IDS)

    return F.arrow_udf(encode_leaf, "array<int>")


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")
