"""Byte-pair encoding and decoding: a priority queue of merge ranks over a doubly linked list of symbols.

A word's characters are the first symbols (the last one with the model's end-of-word suffix). Every neighbouring pair
that the merge list knows waits in a heap by rank, then place. The least one is taken off and its two symbols become
one; an entry whose symbols have changed since it was put there is stale and skipped. Links to the symbol before and
behind make a merge independent of the word's length, so a word of n characters takes n log n steps, however long.

How a text falls into words (Unicode form, letter case, the split pattern, characters for bytes) is what the tokenizer
file says, read by its own library. Where the file's split drops white space, a text is first cut at blanks: each task
keeps tables from distinct chunk and distinct word to ids, so what occurs often is worked out once. The tables are
emptied at a fixed number of characters, so a task's memory is bounded; chunks and words of any length are taken whole.

Null and empty texts have no ids; no ids (or null) decode to the empty text. Added tokens ("<|endoftext|>") that a text
holds become their own ids, as in the library. Other columns stay; a column of the result's name is replaced.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marketlens.llm.common import short_batches

#: Characters that a task's tables may hold as keys before they are emptied.
TABLE_CHARS = 100_000_000
_ENTRY = 150
#: Characters whose letter case, class and form are the same in every version of Unicode and don't depend on neighbours.
_PLAIN = re.compile("[!-~\u00a1-\u012f]+")


class Merges:
    """The model of a tokenizer file: symbols, their ids and the ranks of pairs."""

    def __init__(self, model: dict):
        if model["type"] != "BPE" or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only byte-pair models without unknown token, prefix, dropout or whole-word lookup are known here")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])

    def ids(self, word: str) -> list[int]:
        """The ids of one word, which isn't empty."""
        symbols = [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.suffix]]
        n, known = len(symbols), self.pairs.get
        before, behind = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(found[0], i, found[1]) for i in range(n - 1) if (found := known((symbols[i], symbols[i + 1])))]
        heapq.heapify(queue)
        while queue:
            rank, left, merged = heapq.heappop(queue)
            right = behind[left]
            if right < 0 or symbols[left] < 0 or known((symbols[left], symbols[right])) != (rank, merged):
                continue  # stale: one of the two has merged with another symbol meanwhile
            symbols[left], symbols[right] = merged, -1
            far, near = behind[right], before[left]
            behind[left] = far
            if far >= 0:
                before[far] = left
                if found := known((merged, symbols[far])):
                    heapq.heappush(queue, (found[0], left, found[1]))
            if near >= 0 and (found := known((symbols[near], merged))):
                heapq.heappush(queue, (found[0], near, found[1]))
        return [s for s in symbols if s >= 0]


class Codec:
    """One tokenizer file in one task."""

    def __init__(self, path: str, table_chars: int = TABLE_CHARS):
        import tokenizers

        whole = tokenizers.Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges(spec["model"])
        self.normal, self.split = whole.normalizer, whole.pre_tokenizer
        odd = [t for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if odd:
            raise ValueError("added tokens that strip, need word borders or are found in normal form are not known here")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.cut_at_blanks = _drops_blanks(spec.get("pre_tokenizer")) and not any(re.search(r"\s", t) for t in self.added)
        self.plain = _plain_split(spec) if self.cut_at_blanks else None
        self.decoder = (spec.get("decoder") or {}).get("type")
        if self.decoder not in (None, "ByteLevel"):
            raise ValueError(f"the decoder {self.decoder} is not known here")
        names = {i: s for s, i in (*self.merges.vocab.items(), *self.added.items())}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.room = self.table_chars = table_chars
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        if (ids := self.words.get(word)) is None:
            ids = self.words[word] = np.asarray(self.merges.ids(word), "<u4").tobytes()
            self.room -= len(word) + _ENTRY
        return ids

    def _chunk(self, chunk: str) -> bytes:
        out = []
        for piece in self._added.split(chunk) if self._added else (chunk,):
            if piece in self.added:
                out.append(np.asarray([self.added[piece]], "<u4").tobytes())
            elif piece and self.plain and _PLAIN.fullmatch(piece):
                out += [self._word(w if w.isascii() else _shown(w)) for w in self.plain.findall(piece.lower())]
            elif piece:
                form = self.normal.normalize_str(piece) if self.normal else piece
                words = self.split.pre_tokenize_str(form) if self.split else [(form, None)]
                out += [self._word(w) for w, _ in words if w]
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        if not self.cut_at_blanks:
            ids = self._chunk(text)
        else:
            table, parts = self.chunks, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            for chunk in {c for c in parts if c not in table}:
                table[chunk] = self._chunk(chunk)
                self.room -= len(chunk) + _ENTRY
            ids = b"".join(map(table.__getitem__, parts))
        if self.room < 0:
            self.chunks.clear()
            self.words.clear()
            self.room = self.table_chars
        return ids

    def decode(self, ids: bytes) -> str:
        """Vocabulary strings, concatenated by the file's decoder, or with blanks between if it has none."""
        pieces = map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist())
        if self.decoder is None:
            return " ".join(pieces)
        return bytes(map(_BYTE_OF.__getitem__, "".join(pieces))).decode("utf-8", "replace")


def _drops_blanks(split: dict | None) -> bool:
    """Whether the first step of a pre-tokenizer keeps only matches of a pattern, and none of them holds a blank."""
    steps = [split] if split and split["type"] != "Sequence" else (split or {}).get("pretokenizers", [])
    first = steps[0] if steps else {}
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or first.get("invert") is not True:
        return False
    found = regex.compile(first["pattern"]["Regex"]) if "Regex" in first["pattern"] else regex.compile(regex.escape(first["pattern"]["String"]))
    return not any(found.search(before + blank + behind) and blank in "".join(found.findall(before + blank + behind)) for blank in " \n\t\r" for before in ("", "a", "1", ".", "'") for behind in ("", "a", "1", ".", "s"))


def _plain_split(spec: dict) -> regex.Pattern | None:
    """The split pattern, if all that the file does else is usual form, white space, lower case and characters for bytes."""
    steps = spec["pre_tokenizer"].get("pretokenizers", [])
    forms = (spec.get("normalizer") or {}).get("normalizers", [])
    usual = [f["type"] for f in forms] == ["NFC", "Replace", "Lowercase"] and forms[1]["pattern"] == {"Regex": r"\s+"} and forms[1]["content"] == " "
    bare = len(steps) == 2 and steps[1] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    return regex.compile(steps[0]["pattern"]["Regex"]) if usual and bare and "Regex" in steps[0]["pattern"] else None


def _alphabet() -> str:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on, in order."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return "".join(chr(256 + hidden.index(b) if b in hidden else b) for b in range(256))


_ALPHABET = _alphabet()
_BYTE_OF = {c: b for b, c in enumerate(_ALPHABET)}


def _shown(word: str) -> str:
    return codecs.charmap_decode(word.encode(), "strict", _ALPHABET)[0]


@lru_cache(maxsize=2)
def _codec(path: str) -> Codec:
    return Codec(path)


def _mapped(df: DataFrame, source: str, target: str, kind: T.DataType, column: Callable[[Codec, pa.Array], pa.Array], path: str) -> DataFrame:
    keep = [c for c in df.columns if c != target]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(target, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for b in batches:
            at = b.schema.get_field_index
            yield pa.RecordBatch.from_arrays([*(b.column(at(c)) for c in keep), column(codec, b.column(at(source)))], names=[*keep, target])

    return short_batches(df).mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", packed: bool = False) -> DataFrame:
    """``df`` with column ``ids``: what the library's encode() gives for ``text`` without its template.

    An array of ints; with ``packed``, binary of little-endian unsigned 32-bit integers, as token files hold them.
    """

    def column(codec: Codec, texts: pa.Array) -> pa.Array:
        got = [codec.encode(t) if t else b"" for t in texts.to_pylist()]
        if packed:
            return pa.array(got, pa.binary())
        ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in got])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), "<i4")))

    return _mapped(df, text, ids, T.BinaryType() if packed else T.ArrayType(T.IntegerType()), column, path)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with column ``text``: what the library's decode() gives for ``ids`` (either form), special tokens included."""

    def column(codec: Codec, rows: pa.Array) -> pa.Array:
        got = (x if isinstance(x, bytes) else np.asarray(x or [], "<u4").tobytes() for x in rows.to_pylist())
        return pa.array([codec.decode(x) for x in got], pa.string())

    return _mapped(df, ids, text, T.StringType(), column, path)
