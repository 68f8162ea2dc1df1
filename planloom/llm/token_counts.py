"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts never leave the Arrow function, only their lengths do.  Each Arrow batch
is cut into slices of about ``SLICE_BYTES`` of text, so one slice holds many
short texts or a part of a long one, and long texts are split at boundaries that
no token can cross:

* Tokenizers that drop white space (``word`` kind): every run of ASCII white
  space.  A text's count is then the sum of its words' counts, so each distinct
  word of a slice is encoded once, in one batch call, and a bounded cache
  carries lengths from slice to slice.
* Byte-level BPE (``byte`` kind): before a blank that stands between a character
  other than white space and another one.
* SentencePiece models are encoded text by text: a merge may cross blanks.

Defined cases: a null or empty text has zero bytes and zero tokens; white space
only has zero tokens under a ``word`` tokenizer; repeated rows give repeated
results; an empty table gives an empty result; columns other than the id and
the text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are encoded at once.
SLICE_BYTES = 4 << 20
#: Words of at most this many bytes are kept in the cache, and so many of them.
CACHED_WORD_BYTES, CACHED_WORDS = 48, 800_000


class LengthCounter:
    """Counts tokens as the tokenizer's own library does, slice by slice."""

    def __init__(self, data: bytes, suffix: str):
        self.cache: dict[bytes, int] = {}
        if suffix == ".json":
            from tokenizers import Tokenizer

            spec = json.loads(data)
            self.encoder = Tokenizer.from_str(data.decode("utf-8"))
            self.kind = "word" if _drops_white_space(spec) else "byte" if _is_byte_level(spec) else "text"
            self.plain_end = self.kind == "word" and not _has_affixes(spec)
            self.marks = [t["content"].encode() for t in spec.get("added_tokens", [])]
        elif suffix == ".model":
            import sentencepiece

            self.encoder = sentencepiece.SentencePieceProcessor(model_proto=data)
            self.kind = "pieces"
        else:
            raise ValueError(f"no tokenizer library for {suffix!r}")

    def lengths(self, texts: list[bytes]) -> list[int]:
        if self.kind == "word":
            return self._by_word(texts)
        if self.kind == "byte":
            return self._by_part(texts)
        decoded = [t.decode("utf-8") for t in texts]
        if self.kind == "pieces":
            return [len(x) for x in self.encoder.encode(decoded, num_threads=1)] if decoded else []
        return self._encode(decoded)

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _by_word(self, texts: list[bytes]) -> list[int]:
        out = [0] * len(texts)
        for rows in balanced(texts, SLICE_BYTES):
            split = [(row, texts[row][start:end].split()) for row, start, end in rows]
            new = {}
            for _, words in split:
                new.update(dict.fromkeys(words))
            cache = self.cache
            missing = [w for w in new if w not in cache]
            # "word," and "word." end in a token of their own
            bare = {w: w[:-1] if self.plain_end and w[-1:] in b",." and w[-2:-1].isalpha() else w for w in missing}
            todo = [w for w in dict.fromkeys(bare.values()) if w not in cache]
            found = dict(zip(todo, self._encode([w.decode("utf-8") for w in todo]), strict=True))
            if len(cache) + len(missing) > CACHED_WORDS:
                kept = {w: cache[w] for w in new if w in cache}
                kept.update({core: cache[core] for core in bare.values() if core in cache})
                cache.clear()
                cache.update(kept)
            cache.update(found)
            for w, core in bare.items():
                cache[w] = cache[core] + (w is not core)
            get = cache.__getitem__
            for row, words in split:
                out[row] += sum(map(get, words))
            for w in new:
                if len(w) > CACHED_WORD_BYTES:
                    cache.pop(w, None)
            for w in found:
                if len(w) > CACHED_WORD_BYTES:
                    cache.pop(w, None)
        return out

    def _by_part(self, texts: list[bytes]) -> list[int]:
        out = [0] * len(texts)
        for rows in balanced(texts, SLICE_BYTES, boundary=rb"(?<=[^\s\x80-\xff]) (?=[A-Za-z])"):
            for (row, _, _), n in zip(rows, self._encode([texts[r][a:b].decode("utf-8") for r, a, b in rows]), strict=True):
                out[row] += n
        return out


def _steps(spec: dict, key: str) -> list[dict]:
    step = spec.get(key) or {}
    return step.get(f"{key}s") or step.get("pretokenizers") or ([step] if step else [])


def _drops_white_space(spec: dict) -> bool:
    """White space never reaches a token: pieces are the matches of a pattern without it."""
    splits = [s for s in _steps(spec, "pre_tokenizer") if s.get("type") == "Split"]
    marks = all(not re.search(r"\s", t["content"]) and not t.get("lstrip") and not t.get("rstrip") and not t.get("single_word") for t in spec.get("added_tokens", []))
    dropped = bool(splits) and splits[0].get("behavior") == "Removed" and splits[0].get("invert") and r"[^\s" in splits[0]["pattern"].get("Regex", "")
    return marks and bool(dropped or [s for s in _steps(spec, "pre_tokenizer") if s.get("type") in ("Whitespace", "WhitespaceSplit")])


def _is_byte_level(spec: dict) -> bool:
    steps = _steps(spec, "pre_tokenizer")
    return any(s.get("type") == "ByteLevel" and s.get("use_regex", True) and not s.get("add_prefix_space") for s in steps)


def _has_affixes(spec: dict) -> bool:
    """Whether a letter and the sign after it could share a token."""
    splits = [s for s in _steps(spec, "pre_tokenizer") if s.get("type") == "Split"]
    return not (splits and r"[\p{L}]+" in splits[0]["pattern"].get("Regex", ""))


def balanced(texts: list[bytes], most: int, boundary: bytes = rb"[\x09-\x0D\x20]") -> Iterator[list[tuple[int, int, int]]]:
    """Slices of about ``most`` bytes: lists of (row, start, end).  Long texts end a part at a boundary only."""
    found = re.compile(boundary)
    rows: list[tuple[int, int, int]] = []
    held = 0
    for row, text in enumerate(texts):
        start = 0
        while start < len(text):
            end = len(text)
            if end - start > most - held:
                cut = found.search(text, start + max(most - held, 1))
                end = cut.start() if cut else len(text)
            rows.append((row, start, end))
            held += end - start
            start = end
            if held >= most:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


@lru_cache(maxsize=2)
def _counter(data: bytes, suffix: str, _digest: str) -> LengthCounter:
    return LengthCounter(data, suffix)


def tokenizer_file(path: str | None) -> tuple[bytes, str]:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Path(path).read_bytes(), Path(path).suffix


def token_counts(df: DataFrame, tokenizer_path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Per row: the id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    The tokenizer file (a few MB, fixed by the vocabulary) goes to the executors
    as one broadcast variable, so no executor needs the path.
    """
    data, suffix = tokenizer_file(tokenizer_path)
    shared = df.sparkSession.sparkContext.broadcast((data, suffix, hashlib.sha256(data).hexdigest()))
    id_type = df.schema[id_col].dataType

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(*shared.value)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            n = counter.lengths(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["id", "n_bytes", "n_tokens", "over_limit"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = rows.mapInArrow(count, f"id {id_type.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return counted.withColumnRenamed("id", id_col)
