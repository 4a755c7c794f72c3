"""Exact encoding of whole texts with a tokenizer file of the tokenizers library.

The vocabulary and the order of the merges are read from the file.  Where the
file describes one of two known kinds of byte-pair tokenizer (byte-level words
with the blank before them; lower-cased words with a mark of their end), whole
texts run through tiktoken's merging core with that vocabulary, which gives the
library's ids in a third of its time and keeps nothing between texts.  Any
other file, and any text that holds a special token or a character outside
those whose classes both sides are known to see alike, is encoded by the
library itself, so the ids are the library's in every case.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The pattern by which byte-level pre-tokenizers cut words.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The pattern by which the lower-casing tokenizer cuts words.
LOWER_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters of the second kind that are neither letters nor digits nor white space, and the letters beside a-z.
MARKS = "!-/:-@\\[-`{-~¡-©«¬®-±´¶-¸»¿×÷‐-‧‰-⁞、。"
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ſぁ-ゖァ-ヺ一-龥"
#: Places where a word of that kind ends without a blank.
CUTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{MARKS}]+|[0-9]")


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(others)}


class PairEncoder:
    """ids of texts as little-endian bytes, two for each id where the vocabulary allows."""

    def __init__(self, tokenizer_json: bytes, end_id: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(tokenizer_json)
        wide = max(self.tokenizer.get_vocab_size(with_added_tokens=True), (end_id or 0) + 1) > 65536
        self.width, self.dtype = (4, "<u4") if wide else (2, "<u2")
        self.end = np.array([] if end_id is None else [end_id], dtype=self.dtype).tobytes()
        spec = json.loads(tokenizer_json)
        self.core, self.lowers, self.unusual = None, False, ""
        kind = self._kind(spec)
        if kind and (vocabulary := self._vocabulary(spec, " " if kind == "lower" else "")):
            import tiktoken

            self.lowers = kind == "lower"
            self.core = tiktoken.Encoding("file", pat_str="[^ ]+ " if self.lowers else BYTE_LEVEL_WORDS, mergeable_ranks=vocabulary, special_tokens={})
            special = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
            known = f"[^\t\n\r 0-9{LETTERS}{MARKS}]" if self.lowers else ""
            self.unusual = "|".join([known] * bool(known) + special)

    @staticmethod
    def _kind(spec: dict) -> str | None:
        """Which of the known kinds a file describes: ``bytes``, ``lower``, or none."""
        model, cut, normal = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            return None
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            return None
        suffix = model.get("end_of_word_suffix")
        if cut.get("type") == "ByteLevel":
            return "bytes" if cut.get("use_regex", True) and not cut.get("add_prefix_space") and normal is None and not suffix else None
        steps = [s.get("type") for s in (normal or {}).get("normalizers", [])]
        cuts = cut.get("pretokenizers", [])
        if steps == ["NFC", "Replace", "Lowercase"] and suffix and [c.get("type") for c in cuts] == ["Split", "ByteLevel"]:
            blanks, split, level = normal["normalizers"][1], cuts[0], cuts[1]
            same = blanks.get("pattern") == {"Regex": r"\s+"} and blanks.get("content") == " " and split.get("pattern") == {"Regex": LOWER_WORDS}
            if same and split.get("behavior") == "Removed" and split.get("invert") and not level.get("use_regex", True) and not level.get("add_prefix_space"):
                return "lower"
        return None

    @staticmethod
    def _vocabulary(spec: dict, end: str) -> dict[bytes, int] | None:
        """Bytes of every token, ``end`` standing for the mark of a word's end; none where ids don't follow the merges."""
        model, characters = spec["model"], byte_characters()
        suffix, vocab = model.get("end_of_word_suffix") or "", model["vocab"]
        special = {t["content"] for t in spec.get("added_tokens", [])}
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        order = [vocab.get(a + b, -1) for a, b in merges]
        first = max((vocab.get(c + s, len(vocab)) for c in characters for s in {"", suffix}), default=0)
        if any(b <= a for a, b in zip([first, *order], order, strict=False)):
            return None
        out = {}
        for token, i in vocab.items():
            if token in special:
                continue
            ends = bool(suffix) and token.endswith(suffix)
            own = token[: -len(suffix)] if ends else token
            if any(c not in characters for c in own):
                return None
            out[bytes(characters[c] for c in own) + (end if ends else "").encode()] = i
        return out

    def whole(self, text: str) -> bytes:
        """One text through the library."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def encode(self, texts) -> list[bytes]:
        """One value for each text, the end id included; a null counts as empty."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return []
        texts, end = pc.fill_null(texts.cast(pa.string()), ""), self.end
        if self.core is None:
            return [self.whole(t) + end for t in texts.to_pylist()]
        odd = pc.match_substring_regex(texts, self.unusual).to_pylist() if self.unusual else [False] * len(texts)
        core, dtype = self.core.encode_ordinary, self.dtype
        if not self.lowers:
            return [self.whole(t) + end if o else np.array(core(t), dtype=dtype).tobytes() + end for t, o in zip(texts.to_pylist(), odd, strict=True)]
        out, low = [], pc.utf8_lower(texts)
        for c in "\t\n\r":
            low = pc.replace_substring(low, c, " ")
        for t, words, o in zip(texts.to_pylist() if any(odd) else odd, low.to_pylist(), odd, strict=True):
            # a blank after every word marks its end
            out.append(self.whole(t) + end if o else np.array(core(CUTS.sub(r" \g<0> ", words) + " "), dtype=dtype).tobytes() + end)
        return out


_ENCODERS: dict = {}


def encoder(tokenizer_json: bytes, end_id: int | None) -> PairEncoder:
    """One encoder for each worker process."""
    key = (zlib.crc32(tokenizer_json), len(tokenizer_json), end_id)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PairEncoder(tokenizer_json, end_id)
    return _ENCODERS[key]


def read_tokenizer(path: str) -> bytes:
    """The tokenizer file (a few MB) that goes to the executors with the code."""
    with open(path, "rb") as f:
        return f.read()
