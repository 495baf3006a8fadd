"""Byte-level BPE of a tokenizer file: its pre-tokens, ids and token bytes, as the tokenizers library gives them.

Texts of code points whose classes are the same in all Unicode versions are cut and merged by the
faster ``regex`` and ``tiktoken`` (the ids are the ranks); all others by the library itself.
"""

from __future__ import annotations

import json
import os

#: The pattern of byte-level BPE files of this kind; white space as Unicode has it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
RANK_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points outside these ranges (below U+0530, punctuation, kana and Han, Hangul) go to the library.
OTHER = "[^\\x00-\\u052f\\u2000-\\u2070\\u20a0-\\u20bf\\u3000-\\u3096\\u30a0-\\u30ff\\u4e00-\\u9fa5\\uac00-\\ud7a3]"

# byte-level BPE writes a byte as a sign: printable ones as themselves, the others as signs from 256 on
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _PRINTED]
SIGN_BYTE = {chr(b) if b in _PRINTED else chr(256 + _OTHERS.index(b)): b for b in range(256)}


class ByteBpe:
    """One tokenizer file, loaded once per task.

    ``marks=True`` treats the file's special strings inside texts as the library does by default (each
    is its id); ``marks=False`` as plain text.
    """

    def __init__(self, path: str, marks: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        import tiktoken
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        added = spec.get("added_tokens") or []
        plain_marks = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) and t["special"] for t in added)
        if pre.get("type") != "ByteLevel" or model.get("type") != "BPE" or not plain_marks or spec.get("normalizer") or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("a byte-level BPE file without prefix space, normaliser or stripping special tokens is needed")
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not marks
        self.marks = {t["content"]: t["id"] for t in added} if marks else {}
        vocab = {t: i for t, i in model["vocab"].items() if t not in {x["content"] for x in added}}
        self.token_bytes = {i: bytes(SIGN_BYTE[c] for c in t) for t, i in vocab.items()}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        by_rank = all(a < b for a, b in zip(merged, merged[1:]))       # only then are ids the order of merging
        self._fast = tiktoken.Encoding("file", pat_str=RANK_PATTERN, mergeable_ranks={b: i for i, b in self.token_bytes.items()},
                                       special_tokens={}) if by_rank else None
        self._pattern = regex.compile(PRE_TOKEN)
        self._other = regex.compile(OTHER)
        self._split = regex.compile("(" + "|".join(regex.escape(m) for m in sorted(self.marks, key=len, reverse=True)) + ")") if self.marks else None

    def _stable(self, text: str) -> bool:
        return self._fast is not None and (text.isascii() or self._other.search(text) is None)

    def ids(self, text: str) -> list[int]:
        """Token ids of a whole text, without added special tokens."""
        if not self._stable(text):
            return self.library.encode(text, add_special_tokens=False).ids
        if not any(m in text for m in self.marks):
            return self._fast.encode_ordinary(text)
        out = []
        for part in self._split.split(text):
            out += [self.marks[part]] if part in self.marks else self._fast.encode_ordinary(part)
        return out

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a whole text, and how many special tokens stand between them."""
        if any(m in text for m in self.marks):
            parts = self._split.split(text)
            cut = [self.pre_tokens(p)[0] for p in parts if p not in self.marks]
            return [w for ws in cut for w in ws], sum(p in self.marks for p in parts)
        if text.isascii() or self._other.search(text) is None:
            return self._pattern.findall(text), 0
        return [text[a:z] for _, (a, z) in self.library.pre_tokenizer.pre_tokenize_str(text)], 0

    def pieces(self, word: str) -> int:
        """Number of tokens of one pre-token."""
        return len(self._fast.encode_ordinary(word) if self._stable(word) else self.library.encode(word, add_special_tokens=False).ids)
