"""Pre-tokenisation of the lower-cased, word-ended byte-pair vocabulary, as its file describes it.

The file asks for NFC, white space folded to one blank, lower case, then a split into contractions, letter runs, single
digits and runs of other characters. None of these crosses white space, so a text can be cut at white space first and
each distinct piece be handled once; the pieces of a corpus repeat far more often than they differ.
"""

from __future__ import annotations

import json
import unicodedata

import regex

#: Fixed values of the vocabulary file: Unicode White_Space, as its normaliser folds it.
WHITE_SPACE = r"[\t-\r \x85\xa0  -     　]+"
#: What every special string of such a vocabulary holds; load() checks it.
SPECIAL_START = "<|"
#: Python's own split() also cuts at these four, which the vocabulary keeps inside a word.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_SPLIT = regex.compile(WHITE_SPACE)


def load(path: str) -> dict:
    """A vocabulary file of the kind that this module follows; others raise a ValueError."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [(s["type"], s.get("pattern"), s.get("content")) for s in (spec["normalizer"] or {}).get("normalizers", [])]
    if steps != [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]:
        raise ValueError(f"{path} normalises texts in another way than NFC, white space and lower case")
    if spec["model"]["type"] != "BPE" or any(SPECIAL_START not in t["content"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError(f"{path} is no byte-pair vocabulary whose special strings hold {SPECIAL_START}")
    return spec


def word_pattern(spec: dict) -> regex.Pattern:
    """The pattern of one word, read from the vocabulary file."""
    steps = spec["pre_tokenizer"]["pretokenizers"]
    return regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))


def special_strings(spec: dict) -> dict[str, int]:
    return {t["content"]: t["id"] for t in spec["added_tokens"]}


def pieces(text: str) -> list[str]:
    """``text`` normalised and cut at white space. Special strings must have been taken out before."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # the vocabulary lower-cases character by character, so no final sigma
            text = text.replace("Σ", "σ")
    text = text.lower()
    if any(c in text for c in _SEPARATORS):
        return [p for p in _SPLIT.split(text) if p]
    return text.split()
