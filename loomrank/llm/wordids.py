"""Token ids of whole texts by a tokenizers-library BPE, encoding each distinct word once.

Neither pre-tokenizer of the two supported kinds ever joins a visible character to white space behind it, so
a text cut before each white-space run gives the same ids piece by piece. Ids come as little-endian unsigned
32-bit bytes.
"""

from __future__ import annotations

import gc
import json
import os
import re

import numpy as np

#: Words kept encoded in each worker, and their characters: so many new ones, and as many that were new before them.
MEMO_WORDS, MEMO_CHARS = 400_000, 16_000_000
#: Words that are encoded in one string.
TOGETHER = 500
#: Letters (composed, of Latin-1) and marks of ASCII; to both kinds a run of the ones and a run of the others are two words,
#: but for what an apostrophe begins. The unit separators \x1c-\x1f are white space to Python but not to the library.
LETTERS, MARKS, END = "A-Za-zÀ-ÖØ-öø-ÿ", "!-&(-/:-@\\[-`{-~", "[ \\t\\n]|\\Z"
BARE = re.compile(f"[{LETTERS}]+(?=[{MARKS}]|{END})|[{MARKS}]+(?={END})|[\\S\x1c-\x1f]+")
WITH_BLANKS = re.compile(f" ?[{LETTERS}]+(?=[{MARKS}]|{END})| ?[{MARKS}]+(?={END})|[^\\S\x1c-\x1f]*[\\S\x1c-\x1f]+|[^\\S\x1c-\x1f]+")
PLAIN, PLAIN_BEHIND_BLANK = re.compile(f"[{LETTERS}]+"), re.compile(f" [{LETTERS}]+")


class WordIds:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normalizer = spec.get("normalizer")
        steps = {n["type"] for n in (normalizer or {}).get("normalizers", [normalizer] if normalizer else [])}
        before = spec["pre_tokenizer"]
        kinds = [p["type"] for p in before.get("pretokenizers", [before])]
        if not steps and kinds == ["ByteLevel"] and before.get("use_regex") and not before.get("add_prefix_space"):
            self.bare = False
        elif steps <= {"NFC", "Replace", "Lowercase"} and kinds == ["Split", "ByteLevel"]:
            self.bare = True
        else:
            raise ValueError(f"no word cuts are known for {kinds} with {steps}")
        self.lowers = "Lowercase" in steps
        self.size = self.tokenizer.get_vocab_size()
        self.cut, self.plain = (BARE, PLAIN) if self.bare else (WITH_BLANKS, PLAIN_BEHIND_BLANK)
        #: ids that end a word in the one kind, that begin one behind a blank in the other
        end = (lambda t: t.endswith("</w>")) if self.bare else (lambda t: t.startswith("Ġ"))
        self.edge = np.zeros(self.size, bool)
        for t, i in self.tokenizer.get_vocab().items():
            self.edge[i] = end(t)
        if self.bare and spec["model"].get("end_of_word_suffix") != "</w>":
            raise ValueError("no word ends are known without a suffix")
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def split(self, text: str) -> list[str]:
        """Pieces of a text that are encoded alike alone and in it."""
        if self.lowers and "<|" not in text:  # a special token is told before letters are lowered
            try:  # beyond Latin-1 lower case is left to the library
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return self.cut.findall(text)

    def singly(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(words), 10_000):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words[i : i + 10_000], add_special_tokens=False)]
        return out

    def pieces(self, words: list[str]) -> list[bytes]:
        """Ids of many words of letters: encoded in strings of some hundred and cut where a word ends or begins."""
        out: list[bytes] = []
        joint = " " if self.bare else ""
        for i in range(0, len(words), TOGETHER):
            part = words[i : i + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([joint.join(part)], add_special_tokens=False)[0].ids, "<u4")
            at = 4 * np.flatnonzero(self.edge[ids])
            if len(at) != len(part):
                out += self.singly(part)
                continue
            flat, stops = ids.tobytes(), (at + 4).tolist() if self.bare else [*at[1:].tolist(), 4 * len(ids)]
            start = 0
            for stop in stops:
                out.append(flat[start:stop])
                start = stop
        return out

    def known(self, words: set[str]) -> None:
        if len(self.memo) + len(words) > MEMO_WORDS or self.held > MEMO_CHARS:
            self.memo, self.older, self.held = {}, self.memo, 0
        missing = words - self.memo.keys()
        again = missing & self.older.keys()
        self.memo.update(zip(again, map(self.older.__getitem__, again), strict=True))
        fresh = missing - again
        self.held += sum(map(len, missing))
        plain = [w for w in fresh if self.plain.fullmatch(w)]
        self.memo.update(zip(plain, self.pieces(plain), strict=True))
        other = list(fresh.difference(plain))
        self.memo.update(zip(other, self.singly(other), strict=True))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, null as empty; as many texts at a time as the memory has room for.

        Nothing here refers to itself, so the collector of cycles rests meanwhile: it would walk the words again and again.
        """
        collects = gc.isenabled()
        gc.disable()
        try:
            return self.encoded(texts)
        finally:
            if collects:
                gc.enable()

    def encoded(self, texts: list[str | None]) -> list[bytes]:
        split = [self.split(t or "") for t in texts]
        out: list[bytes] = []
        at = 0
        while at < len(split):
            some: set[str] = set()
            to, chars = at, 0
            while to < len(split) and (to == at or (len(some) + len(split[to]) < MEMO_WORDS // 2 and chars < MEMO_CHARS)):
                some.update(split[to])
                chars += len(texts[to] or "")
                to += 1
            self.known(some)
            get = self.memo.__getitem__
            out += [b"".join(map(get, words)) for words in split[at:to]]
            at = to
        return out


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One encoder a worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]
