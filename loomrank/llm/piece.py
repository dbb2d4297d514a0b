"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

Words go in batches into flat numpy symbol arrays. Each round finds every word's least pair rank with a
segmented minimum, merges its leftmost non-overlapping occurrences at once, and closes the gaps, until no
word has a pair left. A word in which a merge makes a pair of the same or a better rank (runs of blanks do)
is run again by a heap of its pairs, one merge at a time, which is the order of the reference library in every case.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrank.llm.common import map_batches

BLANK = "▁"
NONE = np.int64(1 << 40)
#: Words kept encoded in each worker: so many new ones, and as many that were new before them.
MEMO_WORDS = 300_000
#: Each byte that is no UTF-8 shows as one replacement character.
ESCAPED = re.compile("[\udc80-\udcff]")


class PieceBpe:
    """Encoder and decoder of one SentencePiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, model: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        if sp.normalize("ﬁ Ａ  b") != "▁ﬁ▁Ａ▁▁b":
            raise ValueError("only models that leave texts as they are, behind one blank, are known")
        n = self.size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.special = [sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        self.unknown = sp.unk_id()
        self.byte_of = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_ids = np.zeros(256, np.int64)
        for i, b in self.byte_of.items():
            self.byte_ids[b] = i
        normal = {p: i for i, p in enumerate(self.pieces) if not (self.special[i] or i in self.byte_of or sp.is_unused(i))}
        #: equal scores share a rank: the leftmost pair goes first
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in normal.values()}, reverse=True))}
        keys, made, ranks = [], [], []
        for p, i in normal.items():
            for c in range(1, len(p)):
                if (a := normal.get(p[:c])) is not None and (b := normal.get(p[c:])) is not None:
                    keys.append(a * n + b)
                    made.append(i)
                    ranks.append(order[sp.get_score(i)])
        sort = np.argsort(keys)
        self.keys, self.made, self.ranks = (np.append(np.array(x, np.int64)[sort], e) for x, e in ((keys, np.int64(1) << 62), (made, -1), (ranks, NONE)))
        self.single = {p: i for p, i in normal.items() if len(p) == 1}
        inner = {c for p in normal for c in p}
        #: no piece holds a blank behind another character, so no merge crosses such a place
        self.splits_at_blanks = not any(BLANK in p.lstrip(BLANK) for p in normal)
        self.splits_at_lines = "\n" not in inner
        self.text_of = [b"" if self.special[i] else bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(BLANK, " ").encode() for i, p in enumerate(self.pieces)]
        self.table: dict[int, tuple[int, int]] = {}
        self.memo: dict[str, tuple[str, int, bytes]] = {}
        self.older: dict[str, tuple[str, int, bytes]] = {}
        self.words = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n" if self.splits_at_lines else f"{BLANK}*[^{BLANK}]+|{BLANK}+") if self.splits_at_blanks else re.compile("(?s).+")

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and made piece of each pair; NONE where no piece joins it."""
        key = np.where((a < self.size) & (b < self.size), a * self.size + b, -1)
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.made[at], -1)

    def merge(self, words: list[str]) -> list[list[int]]:
        """Piece ids of each word."""
        out: list[list[int]] = [[]] * len(words)
        index = np.array([i for i, w in enumerate(words) if w], np.int64)
        if not len(index):
            return out
        sizes = np.array([len(words[i]) for i in index])
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        distinct, at = np.unique(chars, return_inverse=True)
        #: characters without a piece get symbols from self.size on
        symbols = np.array([self.single.get(chr(c), self.size + i) for i, c in enumerate(distinct)], np.int64)
        sym = symbols[at]
        word = np.repeat(np.arange(len(index)), sizes)
        rank, made = np.full(len(sym), NONE), np.full(len(sym), -1)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside], made[inside] = self.pair(sym[inside], sym[inside + 1])
        again: list[int] = []
        while len(sym):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lengths = np.diff(np.append(starts, len(sym)))
            least = np.minimum.reduceat(rank, starts)
            done = least == NONE
            if done.any():
                full = np.repeat(done, lengths)
                ids, of = sym[full], word[full]
                if (ids >= self.size).any():
                    ids, of = self.bytes_for(ids, of, distinct)
                cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                flat = ids.tolist()
                for a, b, w in zip(cuts.tolist(), [*cuts[1:].tolist(), len(flat)], of[cuts].tolist(), strict=True):
                    out[index[w]] = flat[a:b]
                sym, word, rank, made = (x[~full] for x in (sym, word, rank, made))
                continue
            spread = np.repeat(least, lengths)
            best = rank == spread
            # of touching occurrences, every second from the left
            i = np.arange(len(sym))
            begins = best & ~np.append(False, best[:-1] & (word[1:] == word[:-1]))
            run = np.maximum.accumulate(np.where(begins, i, 0))
            at = np.flatnonzero(best & ((i - run) % 2 == 0))
            bound, of = spread[at], word[at]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            at = moved[at]
            mark = np.zeros(len(sym) + 1, bool)
            mark[at], mark[at - 1] = True, True
            touched = np.flatnonzero(mark[:-1])
            inner = (touched < len(sym) - 1) & (word[touched] == word[np.minimum(touched + 1, len(sym) - 1)])
            rank[touched], made[touched] = NONE, -1
            touched = touched[inner]
            rank[touched], made[touched] = self.pair(sym[touched], sym[touched + 1])
            limit = np.zeros(len(index), np.int64)
            limit[of] = bound
            bad = np.unique(word[touched[rank[touched] <= limit[word[touched]]]])
            if len(bad):
                again += index[bad].tolist()
                good = ~np.isin(word, bad)
                sym, word, rank, made = (x[good] for x in (sym, word, rank, made))
        for i in again:
            out[i] = self.merge_singly(words[i])
        return out

    def merge_singly(self, word: str) -> list[int]:
        """Piece ids of one word, least rank first and leftmost first among equals; time grows as n log n."""
        if not self.table:
            self.table = dict(zip(self.keys[:-1].tolist(), zip(self.ranks[:-1].tolist(), self.made[:-1].tolist(), strict=True), strict=True))
        n, strange = self.size, sorted({c for c in word if c not in self.single})
        beyond = {c: n + i for i, c in enumerate(strange)}
        sym = [self.single.get(c, beyond.get(c, 0)) for c in word]
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))

        def pair(a: int, b: int) -> tuple[int, int] | None:
            return self.table.get(a * n + b) if a < n and b < n else None

        heap = [(got[0], i, sym[i], sym[i + 1], got[1]) for i in range(len(sym) - 1) if (got := pair(sym[i], sym[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= len(sym) or sym[j] != b:
                continue  # one of the two has been merged since
            sym[i], sym[j] = made, -1
            after[i] = k = after[j]
            if k < len(sym):
                before[k] = i
                if got := pair(made, sym[k]):
                    heapq.heappush(heap, (got[0], i, made, sym[k], got[1]))
            if (h := before[i]) >= 0 and (got := pair(sym[h], made)):
                heapq.heappush(heap, (got[0], h, sym[h], made, got[1]))
        bytes_of = {s: self.byte_ids[list(c.encode("utf-8", "replace"))].tolist() for c, s in beyond.items()}
        return [x for s in sym if s >= 0 for x in (bytes_of[s] if s >= n else (s,))]

    def bytes_for(self, ids: np.ndarray, of: np.ndarray, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without a piece become their UTF-8 bytes' pieces."""
        table = {s: self.byte_ids[list(chr(distinct[s - self.size]).encode("utf-8", "replace"))] for s in np.unique(ids[ids >= self.size]).tolist()}
        counts = np.ones(len(ids), np.int64)
        for s, b in table.items():
            counts[ids == s] = len(b)
        spread, of = np.repeat(ids, counts), np.repeat(of, counts)
        nth = np.arange(len(spread)) - np.repeat(np.cumsum(counts) - counts, counts)
        for s, b in table.items():
            hit = spread == s
            spread[hit] = b[nth[hit]]
        return spread, of

    def split(self, text: str) -> list[str]:
        return self.words.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def known(self, words: set[str]) -> None:
        """Encode and decode those words that aren't kept yet."""
        if len(self.memo) + len(words) > MEMO_WORDS:
            self.memo, self.older = {}, self.memo
        missing = [w for w in words if w not in self.memo]
        self.memo.update({w: self.older[w] for w in missing if w in self.older})
        fresh = [w for w in missing if w not in self.memo]
        for i in range(0, len(fresh), 20_000):
            part = fresh[i : i + 20_000]
            for w, ids in zip(part, self.merge(part), strict=True):
                self.memo[w] = (",".join(map(str, ids)), len(ids), b"".join([self.text_of[x] for x in ids]))

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        self.known(set(words))
        return [int(x) for w in words for x in self.memo[w][0].split(",")]

    def decode(self, ids: list[int]) -> str:
        """Text of any ids: pieces joined, blanks restored, the leading one dropped, unknown ids as the library shows them."""
        runs: list[list[bytes]] = [[]]
        for i in ids:
            runs[-1].append(" ⁇ ".encode() if i == self.unknown else self.text_of[i])
            if self.special[i] and i != self.unknown:  # bytes on the two sides of a control piece are no character together
                runs.append([])
        out = "".join(ESCAPED.sub("\ufffd", b"".join(r).decode("utf-8", "surrogateescape")) for r in runs)
        first = next((i for i in ids if not self.special[i]), None)
        if first is not None and self.pieces[first].startswith(BLANK) and ids[0] != self.unknown:
            out = out[1:]
        return out


_MODELS: dict[str, PieceBpe] = {}


def model_for(path: str) -> PieceBpe:
    """One model a worker process."""
    if path not in _MODELS:
        _MODELS[path] = PieceBpe(path)
    return _MODELS[path]


def piece_round_trip(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``) of every row, in row order of the input.

    A null text counts as the empty one: no ids, digests of nothing. Long texts are one row each; only a
    batch of rows and a bounded memory of encoded words are held. Further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model_for(model)
        for b in batches:
            split = [bpe.split(t or "") for t in b.column("text").to_pylist()]
            rows: list[tuple] = []
            at = 0
            while at < len(split):  # rows whose words fit the memory together
                some: set[str] = set()
                to = at
                while to < len(split) and (to == at or len(some) + len(split[to]) < MEMO_WORDS // 2):
                    some.update(split[to])
                    to += 1
                bpe.known(some)
                for words in split[at:to]:
                    got = [bpe.memo[w] for w in words]
                    ids = ",".join([g[0] for g in got])
                    text = b"".join([g[2] for g in got])
                    text = text[1:] if text[:1] == b" " else text
                    rows.append((sum([g[1] for g in got]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), np.array(ids.split(","), np.int32).tolist() if with_ids and ids else []))
                at = to
            cols = [b.column("doc_id"), *[pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols, names = [*cols, pa.array([r[3] for r in rows], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)
