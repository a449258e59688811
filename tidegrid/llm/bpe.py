"""BPE encoding and decoding by batched numpy merge rounds.

All new words of a batch lie in one flat array of symbols. A round looks up every neighbouring pair by binary
search over the sorted pair keys, finds each word's lowest rank, and merges that pair's occurrences from left to
right in all words at once; words leave the array when they have no pair left. A word's ids are kept in a bounded
dictionary of the Python worker, so that frequent words are merged once. A very long word is merged by itself, in rounds that look only at the places of
their rank, so that a megabyte without a break takes seconds.

Follows the file of a `tokenizers` BPE model: NFC, white space to one space, lower case, the split pattern, bytes as
characters, an end-of-word suffix, added tokens found in the raw text. Null texts count as empty; an empty text has no
ids and decodes to ''. Extra columns are dropped, whatever their names; rows are independent, so repeated rows give repeated results.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidegrid.llm.common import text_of

#: Words that a worker keeps; beyond it the dictionary starts anew.
KEPT_WORDS = 400_000
#: Characters from which on a word is merged by itself.
LONG_WORD = 1_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class BatchBPE:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only plain BPE models are supported")
        if spec.get("decoder") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("only files without a decoder and with plain added tokens are supported")
        if [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("only files that compose, squeeze white space and lower case are supported")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.strings = {i: s for s, i in self.vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.added.items()}
        names = sorted(self.added, key=len, reverse=True)
        self.added_pattern = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.split = regex.compile(splits[0]["pattern"]["Regex"])
        self.space = regex.compile(r"\s+")
        letters = byte_characters()
        self.first = np.array([self.vocab[c] for c in letters])
        self.last = np.array([self.vocab[c + self.suffix] for c in letters])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([self.vocab[a] << 32 | self.vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([self.vocab[a + b] for a, b in pairs], np.int64)[order]
        self.known: dict[str, list[int]] = {}

    def pieces(self, text: str) -> list[str]:
        """Words of a text without added tokens, in order."""
        text = self.space.sub(" ", unicodedata.normalize("NFC", text))
        return self.split.findall("".join(map(lower_one, text)) if "İ" in text or "Σ" in text else text.lower())

    def merge_long(self, raw: bytes) -> list[int]:
        """Ids of one long word. Pairs wait by rank, so a round looks at the places of its rank and what lies beside them, not at the whole word."""
        flat = np.frombuffer(raw, np.uint8)
        n = len(flat)
        symbol = self.first[flat]
        symbol[-1] = self.last[flat[-1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # n: the end
        rank, at = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        order: list[int] = []

        def look(places: np.ndarray) -> None:
            """Rank the pairs that begin at these places anew, and let them wait."""
            places = places[after[places] < n]
            key = symbol[places] << 32 | symbol[after[places]]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[found] == key
            rank[places] = np.where(hit, self.ranks[found], -1)
            at[places] = found
            places = places[hit]
            if not len(places):
                return
            places = places[np.argsort(rank[places], kind="stable")]
            ranks, start = np.unique(rank[places], return_index=True)
            for r, part in zip(ranks.tolist(), np.split(places, start[1:]), strict=True):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(order, r)
                waiting[r].append(part)

        look(np.arange(n - 1))
        while order:
            r = heapq.heappop(order)
            where = np.unique(np.concatenate(waiting.pop(r)))
            where = where[rank[where] == r]
            if not len(where):
                continue
            # of overlapping occurrences (a a a) every second one counts from the left
            run = np.concatenate(([0], np.cumsum(after[where[:-1]] != where[1:])))
            place = np.arange(len(where))
            where = where[(place - place[np.searchsorted(run, run)]) % 2 == 0]
            gone = after[where]
            symbol[where] = self.merged[at[where]]
            rank[where] = rank[gone] = -1
            further = after[gone]
            after[where] = further
            inner = further < n
            before[further[inner]] = where[inner]
            left = before[where]
            # a neighbour that was merged too has its new place; what ends in a merged symbol begins at the last place before it
            look(np.unique(np.concatenate((where, left[left >= 0]))))
        kept, i = [], 0
        hop = after.tolist()
        while i < n:
            kept.append(i)
            i = hop[i]
        return symbol[kept].tolist()

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word: merge rounds over one flat array of symbols; long words by themselves."""
        long = {i for i, w in enumerate(words) if len(w) >= LONG_WORD}
        if long:
            rest = iter(self.merge([w for i, w in enumerate(words) if i not in long]))
            return [self.merge_long(w.encode()) if i in long else next(rest) for i, w in enumerate(words)]
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        word = np.repeat(np.arange(len(raw)), size)
        symbol = self.first[flat]
        ends = np.cumsum(size) - 1
        symbol[ends] = self.last[flat[ends]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = np.int64(1 << 62)
        while len(symbol):
            key = symbol[:-1] << 32 | symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.where(hit, self.ranks[at], none)
            least = np.full(int(word[-1]) + 1, none)
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least[word[starts]] = np.minimum.reduceat(np.append(rank, none), starts)
            stop = least[word] == none
            if stop.any():
                done.append((word[stop], symbol[stop]))
                go = ~stop
                both = go[:-1] & go[1:]
                kept = np.flatnonzero(go)
                if not len(kept):
                    break
                inner = both[kept[:-1]] if len(kept) > 1 else np.zeros(0, bool)
                rank, at = rank[kept[:-1]], at[kept[:-1]]
                rank = np.where(inner, rank, none)
                symbol, word = symbol[kept], word[kept]
            take = (rank == least[word[:-1]]) & (rank < none)
            # of overlapping occurrences (a a a) every second one counts from the left
            where = np.flatnonzero(take)
            run = np.concatenate(([0], np.cumsum(np.diff(where) != 1)))
            begin = where[np.searchsorted(run, run)] if len(where) else where
            where = where[(where - begin) % 2 == 0]
            symbol[where] = self.merged[at[where]]
            keep = np.ones(len(symbol), bool)
            keep[where + 1] = False
            symbol, word = symbol[keep], word[keep]
        if not done:
            return [[] for _ in raw]
        owner = np.concatenate([w for w, _ in done])
        ids = np.concatenate([s for _, s in done])[np.argsort(owner, kind="stable")]
        cuts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(raw)))))
        ids = ids.tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def units(self, text: str) -> Iterator[str | int]:
        """Added tokens as ids, all else as words."""
        if self.added_pattern is None or not any(a in text for a in self.added):
            yield from self.pieces(text)
            return
        for part in self.added_pattern.split(text):
            if part in self.added:
                yield self.added[part]
            else:
                yield from self.pieces(part)

    def encode_batch(self, texts: list[str]) -> list[list[list[int]]]:
        """For each text the ids of each of its words, in order."""
        split = [list(self.units(t)) for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        new = list(dict.fromkeys(w for s in split for w in s if w.__class__ is str and w not in self.known))
        if new:
            self.known.update(zip(new, self.merge(new), strict=True))
        known = self.known
        return [[known[w] if w.__class__ is str else [w] for w in s] for s in split]

    def decode(self, ids: list[int]) -> str:
        """As a tokenizer without a decoder does it: tokens joined by one space."""
        return " ".join(map(self.strings.__getitem__, ids))


def lower_one(c: str) -> str:
    """Lower case of one character without regard to its neighbours (a final sigma is no special case)."""
    return c.lower()


_loaded: dict[str, BatchBPE] = {}


def tokenizer(path: str) -> BatchBPE:
    """One encoder a worker and path."""
    if path not in _loaded:
        _loaded[path] = BatchBPE(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", step: int = 256) -> DataFrame:
    """(key, ids array<int>, decoded string) of every whole text."""
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>, decoded string"

    def run(batches):
        t = tokenizer(path)
        for b in batches:
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                ids = [[x for w in words for x in w] for words in t.encode_batch(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(t.decode, ids), pa.string())],
                    names=[key, "ids", "decoded"],
                )

    return docs.select(key, text_of(text).alias(text)).mapInArrow(run, schema)
