"""BPE encoding and decoding by speculation and verification.

A word is first cut greedily into the longest tokens that match. Such a cut is
the word's BPE encoding exactly when no merge would have crossed any of its
inner borders, and whether one would depends on the two tokens at the border
alone. Every pair of neighbours in a batch is tested at once on arrays of
token ids; only words with a failing pair are merged step by step.

Why two tokens suffice: until a first merge crosses a border, each side is
merged as if it stood alone, so what touches the border is always a part on the
right edge of the left token and one on the left edge of the right token. Two
parts that touch at some time merge if the pair has a rule and the rule ranks
before those that build each part's next larger one (at equal rank the left
pair goes first).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm.common import open_points, small_text_batches, text_of

WORD_END = "</w>"
END = "\ue000"  # stands for the word end while a word is cut
SYMBOL, LETTER = "\ue001", "\u4e00"  # a code point of private use, neither letter nor digit nor space; a letter without case
NEVER = int(np.iinfo(np.int64).max)


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level BPE files write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordBpe:
    """A word-level BPE tokenizer file: encodes whole texts and decodes ids."""

    #: Words whose encoding one Python worker keeps, and letters in them; gathered anew beyond either.
    KEPT, KEPT_LETTERS = 300_000, 6_000_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.vocab = {self._marked(t): i for t, i in model["vocab"].items()}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.letters = {b: c for b, c in byte_alphabet().items()}
        self._rules(model["merges"])
        self.path, self.own = path, None
        self.stand_ins: dict[str, str] = {}
        self.known: dict[str, tuple[int, str, str]] = {}
        self.letters_known = 0

    @staticmethod
    def _marked(token: str) -> str:
        return token[: -len(WORD_END)] + END if token.endswith(WORD_END) else token

    def _rules(self, merges: list) -> None:
        n = max(self.vocab.values()) + 1
        self.size = n
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        self.rank = np.full(n, -1, np.int64)  # of the rule that builds a token; letters have none
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for k, rule in enumerate(merges):
            a, b = rule.split(" ") if isinstance(rule, str) else rule
            a, b = self.vocab[self._marked(a)], self.vocab[self._marked(b)]
            whole = self.vocab[self._join(a, b)]
            self.merge.setdefault((a, b), (k, whole))
            if self.rank[whole] < 0:
                self.left[whole], self.right[whole], self.rank[whole] = a, b, k
        pairs = np.array([a * n + b for a, b in self.merge], np.int64)
        order = np.argsort(pairs)
        self.pair_keys = pairs[order]
        self.pair_ranks = np.array([k for k, _ in self.merge.values()], np.int64)[order]
        # a token that its own letters don't merge to can't be proposed
        for t in [t for t, i in self.vocab.items() if len(t) > 1 and self.rank[i] >= 0 and not self._whole(i)]:
            del self.vocab[t]
        self.reach: dict[str, int] = {}  # the longest token by its first three letters
        for t in self.vocab:
            self.reach[t[:3]] = max(len(t), self.reach.get(t[:3], 0))

    def _join(self, a: int, b: int) -> str:
        return self._marked(self.token[a]) + self._marked(self.token[b])

    def _whole(self, i: int) -> bool:
        """Whether the parts of ``i`` never merge across their border before the rule of ``i``."""
        a, b, own = int(self.left[i]), int(self.right[i]), int(self.rank[i])
        over_a = over_b = NEVER
        while True:
            k = self.merge.get((a, b))
            if k and k[0] < own and k[0] < over_a and k[0] <= over_b:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                over_a, a = ra, int(self.right[a])
            else:
                over_b, b = rb, int(self.left[b])

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For arrays of neighbours, whether no merge crosses the border between them."""
        a, b = a.copy(), b.copy()
        over_a, over_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        while len(at):
            key = a[at] * self.size + b[at]
            slot = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            k = np.where(self.pair_keys[slot] == key, self.pair_ranks[slot], NEVER)
            crossed = (k < over_a[at]) & (k <= over_b[at]) & (k < NEVER)
            good[at[crossed]] = False
            at = at[~crossed]
            ra, rb = self.rank[a[at]], self.rank[b[at]]
            live = (ra >= 0) | (rb >= 0)
            at, ra, rb = at[live], ra[live], rb[live]
            of_a = ra > rb
            x, y = at[of_a], at[~of_a]
            over_a[x], a[x] = ra[of_a], self.right[a[x]]
            over_b[y], b[y] = rb[~of_a], self.left[b[y]]
        return good

    def greedy(self, word: str) -> list[int] | None:
        """The longest tokens from the left; ``word`` ends with the end mark."""
        ids, at, n, vocab, reach = [], 0, len(word), self.vocab, self.reach
        while at < n:
            for end in range(min(n, at + reach.get(word[at : at + 3], 2)), at, -1):
                if end != n - 1 and (i := vocab.get(word[at:end])) is not None:
                    ids.append(i)
                    at = end
                    break
            else:
                return None
        return ids

    def exact(self, word: str) -> list[int]:
        """Merge step by step, the best-ranked pair and of those the leftmost first; a heap holds the pairs, so long words take little more a letter."""
        rules = self.merge
        ids = [self.vocab[c] for c in [*word[:-2], word[-2:]]]
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(rules[p][0], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in rules]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            right = after[k]
            if ids[k] != a or right < 0 or ids[right] != b:
                continue  # a merge has changed one of the two since
            ids[k], ids[right] = rules[a, b][1], -1
            after[k] = after[right]
            if after[k] >= 0:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] >= 0 and (pair := (ids[left], ids[after[left]])) in rules:
                    heapq.heappush(heap, (rules[pair][0], left, *pair))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The encoding of each word: proposals, one check of all borders, exact merges for the rest."""
        spelled = ["".join(map(self.letters.__getitem__, w.encode("utf-8"))) + END for w in words]
        found = [self.greedy(w) for w in spelled]
        flat = np.array([i for ids in found for i in ids or ()], np.int64)
        sizes = np.array([len(ids or ()) for ids in found], np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = owner[:-1] == owner[1:]
        pairs, back = np.unique(flat[:-1][inner] * self.size + flat[1:][inner], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)[back]
        failing = np.zeros(len(words), bool)
        failing[owner[:-1][inner][~good]] = True
        failing |= sizes == 0
        for k in np.flatnonzero(failing):
            found[k] = self.exact(spelled[k])
        return found

    def library(self):
        """The tokenizers library's own object, for what only its Unicode tables tell."""
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_file(self.path)
        return self.own

    def stand_in(self, point: str) -> str:
        """A code point that the tokenizer's pattern takes like ``point``, which only it may know."""
        if point not in self.stand_ins:
            cut = self.library().pre_tokenizer.pre_tokenize_str
            joins = [c for c in (LETTER, SYMBOL) if len(cut(c + point)) == 1]
            self.stand_ins[point] = joins[0] if joins else "1"
        return self.stand_ins[point]

    def words(self, text: str) -> list[str]:
        """Words of normalised text; white space separates words and is dropped, whatever its run.

        Texts with code points that Python's Unicode tables leave open are
        normalised by the library, and such a point counts as its tables have it.
        """
        if open_points(text):
            text = self.library().normalizer.normalize_str(text)
            shown = text.translate({ord(c): self.stand_in(c) for c in open_points(text)})
            return [text[m.start() : m.end()] for m in self.pattern.finditer(shown)]
        return self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def pieces(self, text: str) -> list[str]:
        """Words of a text; the strings of special tokens stand as they are."""
        if self.cut_special and "<|" in text:
            parts = self.cut_special.split(text)
            return [w for p in parts for w in ([p] if p in self.special else self.words(p))]
        return self.words(text)

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words.difference(self.known) if w not in self.special]
        if len(self.known) + len(fresh) > self.KEPT or self.letters_known > self.KEPT_LETTERS:
            self.known, self.letters_known = {}, 0
            fresh = [w for w in words if w not in self.special]
        self.letters_known += sum(map(len, fresh))
        for w, i in self.special.items():
            self.known[w] = (1, str(i), w)
        for w, ids in zip(fresh, self.encode_words(fresh) if fresh else []):
            self.known[w] = (len(ids), " ".join(map(str, ids)), " ".join(map(self.token.__getitem__, ids)))

    def encode(self, text: str) -> list[int]:
        cut = self.pieces(text)
        self.learn(set(cut))
        return [int(i) for w in cut for i in self.known[w][1].split()]

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens are joined by one space, special ones too."""
        return " ".join(self.token[i] for i in ids if i in self.token)

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, their digest and the digest of the decoded text, for each text."""
        cut = [self.pieces(t) for t in texts]
        self.learn({w for words in cut for w in words})
        out = []
        for words in cut:
            parts = [self.known[w] for w in words]
            ids = " ".join([p[1] for p in parts]).encode()
            decoded = " ".join([p[2] for p in parts]).encode("utf-8")
            out.append((sum([p[0] for p in parts]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        return out


_tokenizers: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    if path not in _tokenizers:
        _tokenizers[path] = WordBpe(path)
    return _tokenizers[path]


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids, decoded`` for every row; a null text is empty and has no ids."""
    small_text_batches(docs.sparkSession)

    @F.pandas_udf("ids array<int>, decoded string")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path)
        for batch in texts:
            ids = [bpe.encode(t) for t in batch]
            yield pd.DataFrame({"ids": ids, "decoded": [bpe.decode(i) for i in ids]})

    out = F.col("out")
    return docs.select(F.col(key).alias("doc_id"), encode(text_of(text)).alias("out")).select("doc_id", out["ids"].alias("ids"), out["decoded"].alias("decoded"))


def encode_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row.

    A null or empty text has no ids, and its digests are those of the empty
    string. Repeated rows give repeated rows, an empty table an empty result;
    other columns are not read. Nothing is shuffled.
    """
    small_text_batches(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path)
        for batch in texts:
            yield pd.DataFrame(bpe.digests(batch.tolist()), columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(key).alias("doc_id"), digest(text_of(text)).alias("out")).select("doc_id", "out.*")
