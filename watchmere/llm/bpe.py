"""BPE encoding and decoding by dynamic programming over prefixes.

The encoding of each prefix of a word ends in exactly one token. It is found among the tokens that end there, which a
suffix automaton of the vocabulary reports, as the one that is compatible with the last token of the prefix before
it: no merge crosses the seam between the two. Following those last tokens back from the end gives the ids, without
running a single merge over the text.

A null text is empty and has no ids. Texts are read whole, one at a time; encoded words are remembered in the Python
worker up to a bound, beyond which the memory starts anew. Repeated rows each get their own row, an empty table gives
an empty result, and only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from watchmere.llm.common import MEMORY_WORDS, Memory, resident, scan_rows, table
from watchmere.llm.suffix_automaton import SuffixAutomaton

VOCABULARY = "word_bpe_49k.json"
MEMORY_PAIRS = 150_000
# Words that a worker remembers in each of two generations where digests are all that it makes: some 150 MB.
DIGEST_WORDS = 300_000
FINAL = 256  # added to the last byte of a word, which has symbols of its own

# How the vocabulary file separates words, for all of Unicode, and what it takes as white space.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACES = regex.compile(r"[\t-\r\x20\x85\xa0  -     　]+")
# The same for texts that stay below U+0250, where these classes are plain ranges: letters, numbers, the rest.
LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
NARROW_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\t-\r\x20\x85\xa0{LETTERS}{NUMBERS}]+")
WIDE = re.compile("[ɐ-\U0010ffff]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others for those after U+00FF."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens as symbol sequences, the merges between them, and the suffix automaton over all of them."""

    def __init__(self, file: str, memory: int = MEMORY_WORDS):
        with open(file, encoding="utf-8") as text:
            spec = json.load(text)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        self.written: dict[int, str] = {i: t for t, i in model["vocab"].items()}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.written |= {i: t for t, i in self.special.items()}
        self.ids: dict[str, int] = model["vocab"]
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        never = len(model["merges"]) + 1
        self.never = never
        self.born: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            pair = self.ids[left], self.ids[right]
            made = self.ids[left + right]
            self.merges[pair] = rank
            if made not in self.halves:
                self.halves[made], self.born[made] = pair, rank
        self.machine = SuffixAutomaton()
        self.own: dict[int, list[tuple[int, int]]] = {}
        symbols: dict[int, list[int]] = {}
        for token, i in self.ids.items():
            final = token.endswith(suffix) and token != suffix
            body = [byte_of[c] for c in (token[: -len(suffix)] if final else token)]
            if final:
                body[-1] += FINAL
            symbols[i] = body
            self.machine.add(i, body)
        for i, body in symbols.items():
            state = 0
            for symbol in body:
                state = self.machine.next[state][symbol]
            self.own.setdefault(state, []).append((len(body), i))
        self.machine.own = []
        self.ending: dict[int, tuple[tuple[int, int], ...]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.known = Memory(memory)
        names = "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.split_special = re.compile(f"({names})") if names else None

    def tokens_at(self, state: int) -> tuple[tuple[int, int], ...]:
        """(length, id) of all tokens that end in a state, longest first."""
        found = self.ending.get(state)
        if found is None:
            shorter = self.tokens_at(self.machine.link[state]) if self.machine.link[state] > 0 else ()
            found = self.ending[state] = (*sorted(self.own.get(state, ()), reverse=True), *shorter)
        return found

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that stand at one side while `token` is put together, each with the rank that takes it up."""
        memory = self.right if side else self.left
        if token not in memory:
            out, taken = [], self.never
            at = token
            while True:
                out.append((at, taken))
                if at not in self.halves:
                    break
                taken = self.born[at]
                at = self.halves[at][side]
            memory[token] = out
        return memory[token]

    def compatible(self, first: int, second: int) -> bool:
        """Whether the two tokens, side by side, stay as they are.

        A merge across the seam happens if its two parts stand there together before its rank is past. Of equal pairs
        the leftmost is merged first, so the left part must still be free then, and the right one may be just due.
        """
        pair = (first, second)
        found = self.fits.get(pair)
        if found is None:
            merges = self.merges
            found = True
            for a, a_taken in self.edge(first, 1):
                for b, b_taken in self.edge(second, 0):
                    rank = merges.get((a, b))
                    if rank is not None and rank < a_taken and rank <= b_taken:
                        found = False
            if len(self.fits) >= MEMORY_PAIRS:
                self.fits.clear()
            self.fits[pair] = found
        return found

    def encode_word(self, word: str) -> list[int]:
        symbols = list(word.encode())
        symbols[-1] += FINAL
        moves, link, length = self.machine.next, self.machine.link, self.machine.length
        fits = self.fits
        last: list[int] = []
        steps: list[int] = []
        state = matched = 0
        for end, symbol in enumerate(symbols):
            while state and symbol not in moves[state]:
                state = link[state]
                matched = length[state]
            state = moves[state][symbol]
            matched += 1
            for size, token in self.ending.get(state) or self.tokens_at(state):
                if size > matched:
                    continue
                before = end - size
                if before < 0:
                    break
                fit = fits.get((last[before], token))
                if fit if fit is not None else self.compatible(last[before], token):
                    break
            last.append(token)
            steps.append(size)
        ids = []
        end = len(symbols) - 1
        while end >= 0:
            ids.append(last[end])
            end -= steps[end]
        ids.reverse()
        return ids

    def pieces(self, text: str) -> list[str]:
        """The words of a text as the vocabulary's own normalisation makes them."""
        if not WIDE.search(text):
            lower = text.lower()
            if not WIDE.search(lower):
                return NARROW_WORDS.findall(lower)
        lower = "".join([c.lower() for c in SPACES.sub(" ", unicodedata.normalize("NFC", text))])
        return WORDS.findall(lower)

    def forget(self) -> None:
        """Words and pairs go, the vocabulary stays."""
        self.known.forget()
        self.fits.clear()

    def _remember(self, word: str) -> tuple[int, bytes, str]:
        found = self.known.recall(word)
        if found is None:
            ids = self.encode_word(word)
            found = self.known.keep(word, (len(ids), " ".join(map(str, ids)).encode(), self.decode(ids)))
        return found

    def encoded(self, text: str) -> list[tuple[int, bytes, str]]:
        """For each word or special token its number of ids, the ids and the decoded text."""
        out = []
        remember = self._remember
        for part in self.split_special.split(text) if self.split_special and "<|" in text else [text]:
            if part in self.special:
                out.append((1, str(self.special[part]).encode(), part))
            else:
                known = self.known.young
                out += [known.get(w) or remember(w) for w in self.pieces(part)]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.encoded(text) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens are joined by spaces, special ones included."""
        return " ".join([self.written[i] for i in ids])


def vocabulary(file: str | None = None, memory: int = MEMORY_WORDS) -> Vocabulary:
    """The vocabulary, which stays in the Python worker until another large object is needed."""
    file = file or public_tokenizers.path(VOCABULARY)
    return resident((file, memory), lambda: Vocabulary(file, memory))


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str | None = None) -> DataFrame:
    """One row per document: its ids and the text that they decode to."""

    def open_scanner():
        vocab = vocabulary(file)

        def scan(text: str):
            ids = vocab.encode(text)
            return ids, vocab.decode(ids)

        scan.close = vocab.forget
        return scan

    return scan_rows(documents, [id_col], text_col, "ids array<int>, decoded string", open_scanner, as_bytes=False)


def encode_digests(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str | None = None
) -> DataFrame:
    """As `encode`, but only the number of ids and the digests of both outputs leave the task.

    The words stay remembered between tasks, as the worker needs no room for texts and ids on their way out.
    """

    def open_scanner():
        vocab = vocabulary(file, DIGEST_WORDS)

        def scan(text: str):
            parts = vocab.encoded(text)
            ids = b" ".join([p[1] for p in parts])
            decoded = " ".join([p[2] for p in parts]).encode()
            return sum([p[0] for p in parts]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

        return scan

    made = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return scan_rows(documents, [id_col], text_col, made, open_scanner, as_bytes=False)


def op3_bpe(spark: SparkSession, root: str) -> DataFrame:
    return encode_digests(table(spark, root, "documents"))
