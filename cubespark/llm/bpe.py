"""Byte-pair encoding of whole texts with a public vocabulary, decoding, and token counts.

``encode`` finds, for each pre-token, all vocabulary strings in it with one Aho-Corasick pass and walks over the longest
ones from left to right. A token may follow another only if merging their strings would not have crossed the border
(the pair-compatibility test); where none fits, the walk goes back one token and takes its next shorter prefix. No
position is entered twice, so the work is linear in the length, and the result equals that of merging by rank.

``count_tokens`` uses the whole-token shortcut: vocabulary strings that this encoder proves to come out as one token are
counted by a set lookup; only other pre-tokens are merged.

Nulls: a null text counts as an empty text, which has no tokens. Repeated rows are independent rows; no ties arise. Texts
of any length are encoded whole: pieces between white space are handled one at a time and remembered in a bounded table.
An empty table gives an empty table. Input columns named like a new one are replaced, all others pass through.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import unicodedata
from array import array

import ahocorasick
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .common import per_worker, with_python_columns

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pieces that a task remembers at most, and their characters; others are worked out each time (results stay the same).
MEMORY_ENTRIES, MEMORY_LENGTH = 400_000, 64
#: White space as Unicode has it. Python's own classes also hold the separators U+001C to U+001F.
WS = r"\t\n\x0b\x0c\r\x20\x85\xa0  -     　"
SEPARATORS = re.compile("[\x1c-\x1f]")
END = "￿"



# Where the Unicode tables of Python and of ``regex`` are not those of the vocabularies' library.
#: Letters and numbers of later Unicode versions, which ``regex`` knows and the library does not.
LATER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: Marks that Python's NFC reorders or composes and the library's, of an earlier version, leaves where they are.
LEFT = (
    "\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b-\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c"
    "\U00010d24-\U00010d27\U00010eab-\U00010eac\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85\U00011070"
    "\U0001133b\U0001145e\U00011839-\U0001183a\U00011930\U00011938\U0001193d-\U0001193e\U00011943\U000119e0\U00011a34"
    "\U00011a47\U00011a99\U00011d42\U00011d44-\U00011d45\U00011d97\U00011f41-\U00011f42\U00016ff0-\U00016ff1\U0001e08f"
    "\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef"
)
#: Lower case of letters whose case Python does not know yet.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: Characters that need these tables.
RARE = re.compile(f"[{LATER}{LEFT}{''.join(map(chr, LOWER))}]").search
LETTER, NUMBER, OTHER = rf"[\p{{L}}--[{LATER}]]", rf"[\p{{N}}--[{LATER}]]", rf"[[^{WS}\p{{L}}\p{{N}}]||[{LATER}]]"


def nfc(text: str) -> str:
    """NFC as the library has it."""
    return "".join(p if i % 2 else unicodedata.normalize("NFC", p) for i, p in enumerate(re.split(f"([{LEFT}])", text)))


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memory(dict):
    """Remembers ``make(key)``, for ``MEMORY_ENTRIES`` keys at most."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < MEMORY_ENTRIES and len(key) <= MEMORY_LENGTH:
            self[key] = value
        return value


class Bpe:
    """A vocabulary of the ``tokenizers`` JSON format: byte-level BPE, with or without an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.bytes_of = byte_alphabet()
        self.table = {chr(b): c for b, c in self.bytes_of.items()}
        self.trans = str.maketrans(self.table)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = model["vocab"]
        made = {self._key(a + b) if not a.endswith(self.suffix) or not self.suffix else None for a, b in merges}
        base = [t for t in map(self._key, vocab) if t not in made]
        # Inner ids: symbols first, then merges by rank, so that a smaller id always merges earlier.
        order = base + [self._key(a + b) for a, b in merges]
        inner = {t: i for i, t in enumerate(order)}
        if len(inner) != len(order):
            raise ValueError("two merges make the same token")
        self.outer = [vocab[self._name(t)] for t in order]
        self.length = [len(t) for t in order]
        self.left, self.right, self.pairs = [*range(len(order))], [*range(len(order))], {}
        for a, b in merges:
            i, j = inner[self._key(a)], inner[self._key(b)]
            k = inner[self._key(a + b)]
            self.left[k], self.right[k], self.pairs[i, j] = i, j, k
        self.shorter = [-1] * len(order)
        self.find = ahocorasick.Automaton()
        for t, i in inner.items():
            self.find.add_word(t, i)
            for n in range(len(t) - 1, 0, -1):
                if (p := inner.get(t[:n], -1)) >= 0:
                    self.shorter[i] = p
                    break
        self.find.make_automaton()
        self.fitting = Memory(lambda pair: self.fits(*pair))
        # The offset table: all token strings in one text, token i from offsets[i] to offsets[i + 1].
        names = {i: t for t, i in (vocab | self.special).items()}
        self.blob, self.offsets = "", [0]
        parts = [names.get(i, "") for i in range(max(names) + 1)]
        self.blob = "".join(parts)
        for p in parts:
            self.offsets.append(self.offsets[-1] + len(p))

    def _key(self, token: str) -> str:
        return token[: -len(self.suffix)] + END if self.suffix and token.endswith(self.suffix) else token

    def _name(self, key: str) -> str:
        return key[:-1] + self.suffix if key.endswith(END) else key

    def fits(self, a: int, b: int) -> bool:
        """Whether token b can stand right of token a: no merge across their border comes before theirs."""
        limit = 1 << 31
        while True:
            if self.pairs.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, self.right[a]
                if a == limit:
                    limit, b = b + 1, self.left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.left[b]
                if b + 1 == limit:
                    limit, a = a, self.right[a]
                    if a == limit:
                        return True

    def symbols(self, pretoken: str) -> str:
        return pretoken.encode("utf-8").decode("latin-1").translate(self.trans) + (END if self.suffix else "")

    def merge(self, pretoken: str) -> list[int]:
        """Token ids of one pre-token."""
        text = self.symbols(pretoken)
        n, length, shorter, fits, find = len(text), self.length, self.shorter, self.fitting, self.find.iter_long
        # The longest tokens from left to right; where they all fit their neighbours, they are the encoding.
        greedy = [token for _, token in find(text)]
        tokens, at, last = [], 0, -1
        for token in greedy:
            if last >= 0 and not fits[last, token]:
                break
            tokens.append(token)
            at += length[token]
            last = token
        if at < n:
            token = greedy[len(tokens)] if len(tokens) < len(greedy) else -1
        closed: set[int] = set()
        while at < n:
            while token >= 0 and (last >= 0 and not fits[last, token] or at + length[token] in closed):
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                last = token
                at += length[token]
                if at < n:
                    end, token = next(find(text, at), (-1, -1))
                    if token >= 0 and end + 1 - length[token] != at:
                        token = -1
            else:
                if last < 0:
                    raise ValueError("a symbol is not in the vocabulary")
                closed.add(at)
                token = tokens.pop()
                at -= length[token]
                last = tokens[-1] if tokens else -1
        return list(map(self.outer.__getitem__, tokens))

    def decode_words(self) -> list[str]:
        """The offset table cut into token strings."""
        o = self.offsets
        return [self.blob[o[i] : o[i + 1]] for i in range(len(o) - 1)]


class WordBpe(Bpe):
    """Lower-cased words with ends: NFC, white space dropped, letters, single digits and runs of other characters."""

    PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WS}\p{{L}}\p{{N}}]+"

    def __init__(self, path: str):
        super().__init__(path)
        self.find_words = regex.compile(self.PATTERN).findall
        self.find_rare = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{LETTER}+|{NUMBER}|{OTHER}+", regex.V1).findall
        self.cut = regex.compile(rf"[^{WS}]+").findall
        self.pieces, self.rare = Memory(self._piece), Memory(self._rare)

    def _piece(self, piece: str) -> bytes:
        if piece.isalpha():
            return array("I", self.merge(piece)).tobytes()
        if piece[-1] in ".," and piece[:-1].isalpha():
            return self.pieces[piece[:-1]] + self.pieces[piece[-1]]
        return b"".join(array("I", self.merge(w)).tobytes() for w in self.find_words(piece))

    def _rare(self, text: str) -> bytes:
        text = nfc(text).replace("Σ", "σ").translate(LOWER).lower()
        return b"".join(array("I", self.merge(w)).tobytes() for w in self.find_rare(text))

    def _mixed(self, text: str) -> bytes:
        """White space ends pre-tokens and stands between marks, so only pieces with a rare character need its tables."""
        out, plain = [], []
        for piece in self.cut(text):
            if piece.isascii() or not RARE(piece):
                plain.append(piece)
            else:
                out += [self._plain(" ".join(plain)), self.rare[piece]]
                plain = []
        return b"".join([*out, self._plain(" ".join(plain))])

    def _plain(self, text: str) -> bytes:
        if not text.isascii() and RARE(text):
            return self._mixed(text)
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")  # each character alone: no final sigma
        text = text.lower()
        return b"".join(map(self.pieces.__getitem__, self.cut(text) if SEPARATORS.search(text) else text.split()))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if "<|" not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.special_re.finditer(text):
            out += [self._plain(text[at : m.start()]), struct.pack("<I", self.special[m[0]])]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])


class TextBpe(Bpe):
    """Byte-level BPE on whole texts: a space belongs to the word that follows."""

    PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"

    def __init__(self, path: str):
        super().__init__(path)
        self.find_words = regex.compile(self.PATTERN).findall
        rare = rf"'s|'t|'re|'ve|'m|'ll|'d| ?{LETTER}+| ?{NUMBER}+| ?{OTHER}+|[{WS}]+(?![^{WS}])|[{WS}]+"
        self.find_rare = regex.compile(rare, regex.V1).findall
        self.double = re.compile(r"\s(?:\s|\Z)").search
        self.border = regex.compile(rf"(?<=[^{WS}]) (?=[^{WS}])")
        self.whole = self.one_token_strings()
        self.first, self.later = Memory(self._first), Memory(self._later)
        self.rare = Memory(lambda piece: sum(map(self._word, self.find_rare(" " + piece))))

    def one_token_strings(self) -> frozenset[str]:
        """Vocabulary strings that are one pre-token and encode alone as one token."""
        back = {c: b for b, c in self.bytes_of.items()}
        out = set()
        for name in self.decode_words():
            try:
                text = bytes(back[c] for c in name).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if text and self.find_words(text) == [text] and len(self.merge(text)) == 1:
                out.add(text)
        return frozenset(out)

    def _word(self, word: str) -> int:
        return 1 if word in self.whole else len(self.merge(word))

    def _first(self, piece: str) -> int:
        """The tokens of a piece with no space before it."""
        if piece.isalpha():
            return self._word(piece)
        if piece[-1] in ".," and piece[:-1].isalpha():
            return self.first[piece[:-1]] + 1
        return sum(map(self._word, self.find_words(piece)))

    def _later(self, piece: str) -> int:
        """The tokens of a piece with a space before it."""
        if piece.isalpha():
            return self._word(" " + piece)
        if piece[-1] in ".," and piece[:-1].isalpha():
            return self.later[piece[:-1]] + 1
        if "\n" in piece:  # a line end between two other characters is a token of its own
            lines = piece.split("\n")
            if not any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
                return self.later[lines[0]] + sum(map(self.first.__getitem__, lines[1:])) + len(lines) - 1
        return sum(map(self._word, self.find_words(" " + piece)))

    def _plain(self, text: str) -> int:
        """A space between two other characters starts a new pre-token, so pieces count on their own."""
        if not text:
            return 0
        pieces = self.border.split(text) if text[0].isspace() or self.double(text) else text.split(" ")
        if not text.isascii() and RARE(text):
            n = sum(map(self._word, (self.find_rare if RARE(pieces[0]) else self.find_words)(pieces[0])))
            return n + sum(self.later[p] if p.isascii() or not RARE(p) else self.rare[p] for p in pieces[1:])
        return sum(map(self._word, self.find_words(pieces[0]))) + sum(map(self.later.__getitem__, pieces[1:]))

    def count(self, text: str) -> int:
        if "<|" not in text:
            return self._plain(text)
        parts = self.special_re.split(text)
        return sum(map(self._plain, parts)) + len(parts) - 1

    def encode(self, text: str) -> list[int]:
        out, at = [], 0
        for m in [*self.special_re.finditer(text), None]:
            part = text[at : m.start() if m else len(text)]
            for w in (self.find_rare if RARE(part) else self.find_words)(part):
                out += self.merge(w)
            if m:
                out.append(self.special[m[0]])
                at = m.end()
        return out


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Add the ids of the whole text as little-endian unsigned 32-bit integers in one binary value."""

    def make():
        bpe = per_worker(WordBpe, path)
        return lambda texts: [[bpe.encode(t or "") for t in texts]]

    return with_python_columns(df, [text], {ids: "binary"}, make)


def _decode(words: list[str]):
    def one(ids: bytes | None) -> str:
        return " ".join(map(words.__getitem__, memoryview(ids or b"").cast("I")))

    return one


def decode(df: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Add the decoded text of such ids: the token strings, a space between them. Null ids decode as none."""

    def make():
        one = _decode(per_worker(WordBpe, path).decode_words())
        return lambda values: [[one(v) for v in values]]

    return with_python_columns(df, [ids], {text: "string"}, make)


def encode_decode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass over the table: columns ``token_ids`` and ``decoded``."""

    def make():
        bpe = per_worker(WordBpe, path)
        one = _decode(bpe.decode_words())

        def run(texts):
            ids = [bpe.encode(t or "") for t in texts]
            return [ids, [one(i) for i in ids]]

        return run

    return with_python_columns(df, [text], {"token_ids": "binary", "decoded": "string"}, make)


def count_tokens(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``n_bytes`` (of UTF-8) and ``n_tokens`` of the whole text."""

    def make():
        bpe = per_worker(TextBpe, path)
        return lambda texts: [[len((t or "").encode()) for t in texts], [bpe.count(t or "") for t in texts]]

    return with_python_columns(df, [text], {"n_bytes": "bigint", "n_tokens": "bigint"}, make)
