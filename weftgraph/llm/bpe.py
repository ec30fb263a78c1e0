"""BPE encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

A sequence of tokens is the merge result of its text exactly if every two neighbours are compatible: merging the text
of the two alone gives the two back. So a word is encoded left to right: at each place take the longest token that
starts there (one Aho-Corasick pass finds all tokens) and is compatible with the one before; if none is, the place is
dead and the token before it is shortened. No place is tried twice after it died, which keeps the time linear. Shorter
tokens at a place are prefixes of the longest one there, so a pass keeps that one and a table leads to the next.

Compatibility is looked up in a table that fills as pairs turn up. An entry is computed by walking the merges at the
boundary in rank order: if a merge across the boundary comes due before the two tokens are complete, they don't fit.

Words with end marks (a suffix such as ``</w>`` on a word's last symbol) are handled by a second alphabet: the last
symbol of a word is another symbol than the same one inside.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import chain

import ahocorasick
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.labelled import documents
from weftgraph.llm.workers import left, strings, task

#: Words and pieces whose ids an encoder remembers, and the longest that it does. Both bound memory, not results.
CACHE, CACHED_CHARS = 600_000, 64
#: Words and pieces whose number of tokens an encoder remembers, and pairs of tokens of which it does whether they fit.
COUNTED, FITS = 1_200_000, 2_000_000
#: The split pattern whose words hold no white space and don't depend on what stands beside it: text can be cut there.
APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Distance of the alphabet of last symbols from that of inner ones.
LAST = 0x10000
#: Place reached by no rank.
NEVER = 1 << 60

# Where the library's Unicode tables are other ones than those of Python and of the regex module.
#: Letters and numbers of later versions, which its split takes for neither.
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x16FF4, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: Combining marks of later versions, and one vowel sign that composes: its normal form neither orders nor joins them.
UNORDERED = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF),
    (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47),
    (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)
#: Capitals of later versions as (first, last, distance of the small letter), and the Greek letter that ends no word.
CAPITALS = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B), (0x3A3, 0x3A3, 0x20))


def _class(ranges: tuple[tuple[int, int], ...]) -> str:
    return "[" + "".join(f"{regex.escape(chr(a))}-{regex.escape(chr(b))}" for a, b in ranges) + "]"


#: Any symbol but those below the combining marks, and dashes, quotation marks, dots and the euro sign: these are in normal form in any company.
_COMPOSING = re.compile("[^\0-\u02ff\u2010-\u2027\u20ac]")
_LATER, _UNORDERED = regex.compile(_class(LATER)), regex.compile("(" + _class(UNORDERED) + ")")
_SMALL = {c: c + d for a, b, d in CAPITALS for c in range(a, b + 1)}


def normal(text: str) -> str:
    """The library's normal form, but for white space: NFC, then lower case symbol by symbol."""
    if text.isascii() or not _COMPOSING.search(text):
        return text.lower()
    parts = _UNORDERED.split(text)  # such a mark parts what stands before it from what follows
    joined = "".join(unicodedata.normalize("NFC", p) for p in parts) if len(parts) > 1 else unicodedata.normalize("NFC", text)
    return joined.translate(_SMALL).lower()


def byte_symbols() -> list[str]:
    """Printable symbol of each byte in byte-level vocabularies: printable Latin-1 stands for itself, others follow at 256."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table, extra = [""] * 256, 256
    for b in range(256):
        if b in own:
            table[b] = chr(b)
        else:
            table[b], extra = chr(extra), extra + 1
    return table


class Remembered(dict):
    """What a function gave for arguments of at most CACHED_CHARS symbols: ``most`` of them, those used lately when more turn up."""

    def __init__(self, function: Callable, most: int):
        super().__init__()
        self.function, self.half, self.older = function, most // 2, {}

    def __missing__(self, key):
        got = self.older.get(key)
        if got is None:
            got = self.function(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[key] = got
        return got


class WordBpe:
    """A word-level BPE tokenizer read from the JSON that the tokenizers library writes.

    Supported: NFC, white-space replacement and lower-casing, a split pattern whose matches are the words, byte-level
    symbols, an end-of-word suffix, special tokens that are cut out of the raw text, and no decoder (tokens are joined
    by a blank). Anything else in the file is refused.
    """

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or model["dropout"] or model["continuing_subword_prefix"] or model["ignore_merges"] or steps != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or spec["decoder"]:
            raise ValueError("unsupported tokenizer file")
        self.suffix = model["end_of_word_suffix"] or ""
        self.words, self.apart = regex.compile(split["pattern"]["Regex"]), split["pattern"]["Regex"] == APART
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.symbols = byte_symbols()
        vocab = model["vocab"]
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self._merges(vocab, pairs)
        self._offsets({**vocab, **self.special})
        self.cache = Remembered(self._encode_piece, CACHE)
        self.counts = Remembered(self._count_piece, COUNTED)

    def _inner(self, token: str) -> str:
        """A token over the two alphabets."""
        if self.suffix and token.endswith(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + LAST)
        return token

    def _merges(self, vocab: dict[str, int], pairs: list[tuple[str, str]]) -> None:
        """Rank of each pair, halves of each merged token, and the trie of tokens that merging can reach."""
        size = max(vocab.values()) + 1
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.made: list[int] = [-1] * size
        self.fits = Remembered(lambda pair: self._crossing(*pair) is None, FITS)
        reached = [False] * size
        merged = set()
        for rank, (a, b) in enumerate(pairs):
            whole = vocab[a + b]
            self.rank[vocab[a], vocab[b]] = rank
            if whole not in merged:
                merged.add(whole)
                self.halves[whole], self.made[whole] = (vocab[a], vocab[b]), rank
        for token, i in vocab.items():
            if i not in merged and len(self._inner(token)) == 1:
                reached[i] = True
        for a, b in pairs:
            i, l, r = vocab[a + b], vocab[a], vocab[b]
            reached[i] = reached[i] or (reached[l] and reached[r] and self._crossing(l, r) == (l, r))
        self.trie, inners = ahocorasick.Automaton(), {self._inner(token): i for token, i in vocab.items() if reached[i]}
        self.length, self.shorter = [0] * size, [-1] * size
        for inner, i in inners.items():
            self.trie.add_word(inner, (len(inner) - 1, i))
            self.length[i] = len(inner)
            self.shorter[i] = next((inners[inner[:n]] for n in range(len(inner) - 1, 0, -1) if inner[:n] in inners), -1)
        self.trie.make_automaton()

    def _crossing(self, left: int, right: int) -> tuple[int, int] | None:
        """The first merge across the boundary of two tokens, as the pair that merges; None if the two stay apart."""
        lefts, rights = [left], [right]
        while (h := self.halves[lefts[-1]]) is not None:
            lefts.append(h[1])
        while (h := self.halves[rights[-1]]) is not None:
            rights.append(h[0])
        i, j = len(lefts) - 1, len(rights) - 1
        while True:
            up_left = self.made[lefts[i - 1]] if i else NEVER
            up_right = self.made[rights[j - 1]] if j else NEVER
            across = self.rank.get((lefts[i], rights[j]), NEVER)
            if across < up_left and across <= up_right and across != NEVER:
                return lefts[i], rights[j]
            if not i and not j:
                return None
            if up_left <= up_right:
                i -= 1
            else:
                j -= 1

    def _offsets(self, vocab: dict[str, int]) -> None:
        """Token texts in one buffer: token i is at buffer[offset[i]:offset[i + 1]]."""
        texts = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            texts[i] = token.encode("utf-8")
        self.buffer, self.offset = b"".join(texts), [0]
        for t in texts:
            self.offset.append(self.offset[-1] + len(t))
        self.digits = [str(i) for i in range(len(texts))]

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Token ids of one word of normalised text."""
        if word.isascii() and word.isprintable() and " " not in word:
            s = word  # these symbols stand for themselves
        else:
            symbols = self.symbols
            s = "".join([symbols[b] for b in word.encode("utf-8")])
        if self.suffix:
            s = s[:-1] + chr(ord(s[-1]) + LAST)
        longest = {end - n: i for end, (n, i) in self.trie.iter(s)}  # token at each place; ends ascend, so the longest comes last
        length, shorter, fits = self.length, self.shorter, self.fits
        at, size, before, path = 0, len(s), -1, []
        dead: set[int] = set()
        token = longest.get(0, -1)
        while at < size:
            while token >= 0 and (before >= 0 and not fits[before, token] or at + length[token] in dead):
                token = shorter[token]
            if token >= 0:
                path.append(token)
                at, before = at + length[token], token
                token = longest.get(at, -1)
            elif path:
                dead.add(at)
                last = path.pop()
                at, before, token = at - length[last], path[-1] if path else -1, shorter[last]
            else:
                raise ValueError(f"no encoding of {word!r}")
        return tuple(path)

    def _words(self, text: str) -> list[str]:
        """Words of normalised text."""
        if self.apart and text.isascii() and text.isalpha():
            return [text]
        if text.isascii() or not _COMPOSING.search(text) or not _LATER.search(text):  # the first is quicker
            return self.words.findall(text)
        masked = _LATER.sub("\ue000", text)  # neither letter, number nor blank, as they are to the library
        return [text[m.start() : m.end()] for m in self.words.finditer(masked)]

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece. A word alone is a piece that the pattern matches whole, so pieces and words share the memory."""
        words = self._words(piece) if self.apart else [piece]
        return self.encode_word(piece) if words == [piece] else tuple(chain.from_iterable(map(self.cache.__getitem__, words)))

    def _segment(self, text: str) -> list[int]:
        """Ids of text without special tokens."""
        return list(chain.from_iterable(map(self.cache.__getitem__, self._pieces(text))))

    def encode(self, text: str) -> list[int]:
        if self.specials is None or not any(t in text for t in self.special):
            return self._segment(text)
        ids: list[int] = []
        for part in self.specials.split(text):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                ids += self._segment(part)
        return ids

    def _pieces(self, text: str) -> list[str]:
        """Text without special tokens, normalised and cut between blanks and line ends; for other split patterns its words."""
        text = normal(text)
        return text.replace("\n", " ").split(" ") if self.apart else self._words(text)

    def _count_piece(self, piece: str) -> int:
        """Tokens of a piece, remembered as its ids would be."""
        words = self._words(piece) if self.apart else [piece]
        return len(self.encode_word(piece)) if words == [piece] else sum(map(self.counts.__getitem__, words))

    def count(self, text: str) -> int:
        """The length of ``encode(text)``, without its ids."""
        if self.specials is None or not any(t in text for t in self.special):
            return sum(map(self.counts.__getitem__, self._pieces(text)))
        return sum(1 if part in self.special else sum(map(self.counts.__getitem__, self._pieces(part))) for part in self.specials.split(text))

    def decode(self, ids: list[int]) -> bytes:
        buffer, offset = self.buffer, self.offset
        return b" ".join([buffer[offset[i] : offset[i + 1]] for i in ids])


def vocabulary(path: str | None = None) -> str:
    """The tokenizer file's text; by default the public word-level vocabulary of the installed package."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def shared(source: str) -> WordBpe:
    """One encoder for tasks that encode one after another in a Python worker, with what it remembers."""
    return left("bpe", source, lambda: WordBpe(source))


def token_counter(docs: DataFrame, path: str | None = None):
    """Tokens of a text as an Arrow-batched column function; nulls count as empty. A worker keeps the encoder for the next such task."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = shared(held.value)
        for texts in batches:
            yield pa.array([bpe.count(t) for t in strings(texts)], pa.int64())

    return F.arrow_udf(task(counted, "bpe"), "long")


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and ``ids`` where asked for.

    Null texts count as empty and have no tokens. Repeated rows are encoded alike. An empty table gives no rows. Long
    texts are encoded whole; a task holds one batch of texts and one document's ids, and a Python worker keeps its encoder
    for the next such task. The vocabulary (under 2 MB, fixed) is read on the driver and broadcast. Other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def encoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = shared(held.value)
        digits = bpe.digits
        for frame in frames:
            counts, hashes, back, kept = [], [], [], []
            for t in frame.pop("text"):
                ids = bpe.encode(t)
                counts.append(len(ids))
                hashes.append(sha256(" ".join([digits[i] for i in ids]).encode()).hexdigest())
                back.append(sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(ids)
            frame["n_tokens"], frame["ids_sha256"], frame["decoded_sha256"] = counts, hashes, back
            if with_ids:
                frame["ids"] = kept
            yield frame

    rows = documents(docs, doc_id, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(task(encoded, "bpe"), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
