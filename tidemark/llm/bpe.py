"""BPE encoding and decoding with a vocabulary of word ends, by prefix-sharing trie traversal.

The encoding of a symbol sequence has, for every prefix, one last token: the token ``t`` ending
there whose neighbour before it, the last token of what is left, stands beside ``t`` when both are
merged alone. So the last tokens of a word's prefixes follow from each other, and words that share
a prefix share its states. Distinct new words of a chunk go into a trie; one depth-first walk
extends the states symbol by symbol and reads an encoding off at each word's end.

A worker keeps the encodings of words it has met, up to a bound, as packed ids.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, table

#: Pieces of text kept by a worker, and the longest that is kept: some 80 MB at most.
KEEP_WORDS, KEEP_LENGTH = 400_000, 48
LONG = 256  # symbols to which the ids of a prefix are kept with its state
CHUNK = 1 << 20  # characters of text whose new words make one trie
OUT_BYTES = 4 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=1)
def unassigned_marks() -> np.ndarray:
    """By code point: whether Python's tables do not know it, so that a pattern may class it otherwise than the library."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])


def has_unassigned(text: str) -> bool:
    marks, step = unassigned_marks(), 1 << 20  # characters looked at together
    return any(marks[np.frombuffer(text[i : i + step].encode("utf-32-le", "surrogatepass"), dtype="<u4")].any() for i in range(0, len(text), step))


class WordBpe:
    """A tokenizers file with NFC, blanks, lower case, word pattern, byte letters and a suffix at word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.ids | self.special).items()}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern, regex.V0).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        self.letters = byte_letters()
        self.codes = {i: i.to_bytes(4, "little") for i in self.names}
        self.path, self.library = path, None
        # 1: a token; 2: the end, from some symbol on, of a longer one; 3: both
        self.part = dict.fromkeys(self.ids, 1)
        for t in self.ids:
            for i in range(1, len(self.symbols(t))):
                self.part[t[i:]] = self.part.get(t[i:], 0) | 2
        self.rows: list[dict[str, bool] | None] = [None] * (max(self.names) + 2)  # by the token before; the last for none
        self.tested = 0
        self.known: dict[str, bytes] = {}
        self.prior: dict[str, bytes] = {}

    def normal(self, text: str) -> str:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # letter by letter: no final sigma

    def symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def merged(self, parts: list[str]) -> list[str]:
        """By the definition: again and again the leftmost pair of the lowest rank."""
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def beside(self, a: int, b: str) -> bool:
        """Whether the token of id ``a`` and ``b`` stay two tokens when merged alone; for -1, whether ``b`` is one."""
        parts = self.symbols(b)
        if self.merged(list(parts)) != [b]:
            return False
        return a < 0 or self.merged(self.symbols(self.names[a]) + parts) == [self.names[a], b]

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Packed ids (unsigned 32 bits, little-endian) of distinct words.

        The trie is flat: the words' letters in sorted order, which is the depth-first order of its
        nodes. A word takes over the states of the prefix that it shares with the one before.
        """
        plain, rest = {}, []
        for word in words:
            if word.isascii() and word.isprintable():
                plain[word] = word
            else:
                rest.append(word)
        letters = self.letters
        trie = plain | {"".join([letters[b] for b in word.encode("utf-8", "surrogatepass")]): word for word in rest}
        if self.tested > 400_000:
            self.rows, self.tested = [None] * len(self.rows), 0
        part, suffix, ids, rows, codes = self.part, self.suffix, self.ids, self.rows, self.codes
        found: dict[str, bytes] = {}
        path = ""  # states[d]: after the first d letters of path, the id of the last token and its start
        last, starts, packed = [-1], [0], [b""]
        for word in sorted(trie):
            top = min(len(word), len(last)) - 1
            if path[:top] != word[:top]:
                top = next(k for k in range(top) if path[k] != word[k])
                del last[top + 1 :], starts[top + 1 :], packed[top + 1 :]
            else:
                del last[top + 1 :], starts[top + 1 :], packed[top + 1 :]
            path, n = word, len(word)
            for d in range(top + 1, n + 1):
                end = suffix if d == n else ""
                ends = []
                for i in range(d - 1, -1, -1):
                    t = word[i:d] + end
                    kind = part.get(t)
                    if kind is None:
                        break
                    if kind & 1:
                        ends.append((i, t))
                    if kind == 1:
                        break
                for i, t in reversed(ends):
                    if (row := rows[last[i]]) is None:
                        row = rows[last[i]] = {}
                    if (good := row.get(t)) is None:
                        good = row[t] = self.beside(last[i], t)
                        self.tested += 1
                    if good:
                        break
                else:
                    raise ValueError(f"no token ends at {word[d - 1]!r}")
                if d < n:
                    own = ids[t]
                    last.append(own)
                    starts.append(i)
                    packed.append(packed[i] + codes[own] if d <= LONG else b"")
            back = [codes[ids[t]]]
            while i > LONG:  # a very long word: its ids are read back along the states
                back.append(codes[last[i]])
                i = starts[i]
            back.append(packed[i])
            found[trie[word]] = b"".join(reversed(back))
        return found

    def pieces(self, text: str) -> list[str]:
        """What stands between blanks of a normal text; letters newer than this Python's tables go by the library."""
        if not text.isascii() and has_unassigned(text):
            return self.by_library(text)
        text = self.normal(text)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split takes these for blanks
            return self.words(text)
        return text.split()

    def by_library(self, text: str) -> list[str]:
        from tokenizers import Tokenizer

        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
        normal = self.library.normalizer.normalize_str(text)
        back = {c: i for i, c in enumerate(self.letters)}
        return [bytes(back[c] for c in w).decode("utf-8") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def learn(self, new: set[str]) -> dict[str, bytes]:
        """Packed ids of pieces; each is one word or several."""
        words = {p: [p] if p.isalpha() or not p.isascii() and has_unassigned(p) else self.words(p) for p in new}
        known = self.encode_words({w for ws in words.values() for w in ws})
        return {p: known[ws[0]] if len(ws) == 1 else b"".join(map(known.__getitem__, ws)) for p, ws in words.items()}

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """Packed ids of whole texts, in order; null counts as empty."""
        at = 0
        while at < len(texts):
            parts, size = [], 0
            while at < len(texts) and size < CHUNK:
                text = texts[at] or ""
                parts.append([[p] if i % 2 else self.pieces(p) for i, p in enumerate(self.cut(text))])
                size += len(text) + 1
                at += 1
            met: set[str] = set()
            for doc in parts:
                met.update(*doc[::2])
            if len(self.known) > KEEP_WORDS // 2:
                # the older half goes; what it holds of this chunk moves on
                self.prior, self.known = self.known, {}
            new = met - self.known.keys()
            old = new & self.prior.keys()
            self.known.update((w, self.prior[w]) for w in old)
            mine = self.learn(new - old)
            short = {w: v for w, v in mine.items() if len(w) <= KEEP_LENGTH}
            self.known.update(short)
            look = self.known if len(short) == len(mine) else self.known | mine
            for doc in parts:
                yield b"".join(self.codes[self.special[words[0]]] if i % 2 else b"".join(map(look.__getitem__, words)) for i, words in enumerate(doc))

    def forget(self) -> None:
        """Give the memory of words met back, at the end of a task: the worker may go on with other work."""
        self.known, self.prior = {}, {}

    def decode(self, packed: bytes) -> str:
        """Tokens between blanks, as a tokenizer without decoder gives them; special tokens stay."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def _pieces(ids: list, column: list, kind: pa.DataType, names: list[str]) -> Iterator[pa.RecordBatch]:
    i = 0
    while i < len(column):
        j, size = i, 0
        while j < len(column) and size < OUT_BYTES:
            size += len(column[j])
            j += 1
        yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(column[i:j], kind)], names=names)
        i = j


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the whole text's ids as unsigned 32-bit little-endian integers in one binary.

    As the tokenizers library encodes without adding special tokens: those that stand in a text
    are found. Null and empty texts and texts of blanks give no ids. ``path`` is read on each executor.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield from _pieces(part.column("id"), list(bpe.encode_all(part.column("text").to_pylist())), pa.binary(), ["id", "ids"])
        bpe.forget()

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(each, f"id {kind}, ids binary")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """(id, ids, decoded) of (id, ids); null ids decode to the empty text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            at = 0
            texts = (bpe.decode(x.as_py() or b"") for x in batch.column("ids"))
            while at < batch.num_rows:
                held, size = [], 0
                while at + len(held) < batch.num_rows and size < OUT_BYTES:
                    held.append(next(texts))
                    size += len(held[-1])
                part = batch.slice(at, len(held))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("ids"), pa.array(held, pa.string())], names=["id", "ids", "decoded"])
                at += len(held)

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.mapInArrow(each, f"id {kind}, ids binary, decoded string")


def bpe_roundtrip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): both of the above in one pass, with one set of workers and tables."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                packed = list(bpe.encode_all(part.column("text").to_pylist()))
                for coded in _pieces(part.column("id"), packed, pa.binary(), ["id", "ids"]):
                    decoded = pa.array([bpe.decode(x.as_py()) for x in coded.column("ids")], pa.string())
                    yield pa.RecordBatch.from_arrays([*coded.columns, decoded], names=["id", "ids", "decoded"])
        bpe.forget()

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(each, f"id {kind}, ids binary, decoded string")


def vocabulary() -> str:
    """The path of the public vocabulary that the queries take."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = vocabulary()
    out = bpe_roundtrip(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return out.select(F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
