"""BPE encoding and decoding with a word-level vocabulary, by tree concatenation.

Text is cut at ASCII white space into chunks; no token spans such a cut, so a chunk's ids do not
depend on its neighbours. Texts are taken some megabytes at a time as Arrow arrays: each different chunk
is cut into words once, each different word is encoded once (and cached per worker, bounded), and words
are strung to chunks and chunks to texts by array operations. A long unsplit run is a single word to
the vocabulary and would cost its encoder one long pass: it is cut into leaves, the leaves are encoded
in parallel by Spark, and neighbours are joined pairwise up a tree. At each join a window around
the border is encoded anew and grown until its first and last tokens are those the two sides had;
then every pair of adjacent tokens occurs in some correct encoding, which makes the whole correct.

Rows: null text is the empty text (no ids, digests of the empty string). Repeated rows and repeated
ids each give a row; an empty table gives none. Extra columns are not read.
"""
from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, functions as F

from prosopo.llm.common import texts
from prosopo.session import cut_lineage

LONG_RUN = 4096      #: a run of so many characters without white space is encoded as a tree
LEAF = 512           #: symbols of a leaf
CACHE = 300_000      #: chunks, and words, kept per worker
SLICE = 4 << 20      #: bytes of text encoded at once; a longer text is taken alone
#: How the vocabulary file splits normalised text; fixed value. Other files are encoded chunk by chunk.
KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The steps of the normaliser that goes with it; on the text below they only lower the case, as ``str.lower`` does.
KNOWN_NORMALIZER = ["NFC", "Replace", "Lowercase"]
#: Words, and the line feed that ends a chunk, which itself holds no ASCII white space.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+|\n")
#: Not in the text whose splitting is the same in every version of Unicode, Basic Latin to Latin Extended-B.
_NOT_LATIN = r"[^\x{0}-\x{24f}]"

DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The character a byte-level vocabulary writes for each byte: itself if printable, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


#: Numbers of ids, ids in decimal and decoded texts of some texts, chunks or words.
Parts = tuple[np.ndarray, pa.Array, pa.Array]


def room(cache: dict) -> None:
    """Drops the oldest quarter of a full cache."""
    if len(cache) >= CACHE:
        for k in list(islice(cache, max(CACHE // 4, 1))):
            del cache[k]


def listed(made: list[tuple[int, bytes, bytes]]) -> Parts:
    n, ids, text = zip(*made) if made else ((), (), ())
    return np.array(n, np.int64), pa.array(ids, pa.large_binary()), pa.array(text, pa.large_binary())


def mixed(first: pa.Array, a: Parts, b: Parts) -> Parts:
    """The parts of ``a`` where ``first`` holds and those of ``b`` elsewhere, each in their order."""
    if not len(a[0]):
        return b
    first = first.to_numpy(zero_copy_only=False)
    at = np.where(first, np.cumsum(first) - 1, len(a[0]) + np.cumsum(~first) - 1)
    return np.concatenate((a[0], b[0]))[at], *(pa.concat_arrays([x, y]).take(pa.array(at)) for x, y in zip(a[1:], b[1:]))


def strung(parts: Parts, places: np.ndarray, bounds: np.ndarray) -> Parts:
    """The parts at ``places`` one after the other, from each bound to the next; parts without an id count for nothing."""
    n, ids, text = parts
    some = n[places] > 0
    bounds = np.concatenate(([0], np.cumsum(some)))[bounds]
    places = places[some]
    total = np.concatenate(([0], np.cumsum(n[places])))[bounds]
    ends, taken, blank = pa.array(bounds, pa.int32()), pa.array(places), pa.scalar(b" ", pa.large_binary())
    return np.diff(total), *(pc.binary_join(pa.ListArray.from_arrays(ends, x.take(taken)), blank) for x in (ids, text))


class WordBpe:
    """The encoder of one vocabulary file: ids, token strings and the tree for long words."""

    _loaded: dict[str, "WordBpe"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {tuple(p): i for i, p in enumerate(pairs)}
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.special_texts = special
        self.chunks: dict[str, tuple[int, bytes, bytes]] = {}
        self.words_seen: dict[str, bytes] = {}
        by_id = {i: t.encode() for t, i in self.vocab.items()}
        self.tokens = listed([(1, b"%d" % i, by_id.get(i, b"")) for i in range(max(by_id, default=-1) + 1)])
        # a decoder would join tokens its own way; without one they are joined by blanks, chunk by chunk or not
        self.by_chunks = spec.get("decoder") is None
        split = [p.get("pattern", {}).get("Regex") for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        steps = [n.get("type") for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.by_words = self.by_chunks and split == [KNOWN_SPLIT, None] and steps == KNOWN_NORMALIZER
        self.letters = byte_letters()

    @classmethod
    def load(cls, path: str) -> "WordBpe":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    # -- whole texts ---------------------------------------------------------------------

    def plain(self, text: str) -> tuple[int, bytes, bytes]:
        """(number of ids, ids in decimal, decoded text) of a text or chunk."""
        return self.made(self.tok.encode(text, add_special_tokens=False).ids)

    def made(self, ids: list[int]) -> tuple[int, bytes, bytes]:
        return len(ids), " ".join(map(str, ids)).encode(), self.tok.decode(ids, skip_special_tokens=False).encode()

    def word(self, word: str) -> bytes:
        """Ids (32 bits each) of a word of the pre-tokeniser: the model alone, on the word's bytes as the vocabulary writes them."""
        if (got := self.words_seen.get(word)) is None:
            shown = word if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode()))
            got = array("i", [t.id for t in self.tok.model.tokenize(shown)]).tobytes()
            room(self.words_seen)
            self.words_seen[word] = got
        return got

    def chunk(self, chunk: str) -> tuple[int, bytes, bytes]:
        """A chunk that is not cut into words here."""
        if (got := self.chunks.get(chunk)) is None:
            got = self.plain(chunk)
            room(self.chunks)
            self.chunks[chunk] = got
        return got

    def latin_chunks(self, chunks: pa.Array) -> Parts:
        """Chunks from Basic Latin to Latin Extended-B, each different word of them encoded once."""
        lines = pc.binary_join(pa.ListArray.from_arrays([0, len(chunks)], chunks), pa.scalar("\n", pa.large_string()))[0].as_py()
        words = pa.array(_WORDS.findall(lines.lower() + "\n") if len(chunks) else [], pa.large_string()).dictionary_encode()
        places, ids, bounds, end = words.indices.to_numpy(), bytearray(), array("q", [0]), -1
        for k, word in enumerate(words.dictionary.to_pylist()):
            if word == "\n":
                end = k
            else:
                ids += self.word(word)
            bounds.append(len(ids))
        made = strung(self.tokens, np.frombuffer(ids, np.int32), np.frombuffer(bounds, np.int64) // 4)
        return strung(made, places, np.concatenate(([0], np.flatnonzero(places == end) + 1)))

    def split_texts(self, texts: pa.Array) -> Parts:
        """Texts without special tokens, each different chunk of them encoded once."""
        cut = pc.ascii_split_whitespace(texts)
        chunks = cut.values.dictionary_encode()
        different = chunks.dictionary
        odd = pc.match_substring_regex(different, _NOT_LATIN) if self.by_words else pa.array(np.ones(len(different), bool))
        made = mixed(odd, listed([self.chunk(c) for c in different.filter(odd).to_pylist()]), self.latin_chunks(different.filter(pc.invert(odd))))
        return strung(made, chunks.indices.to_numpy(), cut.offsets.to_numpy())

    def encode_texts(self, texts: pa.Array) -> Parts:
        """Whole texts (large_string), none of them null."""
        whole = pa.array(np.full(len(texts), not self.by_chunks))
        for token in self.special_texts:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        return mixed(whole, listed([self.plain(t) for t in texts.filter(whole).to_pylist()]), self.split_texts(texts.filter(pc.invert(whole))))

    def encode(self, text: str) -> tuple[int, bytes, bytes]:
        n, ids, decoded = self.encode_texts(pa.array([text], pa.large_string()))
        return int(n[0]), ids[0].as_py(), decoded[0].as_py()

    # -- the tree ------------------------------------------------------------------------

    def words(self, text: str) -> Iterator[list[str]]:
        """The symbols of each word of a text that has no special token."""
        for word, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text)):
            yield [*word[:-1], word[-1] + self.end]

    def leaf(self, symbols: list[str]) -> list[str]:
        """Tokens of some symbols: the best-ranked adjacent pair is merged first, the leftmost of equals."""
        part, n = list(symbols), len(symbols)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := self.rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if part[i] != a or j >= n or part[j] != b or not part[j]:
                continue
            part[i], part[j] = a + b, ""
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for left, right in ((prv[i], i), (i, nxt[i])):
                if left >= 0 and right < n and (r := self.rank.get((part[left], part[right]))) is not None:
                    heapq.heappush(heap, (r, left, part[left], part[right]))
        return [p for p in part if p]

    def symbols(self, tokens: list[str]) -> list[str]:
        out: list[str] = []
        for t in tokens:
            body, end = (t[:-len(self.end)], self.end) if self.end and t.endswith(self.end) and len(t) > len(self.end) else (t, "")
            out += [*body[:-1], body[-1] + end]
        return out

    def join(self, left: list[str], right: list[str]) -> list[str]:
        """Tokens of two adjacent parts of one word: the window grows until both sides agree."""
        if not left or not right:
            return left + right
        size = 2
        while True:
            a, b = left[-size:], right[:size]
            fresh = self.leaf(self.symbols(a + b))
            if (size >= len(left) or fresh[0] == a[0]) and (size >= len(right) or fresh[-1] == b[-1]):
                return left[:-size] + fresh + right[size:]
            size *= 2

    def tree(self, parts: list[list[str]]) -> list[str]:
        """Joins encoded neighbours pairwise, level by level."""
        while len(parts) > 1:
            parts = [self.join(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in their order, of ``SLICE`` bytes together or one longer text each time."""
    before = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(before, before[at] + SLICE, "right")) - 1)
        yield texts[at:end]
        at = end


def digest(made: tuple[int, bytes, bytes]) -> tuple[int, str, str]:
    return made[0], hashlib.sha256(made[1]).hexdigest(), hashlib.sha256(made[2]).hexdigest()


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                   long_run: int = LONG_RUN, leaf: int = LEAF) -> DataFrame:
    """One row per document: its id, n_tokens, and digests of its ids and of the text decoded from them.

    Documents with an unsplit run of ``long_run`` characters take the parallel tree; the others are
    encoded where they are read, without a shuffle.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    runs: Column = F.col("text").rlike(f"[^ \\t-\\r]{{{long_run}}}")

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.load(path)
        for batch in batches:
            whole = batch.column(1).fill_null("").cast(pa.large_string())   # cast before it is sliced: some array functions misread a slice that is cast
            made = [digest(m) for part in slices(whole) for m in zip(*(x.tolist() for x in bpe.encode_texts(part)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([m[0] for m in made], pa.int64()), *(pa.array([m[k] for m in made], pa.string()) for k in (1, 2))],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per leaf of a long word, and per word that is none: (row, place, word, tokens or symbols)."""
        bpe = WordBpe.load(path)
        for batch, values in texts(batches):
            for row, text in zip(batch.column(batch.schema.get_field_index("row")).to_pylist(), values):
                leaves: list[tuple[int, bool, list[str]]] = []   # (word, still to be encoded, symbols or tokens)
                for k, part in enumerate(bpe.special.split(text) if bpe.special else [text]):
                    words = [[part]] if k % 2 else bpe.words(part)
                    for symbols in words:
                        word = leaves[-1][0] + 1 if leaves else 0
                        leaves += [(word, not k % 2, symbols[at:at + leaf]) for at in range(0, len(symbols), leaf)]
                out = {"row": [row] * len(leaves), "place": list(range(len(leaves))), "word": [x[0] for x in leaves],
                       "open": [x[1] for x in leaves], "tokens": [x[2] for x in leaves]}
                yield pa.RecordBatch.from_pydict(out, LEAVES)

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.load(path)
        for batch in batches:
            got = batch.to_pydict()
            got["tokens"] = [bpe.leaf(t) if o else t for o, t in zip(got["open"], got["tokens"])]
            yield pa.RecordBatch.from_pydict(got, LEAVES)

    def joined(table: pa.Table) -> pa.Table:
        bpe = WordBpe.load(path)
        got = table.sort_by("place").to_pydict()
        by_word: dict[int, list[list[str]]] = {}
        for word, tokens in zip(got["word"], got["tokens"]):
            by_word.setdefault(word, []).append(tokens)
        ids = [bpe.tok.token_to_id(t) for word in sorted(by_word) for t in bpe.tree(by_word[word])]
        n, a, b = digest(bpe.made(ids))
        return pa.table({"row": [got["row"][0]], "n_tokens": [n], "ids_sha256": [a], "decoded_sha256": [b]})

    short = rows.where(~runs).mapInArrow(direct, f"id {kind}, {DIGEST}")
    # numbered once, in a written table: a second evaluation could number them another way
    long = cut_lineage(rows.where(runs).withColumn("row", F.monotonically_increasing_id()), "bpe-long")
    leaves = (long.select("row", "text").mapInArrow(cut, "row long, place long, word long, open boolean, tokens array<string>")
              .repartition(F.col("row"), F.floor(F.col("place") / 16))
              .mapInArrow(encode_leaves, "row long, place long, word long, open boolean, tokens array<string>"))
    done = leaves.groupBy("row").applyInArrow(joined, f"row long, {DIGEST}")
    empty = hashlib.sha256(b"").hexdigest()
    slow = (long.select("id", "row").join(done, "row", "left")
            .select("id", F.coalesce("n_tokens", F.lit(0).cast("long")).alias("n_tokens"),
                    *(F.coalesce(c, F.lit(empty)).alias(c) for c in ("ids_sha256", "decoded_sha256"))))
    return short.union(slow).withColumnRenamed("id", id_col)


LEAVES = pa.schema([("row", pa.int64()), ("place", pa.int64()), ("word", pa.int64()), ("open", pa.bool_()), ("tokens", pa.list_(pa.string()))])
