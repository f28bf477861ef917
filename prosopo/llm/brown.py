"""Language-model scoring with class-based bigrams: P(word | word before) = P(class | class before) P(word | class).

Texts are cut into blocks of at most ``BLOCK`` tokens. A block holds its own dictionary and its tokens as places in it, so what is
shuffled is a row a block and different word, never a row a token, and a word as common as one likes is a row a block.

Classes come from exchange: a word goes to the class that raises the likelihood of the class bigrams most. Words are taken by frequency. The
``core`` most frequent ones are exchanged in rounds, half of them a round, as long as the likelihood rises; in a round tasks add up
how often each core word stands before and after each class, and those core x classes numbers decide. All further words - their number
grows with the corpus - start in the last class, with the rest, and are exchanged once, from the classes of all their
neighbours: their counts meet in one task a word, sorted, and are added up as they stream by. Gains are compared to six places, ties go to
the lower class, so classes do not depend on how rows are dealt.

Probabilities: a word that training does not hold has probability ``u``, the share of words seen once (Good-Turing), wherever it stands; known words
share 1 - u. Class transitions are smoothed by ``mu`` counts dealt by class frequency; emission is a word's share of its class. Over the
known words and the one unknown they add up to 1 in every context.

Rows: null, empty and blank texts are one end token. Texts of any length are cut over blocks and keep their context. Repeated and null
ids are rows of their own. Without any training token every word is unknown (base and score 0). An empty table gives no
row. Extra columns are not read.
"""
from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from prosopo.llm.common import own_rows, ship
from prosopo.session import bucket_count, bucketed, cut_lineage

BLOCK = 1 << 20      #: tokens of a block, at most
PLACE_BITS = 21      #: a block's dictionary has fewer than 2^21 words: at most one for each of its tokens and contexts
BLOCK_BITS = 20      #: a task makes fewer than 2^20 blocks
CLASS_BITS = 10      #: fewer than 2^10 classes
CLASSES = 32
CORE = 2048          #: words that are exchanged in rounds: the most frequent ones
ROUNDS = 8           #: rounds of exchanging core words, at most
PART = 64            #: core words whose counts travel in one row
WORDS = 4096         #: further words that are exchanged at once
END = b"\n"          #: the end token: no word holds a line end
_BLOCKS = "block long, words array<string>, counts array<long>, rows array<long>, ids array<long>, held array<boolean>, sizes array<long>, tokens binary"


class Places(dict):
    """Places by word, in order of first sight."""
    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self)
        return out


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()      # bytes know A-Z and the blanks 09-0D, 20 only


def token_blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks of (row, id, held, text). A piece is its context, the token before it, then its tokens; counts are of training tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << BLOCK_BITS
        places, tokens, pieces = Places(), array("I"), []

        def out() -> pa.RecordBatch:
            nonlocal number
            ids, sizes = np.frombuffer(tokens, np.uint32), np.array([p[3] for p in pieces], np.int64)
            starts = np.cumsum(sizes) - sizes
            learn = np.repeat([not p[2] for p in pieces], sizes)
            learn[starts] = False                # a context is counted where it stands as a token
            batch = pa.RecordBatch.from_pydict({
                "block": pa.array([number], pa.int64()), "words": pa.array([[w.decode() for w in places]], pa.list_(pa.string())),
                "counts": pa.array([np.bincount(ids[learn], minlength=len(places))], pa.list_(pa.int64())),
                "rows": pa.array([[p[0] for p in pieces]], pa.list_(pa.int64())), "ids": pa.array([[p[1] for p in pieces]], pa.list_(pa.int64())),
                "held": pa.array([[p[2] for p in pieces]], pa.list_(pa.bool_())), "sizes": pa.array([sizes], pa.list_(pa.int64())),
                "tokens": pa.array([ids.tobytes()], pa.binary())})
            number += 1
            return batch

        for batch in batches:
            for row, id_, held, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                found, at = [*words_of(text), END], 0
                while at < len(found):
                    if len(tokens) >= size:
                        yield out()
                        places, tokens, pieces = Places(), array("I"), []
                    part = found[at:at + size - len(tokens)]
                    pieces.append((row, id_, held, 1 + len(part)))
                    tokens.append(places[found[at - 1] if at else END])
                    tokens.extend(map(places.__getitem__, part))
                    at += len(part)
        if pieces:
            yield out()

    return rows.select("row", "id", "held", "text").mapInArrow(run, _BLOCKS)


def bigrams(sizes: list[int], held: list[bool], tokens: bytes, learn: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places before, places, start of each piece in them) of a block's tokens; of its training pieces only with ``learn``."""
    ids, sizes_ = np.frombuffer(tokens, np.uint32), np.asarray(sizes, np.int64)
    first = np.zeros(len(ids), bool)
    first[np.cumsum(sizes_) - sizes_] = True
    keep = ~first
    if learn:
        keep &= ~np.repeat(np.asarray(held, bool), sizes_)
    at = np.flatnonzero(keep)
    return ids[at - 1], ids[at], np.cumsum(sizes_ - 1) - (sizes_ - 1)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(grid: np.ndarray) -> float:
    """The part of the log likelihood that depends on the classes, of the counts of class pairs."""
    return float(xlogx(grid).sum() - xlogx(grid.sum(axis=0)).sum() - xlogx(grid.sum(axis=1)).sum())


def gains(after: np.ndarray, before: np.ndarray, own: np.ndarray, near: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """(words, classes): the likelihood that each word adds in each class, once it has been taken out of its own.

    ``after`` and ``before`` count a word's neighbours by class (words, classes), ``own`` how often it follows itself, ``near`` is its
    class, ``grid`` the counts of class pairs with the word in it.
    """
    n, k = after.shape
    at, col = np.arange(n), np.arange(k)
    grid = grid.astype(np.float64)
    after, before, own = after.astype(np.float64), before.astype(np.float64), own.astype(np.float64)
    s, p = after.copy(), before.copy()           # neighbours other than the word itself
    s[at, near] -= own
    p[at, near] -= own
    out = np.zeros((n, k))

    def side(mine: np.ndarray, all_mine: np.ndarray, other: np.ndarray, cells: np.ndarray) -> None:
        # cells[c] are the counts of pairs of class c and each class b in which the word may be put
        w, c = np.nonzero(mine)
        row = np.arange(len(w))
        cell, then = cells[c], xlogx(cells)[c]
        cell[row, near[w]] -= all_mine[w, c]
        home = np.flatnonzero(c == near[w])
        cell[home] -= other[w[home]]
        cell[home, near[w[home]]] += own[w[home]]
        then[row, near[w]] = xlogx(cell[row, near[w]])
        then[home] = xlogx(cell[home])
        term = xlogx(cell + mine[w, c][:, None]) - then
        term[row, c] = 0                         # pairs within b: below
        if len(w):
            found, starts = np.unique(w, return_index=True)
            out[found] += np.add.reduceat(term, starts, axis=0)

    side(s, after, before, grid.T)
    side(p, before, after, grid)
    inner = np.repeat(np.diag(grid)[None, :], n, axis=0)
    inner[at, near] -= after[at, near] + before[at, near] - own
    out += xlogx(inner + s + p + own[:, None]) - xlogx(inner)
    for total, counts in ((grid.sum(axis=1), after.sum(axis=1)), (grid.sum(axis=0), before.sum(axis=1))):
        rest = np.repeat(total[None, :], n, axis=0)
        rest[at, near] -= counts
        out -= xlogx(rest + counts[:, None]) - xlogx(rest)
    return out


def best_classes(after: np.ndarray, before: np.ndarray, own: np.ndarray, near: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Each word's best class: its own unless another one gains, compared to six places; ties to the lower class."""
    g = np.round(gains(after, before, own, near, grid), 6)
    best = g.argmax(axis=1)
    at = np.arange(len(g))
    return np.where(g[at, best] > g[at, near], best, near)


def core_pairs(blocks: DataFrame, core: dict[str, int]) -> DataFrame:
    """(pairs, counts) of each block's training bigrams, written once: core words by number, all others as one more number.

    Pairs are sorted and held as their differences, which are small and compress well.
    """
    size = len(core) + 1
    shared = blocks.sparkSession.sparkContext.broadcast(core)      # bounded by the parameter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            for r in batch.to_pylist():
                word = np.array([get(w, size - 1) for w in r["words"]], np.uint32)
                one, two, _ = bigrams(r["sizes"], r["held"], r["tokens"], True)
                pairs, counts = np.unique(word[one] * np.uint32(size) + word[two], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([np.diff(pairs, prepend=np.uint32(0)).astype("<u4").tobytes()], pa.binary()), pa.array([counts.astype("<u4").tobytes()], pa.binary())], ["pairs", "counts"])

    return cut_lineage(blocks.select("words", "sizes", "held", "tokens").mapInArrow(run, "pairs binary, counts binary"), "brown-pairs", compression="zstd")


def core_counts(pairs: DataFrame, size: int, classes: np.ndarray, k: int) -> np.ndarray:
    """(size, 2k + 1): how often each core word, and as the last row all others, stand before and after each class and before themselves.

    ``size`` and the classes are bounded by parameters; what a task adds up is size x classes numbers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, 2 * k + 1))
        for batch in batches:
            for keys, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                one, two = np.divmod(np.cumsum(np.frombuffer(keys, "<u4"), dtype=np.int64), size)
                n = np.frombuffer(n, "<u4").astype(np.float64)           # exact below 2 ** 53
                total[:, :k] += np.bincount(one * k + classes[two], n, minlength=size * k).reshape(size, k)
                total[:, k:2 * k] += np.bincount(two * k + classes[one], n, minlength=size * k).reshape(size, k)
                total[:, 2 * k] += np.bincount(one[one == two], n[one == two], minlength=size)
        parts, whole = range(0, size, PART), total.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([whole[i:i + PART].tobytes() for i in parts], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["part", "counts"])

    kind = "part long, counts binary"
    summed = pairs.mapInArrow(run, kind).repartition("part").mapInArrow(add, kind)
    found = np.zeros((size, 2 * k + 1), np.int64)
    for part, counts in summed.collect():
        rows = np.frombuffer(bytes(counts), np.int64).reshape(-1, 2 * k + 1)
        found[part:part + len(rows)] = rows
    return found


def exchange_core(blocks: DataFrame, core: dict[str, int], k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of each core word and, last, of the rest; counts of class pairs) after the rounds."""
    size, pairs = len(core), core_pairs(blocks, core)
    classes = np.append(np.minimum(np.arange(size), k - 1), k - 1)       # the most frequent ones apart, all others together
    best = (-np.inf, classes, None)
    for number in range(rounds + 1):
        counts = core_counts(pairs, size + 1, classes, k)
        grid = np.zeros((k, k), np.int64)
        np.add.at(grid, classes, counts[:, :k])
        value = likelihood(grid.astype(np.float64))
        if value <= best[0] + 1e-6:
            break
        best = (value, classes, grid)
        mine = np.arange(number % 2, size, 2)
        if number == rounds or not len(mine):
            break
        classes = classes.copy()
        classes[mine] = best_classes(counts[mine, :k], counts[mine, k:2 * k], counts[mine, 2 * k], best[1][mine], grid)
        if (classes == best[1]).all():
            # nothing gained in this half; the other one had its turn before unless this is the first round
            if number:
                break
    return best[1], best[2]


def exchange_rest(blocks: DataFrame, core: dict[str, int], classes: np.ndarray, grid: np.ndarray, k: int) -> DataFrame:
    """(word, c, cls) of all training words: core words as they are, each other one exchanged once from the class of the rest."""
    size = len(core)
    shared = blocks.sparkSession.sparkContext.broadcast((core, classes.astype(np.int64), grid))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core_, classes_, _ = shared.value
        for batch in batches:
            for r in batch.to_pylist():
                word = np.array([core_.get(w, size) for w in r["words"]], np.int64)
                one, two, _ = bigrams(r["sizes"], r["held"], r["tokens"], True)
                one, two = one.astype(np.int64), two.astype(np.int64)
                cls, rest, wide = classes_[word], word == size, 2 * k + 1
                a, b = rest[one], rest[two]
                keys, n = np.unique(np.concatenate([one[a] * wide + cls[two[a]], two[b] * wide + k + cls[one[b]], one[a & (one == two)] * wide + 2 * k]), return_counts=True)
                at = keys // wide
                found, starts = np.unique(at, return_index=True)
                entries = ((keys % wide) << PLACE_BITS | n).astype("<u4")         # a count in a block has at most 20 digits
                ends = np.append(starts, len(keys)).astype(np.int32) * 4
                packed = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(entries.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array([r["words"][i] for i in found.tolist()], pa.string()), packed], ["word", "entries"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, grid_ = shared.value
        wide = 2 * k + 1
        open_word, open_counts = None, np.zeros(wide, np.int64)     # the last word of a batch may go on in the next one

        def out(words: list[str], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(words), WORDS):
                c = counts[at:at + WORDS]
                best = best_classes(c[:, :k], c[:, k:2 * k], c[:, 2 * k], np.full(len(c), k - 1), grid_)
                yield pa.RecordBatch.from_arrays([pa.array(words[at:at + WORDS], pa.string()), pa.array(c[:, k:2 * k].sum(axis=1)), pa.array(best.astype(np.int32))], ["word", "c", "cls"])

        for batch in batches:
            for start in range(0, batch.num_rows, 4 * WORDS):
                part = batch.slice(start, 4 * WORDS)
                words, n = part.column(0), part.num_rows
                new = np.ones(n, bool)
                new[1:] = pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)
                run = np.cumsum(new) - 1
                binary = part.column(1)
                entries = np.frombuffer(b"".join(binary.to_pylist()), "<u4").astype(np.int64)
                owner = np.repeat(run, pc.binary_length(binary).to_numpy() // 4)
                flat = owner * wide + (entries >> PLACE_BITS)
                counts = np.bincount(flat, weights=entries & ((1 << PLACE_BITS) - 1), minlength=(run[-1] + 1) * wide).astype(np.int64).reshape(-1, wide)
                names = words.filter(pa.array(new)).to_pylist()
                if open_word is not None:
                    if names[0] == open_word:
                        counts[0] += open_counts
                    else:
                        yield from out([open_word], open_counts[None, :])
                open_word, open_counts = names[-1], counts[-1].copy()
                yield from out(names[:-1], counts[:-1])
        if open_word is not None:
            yield from out([open_word], open_counts[None, :])

    rest = (blocks.select("words", "sizes", "held", "tokens").mapInArrow(count, "word string, entries binary")
            .repartition("word").sortWithinPartitions("word").mapInArrow(decide, "word string, c long, cls int"))
    return rest


def emission(blocks: DataFrame, words: DataFrame, buckets: int) -> DataFrame:
    """(block, c, cls) in the blocks' buckets: counts and classes of each block's dictionary, in its order; class -1 and count 0 are unknown.

    What is shuffled is two numbers a word: its block and place in one, its count and class in the other.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []

        def out() -> pa.RecordBatch:
            found = np.concatenate(parts)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([(found >> CLASS_BITS).astype("<i8").tobytes()], pa.binary()),
                                               pa.array([((found & ((1 << CLASS_BITS) - 1)) - 1).astype("<i4").tobytes()], pa.binary())], ["block", "c", "cls"])

        for batch in batches:
            numbers, found = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            numbers = numbers >> PLACE_BITS
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if block is not None and numbers[a] != block:
                    yield out()
                    parts = []
                block = int(numbers[a])
                parts.append(found[a:b])
        if block is not None:
            yield out()

    listed = blocks.select("block", F.posexplode("words").alias("pos", "word")).select((F.shiftleft("block", PLACE_BITS) + F.col("pos")).alias("at"), "word")
    known = words.select("word", (F.shiftleft("c", CLASS_BITS) + F.col("cls") + 1).alias("found"))
    named = (listed.join(known, "word", "left").select("at", F.coalesce("found", F.lit(0)).cast("long").alias("found"))
             .repartition(buckets, F.shiftright("at", PLACE_BITS)).sortWithinPartitions("at"))
    return bucketed(named.mapInArrow(run, "block long, c binary, cls binary"), ["block"], buckets, "brown-emission")


def transitions(coded: DataFrame, k: int) -> np.ndarray:
    """Counts of class pairs in training tokens: k x k numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                cls = np.frombuffer(r["cls"], "<i4").astype(np.int64)
                one, two, _ = bigrams(r["sizes"], r["held"], r["tokens"], True)
                total += np.bincount(cls[one] * k + cls[two], minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["pair", "n"])

    out = np.zeros(k * k, np.int64)
    for pair, n in coded.select("sizes", "held", "tokens", "cls").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        out[pair] = n
    return out.reshape(k, k)


@dataclass
class Model:
    """Training tokens, different words, words seen once, and the class pairs; everything by word stays in tables."""
    n: int
    v: int
    once: int
    grid: np.ndarray
    mu: float

    def unknown(self) -> float:
        return min(0.5, (self.once + 1) / (self.n + 2)) if self.n else 1.0

    def log_transitions(self) -> np.ndarray:
        """(k + 1, k + 1) log10 of P(class | class before), the unknown class last; 0 towards the unknown class, whose emission says it all."""
        k = len(self.grid)
        share = self.grid.sum(axis=0) / max(self.n, 1)
        p = np.zeros((k + 1, k + 1))
        p[:k, :k] = (self.grid + self.mu * share[None, :]) / (self.grid.sum(axis=1) + self.mu)[:, None]
        p[k, :k] = share
        p[:, :k] *= 1 - self.unknown()
        p[:, k] = 1
        return np.log10(np.maximum(p, 1e-300))

    def log_emissions(self, c: np.ndarray, cls: np.ndarray) -> np.ndarray:
        whole = np.append(self.grid.sum(axis=0), 0)
        known = cls >= 0
        return np.where(known, np.log10(np.maximum(c, 1) / np.maximum(whole[cls], 1)), np.log10(self.unknown()))

    def log_base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.n + 1 * (self.v + 1)))


def scored(coded: DataFrame, model: Model) -> DataFrame:
    """(row, id, held, n_tokens, n_known, base_score, score) of each piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = model.log_transitions()
        for batch in batches:
            for r in batch.to_pylist():
                c, cls = np.frombuffer(r["c"], "<i8"), np.frombuffer(r["cls"], "<i4")
                one, two, starts = bigrams(r["sizes"], r["held"], r["tokens"], False)
                values = moves[cls[one], cls[two]] + model.log_emissions(c, cls)[two]      # -1 is the last row and column
                columns = [np.asarray(r["sizes"]) - 1, *(np.add.reduceat(x, starts) for x in ((c > 0).astype(np.int64)[two], model.log_base(c)[two], values))]
                yield pa.RecordBatch.from_arrays([pa.array(r["rows"], pa.int64()), pa.array(r["ids"], pa.int64()), pa.array(r["held"], pa.bool_()), *map(pa.array, columns)],
                                                 ["row", "id", "held", "n_tokens", "n_known", "base_score", "score"])

    return coded.mapInArrow(run, "row long, id long, held boolean, n_tokens long, n_known long, base_score double, score double")


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, core: int = CORE,
                rounds: int = ROUNDS, block: int = BLOCK, mu: float | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are log10 probabilities.

    ``held_out`` says, of the column ``id``, which rows are not learned from; NULL counts as false.
    """
    if not 0 < core < 65536 or not 1 < classes < 1 << CLASS_BITS or not 0 < block <= BLOCK:
        raise ValueError(f"core must lie in 1..65535, classes in 2..{(1 << CLASS_BITS) - 1}, block in 1..{BLOCK}")
    spark = ship(docs.sparkSession)
    buckets = bucket_count(spark)
    rows = own_rows(docs, id_col, text_col).withColumn("held", F.coalesce(held_out, F.lit(False)))
    blocks = bucketed(token_blocks(rows, block), ["block"], buckets, "brown-blocks", compression="zstd")
    counted = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("e")).select("e.words", "e.counts").where("counts > 0")
    counted = cut_lineage(counted.groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("c")), "brown-words")
    n, v, once = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("c") == 1)).first()
    top = counted.orderBy(F.col("c").desc(), "word").limit(core).collect()      # bounded by the parameter
    names = {r["word"]: i for i, r in enumerate(top)}
    grid = np.zeros((classes, classes), np.int64)
    if names:
        near, grid = exchange_core(blocks, names, classes, rounds)
        rest = exchange_rest(blocks, names, near, grid, classes)
        known = spark.createDataFrame([(r["word"], r["c"], int(near[i])) for i, r in enumerate(top)], "word string, c long, cls int")
        words = cut_lineage(known.union(rest), "brown-classes")
    else:
        words = spark.createDataFrame([], "word string, c long, cls int")
    coded = (blocks.select("block", "rows", "ids", "held", "sizes", "tokens")
             .join(emission(blocks, words, buckets).hint("shuffle_hash"), "block").drop("block"))
    if names:
        grid = transitions(coded, classes)
    model = Model(int(n), int(v), int(once), grid, float(classes if mu is None else mu))
    sums = (F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score"))
    return (scored(coded, model).groupBy("row", "id", "held").agg(*sums)
            .select("id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score"))
