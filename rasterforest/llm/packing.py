"""Vector bin packing of token pieces into fixed-length training sequences.

Every piece asks for three resources at once: tokens, one segment and loss-bearing
tokens. Bins are filled one after the other; the piece whose demand has the largest
dot product with what is left in the bin goes next. Packing is local to blocks of
consecutive rows, so it needs no shuffle and its memory is bounded by a block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, returning_memory

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, loss_tokens long, tokens binary"
PLACES = "example_id long, sequence_id long, position int, offset long, n_tokens long, n_loss long"
#: Bytes of text that are encoded at a time; longer texts are cut at white space.
PART_BYTES = 4 << 20


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold. A block is packed when it holds block_tokens or block_pieces."""

    tokens: int = 4096
    segments: int = 512
    loss: int = 4096
    block_tokens: int = 1 << 20
    block_pieces: int = 1 << 13


def pack_whole(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> list[list[int]]:
    """Bins of positions; no piece is cut. A piece beyond a limit gets a bin of its own.

    Pieces of equal demand are one row of the demand table, so a step costs as much as
    there are different demands.
    """
    most = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.float64)
    bins = [[int(k)] for k in np.flatnonzero((tokens > limits.tokens) | (loss > limits.loss))]
    open_ = np.flatnonzero((tokens <= limits.tokens) & (loss <= limits.loss))
    if not len(open_):
        return bins
    kinds, kind = np.unique(np.stack([tokens[open_], loss[open_]], axis=1), axis=0, return_inverse=True)
    waiting: list[list[int]] = [[] for _ in kinds]
    for k, at in zip(open_[::-1].tolist(), kind.ravel()[::-1].tolist()):
        waiting[at].append(k)
    need = np.stack([kinds[:, 0], np.ones(len(kinds)), kinds[:, 1]], axis=1).astype(np.float64)
    ids, left = np.arange(len(kinds)), len(open_)
    while left:
        room, members = most.copy(), []
        while True:
            value = np.where((need <= room).all(axis=1), need @ (room / most**2), -1.0)
            best = int(value.argmax()) if len(value) else 0
            if not len(value) or value[best] < 0:
                break
            room -= need[best]
            members.append(waiting[ids[best]].pop())
            if not waiting[ids[best]]:
                need, ids = np.delete(need, best, axis=0), np.delete(ids, best)
        left -= len(members)
        bins.append(members)
    return bins


def pack_cutting(lengths: np.ndarray, limits: Limits) -> list[list[tuple[int, int, int]]]:
    """Bins of (position, start, length); every token is loss-bearing and pieces may be cut.

    Runs of a full sequence stand alone. As a piece asks for as many loss-bearing tokens as
    tokens, the largest piece that fits has the largest dot product: pieces wait by size,
    and a bit set of the sizes finds it. What no piece fits any more is filled with the
    head of the largest open piece. A bin that stays short is split by the binary digits
    of its length, as sequences of a power of two need no padding.
    """
    cap = min(limits.tokens, limits.loss)
    bins = [[(k, s * cap, cap)] for k, n in enumerate(lengths.tolist()) for s in range(n // cap)]
    waiting: dict[int, list[tuple[int, int]]] = defaultdict(list)
    sizes = 0
    for k, n in reversed(list(enumerate(lengths.tolist()))):
        if n % cap:
            waiting[n % cap].append((k, n // cap * cap))
            sizes |= 1 << (n % cap)
    while sizes:
        room, members = cap, []
        while sizes and room and len(members) < limits.segments:
            fitting = sizes & ((2 << room) - 1)
            size = (fitting or sizes).bit_length() - 1
            n = min(size, room)
            k, start = waiting[size].pop()
            if not waiting[size]:
                sizes ^= 1 << size
            if size > n:
                waiting[size - n].append((k, start + n))
                sizes |= 1 << (size - n)
            members.append((k, start, n))
            room -= n
        bins += split_powers(members) if room else [members]
    return bins


def split_powers(members: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cut one short bin into sequences whose lengths are the powers of two in its own."""
    total, out, queue = sum(n for *_, n in members), [], members[::-1]
    for bit in reversed(range(total.bit_length())):
        want = total & (1 << bit)
        part = []
        while want:
            k, s, n = queue.pop()
            part.append((k, s, min(n, want)))
            if n > want:
                queue.append((k, s + want, n - want))
            want -= part[-1][2]
        if part:
            out.append(part)
    return out


class Encoder:
    """Token ids of texts, by way of a table of known words.

    The tokenizer lower-cases and never joins across white space or between a letter and a
    punctuation mark, so a text's ids are those of its parts. Parts are told apart and
    counted by Arrow; only parts that the table lacks reach the tokenizer. The table is kept in flat arrays and starts anew beyond known_bytes.
    """

    #: Other texts keep their case until the tokenizer sees them: their characters have one
    #: simple lower case each and no special token can come of it.
    SPECIAL = r"[^\x00-\x{12f}]|<\|"
    CLAUSE = r"([a-z\x{e0}-\x{f6}\x{f8}-\x{ff}])([.,])([ \n]|$)"
    LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"

    def __init__(self, path: str, known_bytes: int = 32 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known_bytes = known_bytes
        # How the model spells each letter: its bytes, as the pre-tokenizer writes them.
        spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.spelling = str.maketrans({c: spell(c)[0][0] for c in self.LETTERS})
        self.forget()

    def forget(self) -> None:
        # Hashes are sorted; order says which word each belongs to.
        self.hashes, self.order = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        self.words, self.sizes, self.ids = pa.array([], pa.string()), np.empty(0, dtype=np.int64), np.empty(0, dtype="<u4")

    def coded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all their ids. Words of letters only are the model's own units."""
        model, whole, out = self.tokenizer.model.tokenize, self.tokenizer.encode, []
        plain = pc.match_substring_regex(words, f"^[{self.LETTERS}]+$").to_pylist()
        for word, letters in zip(words.to_pylist(), plain):
            out.append([t.id for t in model(word.translate(self.spelling))] if letters else whole(word, add_special_tokens=False).ids)
        return np.fromiter(map(len, out), dtype=np.int64, count=len(out)), np.fromiter(chain.from_iterable(out), dtype="<u4")

    def places(self, words: pa.Array) -> np.ndarray:
        """Each word's place in the table, after new ones were added."""
        h = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)
        found = np.full(len(words), -1, dtype=np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            at = self.order[at]
            same = pc.equal(self.words.take(pa.array(at)), words).to_numpy(zero_copy_only=False)
            found[same] = at[same]
        new = np.flatnonzero(found < 0)
        if len(new):
            added = words.take(pa.array(new))
            sizes, ids = self.coded(added)
            found[new] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, added])
            self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])
            hashes, order = np.concatenate([self.hashes, h[new]]), np.concatenate([self.order, found[new]])
            by = np.argsort(hashes, kind="stable")
            self.hashes, self.order = hashes[by], order[by]
        return found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each text has."""
        special = pc.match_substring_regex(texts, self.SPECIAL)
        easy = pc.replace_substring_regex(pc.utf8_lower(texts), self.CLAUSE, r"\1 \2\3")
        parts = pc.split_pattern(pc.replace_substring(pc.if_else(special, texts, easy), "\n", " "), " ")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        words = parts.flatten().dictionary_encode()
        if self.words.nbytes + self.sizes.nbytes * 3 + self.ids.nbytes > self.known_bytes:
            self.forget()
        place = self.places(words.dictionary)[words.indices.to_numpy()]
        sizes, ends = self.sizes[place], np.cumsum(self.sizes)
        total = np.concatenate([[0], np.cumsum(sizes)])
        first = (ends - self.sizes)[place] - total[:-1]
        ids = self.ids[np.repeat(first, sizes) + np.arange(total[-1])]
        return ids, np.diff(total[bounds - bounds[0]])


def cut_long(text: str, most: int) -> list[str]:
    """The text in parts of at most so many characters, cut before a space; a longer word stays whole."""
    out, at = [], 0
    while len(text) - at > most:
        cut = text.rfind(" ", at + 1, at + most)
        cut = cut if cut > 0 else text.find(" ", at + most)
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def encoded(batch: pa.Array, encode: Encoder) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, ids per row) of runs of rows of about PART_BYTES; long texts row by row."""
    texts = pc.fill_null(batch.cast(pa.string()), "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < len(texts):
        n = int(np.searchsorted(np.cumsum(size[at : at + 8192]), PART_BYTES, side="right"))
        if n:
            yield at, *encode(texts.slice(at, n))
        else:
            n, parts = 1, []
            for part in cut_long(texts[at].as_py(), PART_BYTES):
                parts.append(encode(pa.array([part], pa.string()))[0])
            yield at, np.concatenate(parts), np.array([sum(map(len, parts))])
        at += n


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, limits: Limits = Limits()) -> DataFrame:
    """Tokenize the texts and pack all ids into sequences; one row per piece.

    Takes doc_id and text; any other columns are ignored. Null and empty texts are the
    single id end_id; a null doc_id stays null; repeated rows are packed each by itself;
    an empty table gives no rows. Texts of any length are cut into pieces freely, each id
    lies in exactly one. tokens holds the piece's ids as little-endian unsigned 32-bit.
    sequence_id is unique: the task's number and a counter within it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sequence = Encoder(tokenizer_path), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "loss_tokens")] + [("tokens", pa.binary())])

        def flush(docs: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            nonlocal sequence
            first, rows, tokens = np.cumsum(lengths) - lengths, [], []
            data = memoryview(ids.tobytes())
            for members in pack_cutting(lengths, limits):
                offset = 0
                for k, s, n in members:
                    rows.append((k, s, n, sequence, offset))
                    at = 4 * (int(first[k]) + s)
                    tokens.append(data[at : at + 4 * n].tobytes())
                    offset += n
                sequence += 1
            k, start, length, number, offset = np.array(rows, dtype=np.int64).T
            ids_of = pa.array(docs, pa.int64()).take(pa.array(k))
            return pa.RecordBatch.from_arrays([ids_of, *map(pa.array, (start, length, lengths[k], number, offset, length)), pa.array(tokens, pa.binary())], schema=schema)

        docs, sizes, parts, held = [], [], [], 0
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for at, ids, size in encoded(batch.column("text"), encode):
                ends = np.cumsum(size)
                ids, size = np.insert(ids, ends, end_id), size + 1
                row, done = 0, 0
                # Rows join the block until it is full.
                while row < len(size):
                    ends = np.cumsum(size[row:])
                    n = min(int(np.searchsorted(ends, limits.block_tokens - held)) + 1, max(1, limits.block_pieces - len(docs)), len(ends))
                    docs += names[at + row : at + row + n]
                    sizes.append(size[row : row + n])
                    parts.append(ids[done : done + int(ends[n - 1])])
                    held, done, row = held + int(ends[n - 1]), done + int(ends[n - 1]), row + n
                    if held >= limits.block_tokens or len(docs) >= limits.block_pieces:
                        yield flush(docs, np.concatenate(sizes), np.concatenate(parts))
                        docs, sizes, parts, held = [], [], [], 0
        if docs:
            yield flush(docs, np.concatenate(sizes), np.concatenate(parts))

    return in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(returning_memory(run), PIECES)


def count_tokens(texts: DataFrame, tokenizer_path: str) -> DataFrame:
    """The columns of texts with n_tokens, the number of ids of the column text (0 for null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer_path)
        for batch in batches:
            sizes = [size for _, _, size in encoded(batch.column("text"), encode)]
            yield batch.append_column("n_tokens", pa.array(np.concatenate(sizes) if sizes else [], pa.int64()))

    kept = texts.drop("n_tokens")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return in_small_batches(kept).mapInArrow(returning_memory(run), f"{fields}, n_tokens long")


def instruction_examples(conversations: DataFrame, tokenizer_path: str, loss_role: str = "assistant") -> DataFrame:
    """example_id (conv_id), n_tokens and n_loss: the tokens of all turns and of those of loss_role.

    conversations: conv_id, role, text; other columns are ignored. Null and empty texts have
    no tokens; turns with a null conv_id are one example without an id; repeated turns count
    each; an empty table gives no rows. Turns are summed before and after the shuffle, so a
    conversation of any number of turns is no task's burden.
    """
    turns = count_tokens(conversations.select(F.col("conv_id").cast("long").alias("example_id"), "role", "text"), tokenizer_path)
    loss = F.when(F.col("role") == loss_role, F.col("n_tokens")).otherwise(0)
    return turns.groupBy("example_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sum(loss).alias("n_loss"))


def pack_examples(examples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Pack whole instruction examples (example_id, n_tokens, n_loss) without cutting them.

    Blocks of block_pieces rows of a task are packed together. Null or negative counts
    count as 0. An example beyond a limit gets a sequence of its own and is never dropped.
    Repeated rows are placed each by itself; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36

        def flush(block: pd.DataFrame) -> pd.DataFrame:
            nonlocal sequence
            n, loss = (block[c].fillna(0).clip(lower=0).to_numpy(np.int64) for c in ("n_tokens", "n_loss"))
            rows = []
            for members in pack_whole(n, loss, limits):
                offset = 0
                for position, k in enumerate(members):
                    rows.append((k, sequence, position, offset))
                    offset += int(n[k])
                sequence += 1
            k, number, position, offset = np.array(rows, dtype=np.int64).T
            out = pd.DataFrame({"sequence_id": number, "position": position.astype(np.int32), "offset": offset, "n_tokens": n[k], "n_loss": loss[k]})
            out.insert(0, "example_id", block["example_id"].astype("Int64").to_numpy()[k])
            return out.astype({"example_id": "Int64"})

        block = None
        for pdf in batches:
            block = pdf if block is None else pd.concat([block, pdf])
            while len(block) >= limits.block_pieces:
                yield flush(block.iloc[: limits.block_pieces])
                block = block.iloc[limits.block_pieces :]
        if block is not None and len(block):
            yield flush(block)

    return examples.select("example_id", "n_tokens", "n_loss").mapInPandas(run, PLACES)
