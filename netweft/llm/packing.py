"""Best-fit decreasing packing of token sequences, exact over the whole corpus and without collecting it.

Lengths are integers of at most ``capacity``, so bins with equal remaining capacity are
interchangeable and the whole best-fit-decreasing run is determined by the histogram of lengths.
The driver runs it on that histogram (at most ``capacity`` entries, whatever the input): lengths in
falling order, each going to the tightest open bin, which a segment tree over remaining capacities
finds in logarithmic time; equal steps are taken together. The outcome is a plan of runs: "pieces
with ranks r..r+k of length n go to the bins b..b+k at offset o". A piece's rank among those of its
length comes from counts by (length, salt) and a row number within each, so that no length, however
frequent, meets in one task.

Defined cases: a null text is empty and makes a piece of one token (the end token); equal rows are
packed each; documents longer than the capacity are cut into full pieces, the first being the
shorter one; an empty table gives an empty table. Extra columns of the input are not read.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_kernel, cut, slices

CAPACITY = 2048
#: Parts into which the ranks of one length are dealt: at least so many, and more where a part would have more pieces than this.
SALTS, PART = 64, 1 << 20
# Fixed value: the rule by which the vocabulary's byte-level scheme splits text before merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space that the fast splitter isn't given; it fails at about ten times as much.
BLANKS = 100_000
_LONG_RUN = re.compile(rf"\s{{{BLANKS}}}")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"


def _rank_engine_does(file: dict) -> bool:
    """Whether a tokenizers file says what the rank engine does: byte-level splits, no other steps, merges in the order of their ids."""
    model, before = file["model"], file.get("pre_tokenizer") or {}
    if (model.get("type", "BPE"), before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) != ("BPE", "ByteLevel", False, True):
        return False
    if file.get("normalizer") or file.get("post_processor") or file.get("truncation") or file.get("padding"):
        return False
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return False
    vocab, added = model["vocab"], {t["content"] for t in file.get("added_tokens", ())}
    merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    # Every token is a byte or a merge, and a merge that comes later has a larger id.
    return all(a < b for a, b in zip(merged, merged[1:])) and len(merged) + 256 == len(vocab.keys() - added)


class Encoder:
    """Ids of a tokenizers file of the byte-level kind; a call takes special strings as ordinary text, ``with_added`` doesn't.

    The file's vocabulary orders its merges, so byte-pair merging by rank gives the ids that the
    ``tokenizers`` library gives; the rank engine of ``tiktoken`` needs a fifth of the time. Its splitter
    fails on white space of about a million characters, so texts with runs of at least ``BLANKS``, and
    any others that it fails on, go to the library itself; so does everything if the file has another
    scheme than the one that the rank engine follows.
    """

    def __init__(self, vocabulary: str) -> None:
        import tiktoken

        self.vocabulary, self.whole = vocabulary, None
        with open(vocabulary, encoding="utf-8") as f:
            file = json.load(f)
        self.fast = _rank_engine_does(file)
        self.added = {t["content"]: t["id"] for t in file.get("added_tokens", ())}
        # Tokens that take in blanks or stand alone only are left to the library.
        self.plain = not any(t.get(k) for t in file.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.split = re.compile("(" + "|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None
        # The scheme writes printable bytes of Latin-1 as themselves, the others as the characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
        ranks = {bytes(byte[c] for c in token): k for token, k in file["model"]["vocab"].items() if token not in self.added} if self.fast else {}
        if self.fast:
            self.encode = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        return self.packed(self.ordinary(text))

    def with_added(self, text: str) -> bytes:
        """The same with the file's added tokens recognised, as the library does by default."""
        if self.split is None or not any(c in text for c in self.added):
            return self(text)
        if not self.plain or not self.fast:
            return self.packed(self.by_library(text, added=True))
        parts = self.split(text)  # every second one is a token
        return self.packed([i for k, x in enumerate(parts) for i in ([self.added[x]] if k % 2 else self.ordinary(x))])

    def packed(self, found: list[int]) -> bytes:
        ids = array("I", found)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def ordinary(self, text: str) -> list[int]:
        if self.fast and (len(text) < BLANKS or not _LONG_RUN.search(text)):
            try:
                return self.encode(text)
            except BaseException as e:
                if type(e).__name__ != "PanicException":  # it derives from BaseException, as interrupts do
                    raise
        return self.by_library(text)

    def by_library(self, text: str, added: bool = False) -> list[int]:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.vocabulary)
        self.whole.encode_special_tokens = not added
        return self.whole.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece of each document's ids, the end token 0 included."""
    cached: list[Encoder] = []
    count = [0]

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        if not cached:
            cached.append(Encoder(vocabulary))
        for part in slices(batch, "text"):
            out: list[tuple] = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                data = cached[0].with_added(text or "") + b"\0\0\0\0"
                n = len(data) // 4
                first = n % capacity or capacity
                starts = [0, *range(first, n, capacity)]
                for k, start in enumerate(starts):
                    stop = first if not k else start + capacity
                    crc = zlib.crc32(data[4 * start : 4 * stop])
                    # Equal rows too are dealt apart: the piece's place in its task enters.
                    count[0] += 1
                    out.append((doc_id, k, start, stop - start, crc, (crc ^ count[0] * 2654435761) & 0x7FFFFFFF))
            yield {n: [x[k] for x in out] for k, n in enumerate(("doc_id", "piece", "start", "length", "ids_crc32", "salt"))}

    return arrow_kernel(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), PIECES, rows)


class CapacityTree:
    """A segment tree over remaining capacities 0..capacity that counts open bins."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, remaining: int, n: int) -> None:
        k = remaining + self.size
        while k:
            self.tree[k] += n
            k >>= 1

    def tightest(self, least: int) -> int:
        """The smallest remaining capacity of at least ``least`` that some open bin has, or -1."""
        k = least + self.size
        if self.tree[k]:
            return least
        while k > 1:
            if not k & 1 and self.tree[k + 1]:  # the right sibling holds larger capacities only
                k += 1
                while k < self.size:
                    k = 2 * k if self.tree[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return -1


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces, first bin, offset), and the number of bins.

    Each run puts ``pieces`` successive ranks of a length into as many successive bins.
    """
    tree = CapacityTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = {}  # runs of bin numbers by remaining capacity, the last one first to go
    plan, bins = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            new = room < 0
            if new:  # no open bin takes this length
                first, k, room = bins, left, capacity
            else:
                first, k = open_bins[room].pop()
                tree.add(room, -k)
            # A bin that took a piece is now the tightest, so it takes as many as it has room for before the next one.
            full = room // length
            used = min(k, max(1, left // full))
            each = min(full, left)
            if new:
                bins += used
            elif used < k:
                open_bins[room].append((first + used, k - used))
                tree.add(room, k - used)
            for j in range(each):
                plan.append((length, rank, used, first, capacity - room + j * length))
                rank, left = rank + used, left - used
            if rest := room - each * length:
                open_bins.setdefault(rest, []).append((first, used))
                tree.add(rest, used)
    return plan, bins


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (as ``pieces`` gives them) with ``sequence_id`` and ``offset``."""
    spark = parts.sparkSession
    parts = cut(parts, "pieces")
    # At most capacity rows: of lengths with many pieces, the number of parts.
    many = parts.groupBy("length").count().where(F.col("count") > SALTS * PART).toArrow().to_pydict()
    salts = F.lit(SALTS)
    if many["length"]:
        salts = F.coalesce(F.create_map(*[F.lit(x) for n, c in zip(many["length"], many["count"], strict=True) for x in (n, -(-c // PART))])[F.col("length")], salts)
    parts = parts.withColumn("salt", (F.col("salt") % salts).cast("int"))
    # At most capacity * SALTS rows, and one for every PART pieces.
    counts = parts.groupBy("length", "salt").count().toArrow().sort_by([("length", "ascending"), ("salt", "ascending")])
    length, salt, count = (counts.column(c).to_numpy() for c in ("length", "salt", "count"))
    firsts = np.flatnonzero(np.concatenate([[True], length[1:] != length[:-1]])) if len(length) else np.zeros(0, int)
    before = np.cumsum(count) - count
    base = before - np.repeat(before[firsts], np.diff(np.append(firsts, len(length))))
    totals = np.add.reduceat(count, firsts) if len(firsts) else count
    plan, _ = best_fit_decreasing(dict(zip(length[firsts].tolist(), totals.tolist(), strict=True)), capacity)
    # One row for each (length, salt): the rank its pieces start at, and the runs that its ranks meet.
    runs = np.array(plan, np.int64).reshape(-1, 5)
    falling, bounds, some = -runs[:, 0], [0], []
    for n, start, c in zip(length.tolist(), base.tolist(), count.tolist(), strict=True):
        a, b = np.searchsorted(falling, [-n, -n + 1])
        x, y = np.searchsorted(runs[a:b, 1], start, "right") - 1, np.searchsorted(runs[a:b, 1], start + c, "left")
        some.append(runs[a + x : a + y])
        bounds.append(bounds[-1] + int(y - x))
    flat = np.concatenate(some) if some else runs
    struct = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(1, 5)], ["rank", "k", "bin", "offset"])
    table = pa.table({"length": pa.array(length, pa.int64()), "salt": pa.array(salt, pa.int32()), "base": pa.array(base, pa.int64()), "runs": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), struct)})
    runs_df = spark.createDataFrame(table)  # as many rows as counts has; pieces are dealt by the same columns, so only these rows move
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = parts.withColumn("n", F.row_number().over(within) - 1).join(runs_df, ["length", "salt"])
    rank = F.col("base") + F.col("n")
    run = F.filter("runs", lambda x: (x["rank"] <= rank) & (rank < x["rank"] + x["k"]))[0]
    return (
        ranked.withColumn("run", run)
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("run.bin") + rank - F.col("run.rank")).alias("sequence_id"), F.col("run.offset").alias("offset"))
    )
