"""Best-fit packing of tokenised documents into fixed-length sequences, improved by swap-based local search.

Documents are tokenised where they lie; only the lengths of pieces move. Pieces as long as a sequence are sequences of
their own. The others are dealt by a hash of their row into groups of bounded size; a group is packed best-fit
decreasing and then improved: documents move, swap one for one, or two for one between underfull bins wherever that
raises the sum of squared fills, until no bin can be emptied. Bins that stay underfull in their group are opened again
and packed together in a second round over far fewer pieces, and so on while that empties bins.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import stored, texts_of

SEQUENCE = 1024
END_ID = 2
_encoders: dict[str, object] = {}


def encoder(path: str):
    """An encoder for a byte-level BPE file: the ranks file of the same vocabulary, which gives the same ids faster, where it is
    beside it; else the tokenizers file itself."""
    if path not in _encoders:
        import base64
        import os

        ranks = path.removesuffix(".json") + ".tiktoken"
        if path.endswith(".json") and os.path.exists(ranks):
            import json

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            with open(path, encoding="utf-8") as f:
                added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
            enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=added)
            _encoders[path] = lambda text: enc.encode(text, allowed_special="all") if any(t in text for t in added) else enc.encode_ordinary(text)
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            _encoders[path] = lambda text: tok.encode(text, add_special_tokens=False).ids
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """Cut every document (ids of its text, then END_ID) into pieces of at most `size` tokens; the first may be shorter.

    A null text is empty, so that its document is the single END_ID. Rows stay apart even if their doc_id is equal or null.
    """
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.asarray([*encode(text.as_py() or ""), END_ID], "<u4")
                start, length = 0, len(ids) % size or size
                for k in range(-(-len(ids) // size)):
                    for column, value in zip(out, (doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        column.append(value)
                    start, length = start + length, size
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    frame = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts_of(frame).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Best-fit decreasing: items by length, longest first, each into the fullest bin that still has room for it."""
    room: list[list[int]] = [[] for _ in range(size + 1)]  # bins by what is left in them
    open_rooms: list[int] = []  # those of the lists that hold a bin, sorted
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        k = bisect.bisect_left(open_rooms, need)
        if k < len(open_rooms):
            left = open_rooms[k]
            b = room[left].pop()
            if not room[left]:
                del open_rooms[k]
        else:
            left, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        left -= need
        if not room[left]:
            bisect.insort(open_rooms, left)
        room[left].append(b)
    return bins


def fewest(lengths: np.ndarray, size: int) -> int:
    """A lower bound of the bins that items need: items that fill more than half a bin each need one, and so does all volume.

    For every limit up to half a bin: items above size - limit are alone, those above half a bin have a bin each, and what
    items of limit and more don't find room for beside them needs bins of its own.
    """
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    volume = count * np.arange(size + 1)
    n, v = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(volume)))
    half = size // 2
    large = n[size + 1] - n[half + 1]
    best = -(-int(v[size + 1]) // size)
    for limit in range(1, half + 1):
        beside = n[size - limit + 1] - n[half + 1]
        room = beside * size - (v[size - limit + 1] - v[half + 1])
        rest = v[half + 1] - v[limit]
        best = max(best, int(large + max(0, -(-(rest - room) // size))))
    return best


def local_search(bins: list[list[int]], lengths: np.ndarray, size: int, block: int = 256) -> list[list[int]]:
    """Empty bins by exchanges, in blocks of `block` underfull bins of all fills, so that the work grows with the bins."""
    if len(bins) <= fewest(lengths, size):
        return bins
    fill = np.asarray([lengths[b].sum() for b in bins])
    under = [k for k in np.argsort(fill, kind="stable").tolist() if fill[k] < size]
    n = max(1, -(-len(under) // block))
    out = [b for k, b in enumerate(bins) if fill[k] >= size]
    for i in range(n):
        out += _search([bins[k] for k in under[i::n]], lengths, size)
    return out


def _search(bins: list[list[int]], lengths: np.ndarray, size: int) -> list[list[int]]:
    """Exchange items until as few bins are left as there can be or no exchange raises the sum of squared fills.

    Only underfull bins take part. The emptiest is the donor; against all others at once it tries to move an item, to swap one
    for a shorter one, one for two that are shorter together, and two for one; the exchange that fills a bin furthest is
    made. Each makes the fuller of two bins fuller, so the sum of squares grows and the search ends.
    """
    spare = len(bins) - fewest(lengths[np.concatenate([np.asarray(b) for b in bins])], size) if bins else 0
    if spare <= 0:
        return bins
    bins = [list(b) for b in bins]
    width = max(map(len, bins)) + 2
    held = np.zeros((len(bins), width), np.int64)  # lengths in a bin, zeros behind them
    for k, b in enumerate(bins):
        held[k, : len(b)] = lengths[b]
    fill = held.sum(1)
    left, right = np.triu_indices(width, 1)
    waiting = [k for k in np.argsort(fill, kind="stable").tolist() if fill[k] < size]
    while spare and waiting:
        donor = waiting[0]
        under = np.flatnonzero((fill < size) & (fill > 0))
        under = under[under != donor]
        gap, there = (size - fill[under])[:, None], held[under]
        pairs = there[:, left] + there[:, right]
        pairs[(there[:, left] == 0) | (there[:, right] == 0)] = 0
        mine = [i for i in range(len(bins[donor]))]
        offers = [((i,), int(held[donor, i])) for i in mine] + [((i, j), int(held[donor, i] + held[donor, j])) for i in mine for j in mine if i < j]
        best = (0, 0, (), ())
        for give, total in offers:
            back = [(there, lambda c: (c,) if c >= 0 else ())]
            if len(give) == 1:
                back.append((pairs, lambda c: (int(left[c]), int(right[c]))))
            for values, items in back:
                gain = total - values
                gain[(gain <= 0) | (gain > gap)] = 0
                if len(give) == 1 and values is pairs:
                    gain[pairs == 0] = 0
                gain[fill[under][:, None] + gain <= fill[donor]] = 0  # the receiver must get fuller than the donor was
                if gain.size and gain.max() > best[0]:
                    r, c = np.unravel_index(int(gain.argmax()), gain.shape)
                    best = (int(gain[r, c]), int(under[r]), give, items(c) if values[r, c] else ())
        gain, k, give, take = best
        if not gain:
            waiting.pop(0)
            continue
        out, into = [bins[donor][i] for i in give], [bins[k][i] for i in take]
        bins[donor] = [x for i, x in enumerate(bins[donor]) if i not in give] + into
        bins[k] = [x for i, x in enumerate(bins[k]) if i not in take] + out
        need = max(len(bins[donor]), len(bins[k]))
        if need > width - 2:
            held = np.pad(held, ((0, 0), (0, 4)))
            width += 4
            left, right = np.triu_indices(width, 1)
        for x in (donor, k):
            held[x] = 0
            held[x, : len(bins[x])] = lengths[bins[x]]
            fill[x] = held[x].sum()
        if not bins[donor]:
            spare -= 1
        waiting = [x for x in np.argsort(fill, kind="stable").tolist() if 0 < fill[x] < size]
    return [b for b in bins if b]


def _pack_groups(frame: DataFrame, size: int, level: int) -> DataFrame:
    """Pack each group of (group, row, length): row, group, bin, offset, fill."""

    def pack(key, table):
        rows, lengths = table.column("row").to_numpy(), table.column("length").to_numpy()
        order = np.lexsort((rows, lengths))
        rows, lengths = rows[order], lengths[order]
        bins = local_search(best_fit(lengths, size), lengths, size)
        items = np.concatenate([np.asarray(b) for b in bins])
        held = np.asarray([len(b) for b in bins])
        fills = np.asarray([lengths[b].sum() for b in bins])
        offsets = np.concatenate([np.cumsum(lengths[b]) - lengths[b] for b in bins])
        return pa.table({
            "row": rows[items], "length": lengths[items], "bin": np.repeat(np.arange(len(bins)), held) + (int(key[0].as_py()) << 28),
            "offset": offsets, "fill": np.repeat(fills, held), "level": np.full(len(items), level, np.int32),
        })

    return frame.groupBy("grp").applyInArrow(pack, "row long, length long, bin long, offset long, fill long, level int")


#: More than there can be rounds: each hands on half of the sequences.
ROUNDS = 1 << 7


def pack(cut: DataFrame, size: int = SEQUENCE, group_rows: int = 40_000, full_at: float = 0.995) -> DataFrame:
    """Add sequence_id and offset to stored pieces.

    `cut` must be a stored frame with a number `row` of each row, which goes: every use of the frame is a read of its own,
    that may part the files in another way, so numbers made here would not be the same in all. `group_rows` bounds what one
    task packs. Of the sequences filled below `full_at` the worse half is opened again and dealt into new groups, until one group
    holds all that is left; what a round makes of them stays only if it is no more than there was.
    """
    whole = cut.where(F.col("length") >= size)
    rest = cut.where(F.col("length") < size).select("row", "length")
    done, level, held, opened = [], 0, None, None  # held: the rows opened last, as they were packed, in so many sequences
    n = rest.count()
    while n:
        groups = max(1, -(-n // group_rows))
        packed = stored(_pack_groups(rest.withColumn("grp", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups))), size, level), f"pack{level}")
        if held is not None and packed.agg(F.count_distinct("bin")).first()[0] > opened:
            packed = held
        if groups == 1:
            done.append(packed)
            break
        low = F.col("fill") < size * full_at
        middle = packed.where(low).groupBy("bin").agg(F.first("fill").alias("fill")).agg(F.percentile_approx("fill", 0.5)).first()[0]
        if middle is None:
            done.append(packed)
            break
        again = low & ((F.col("fill") < middle) | ((F.col("fill") == middle) & (F.pmod(F.xxhash64("bin"), F.lit(2)) == 0)))
        done.append(packed.where(~again))
        held, level = packed.where(again), level + 1
        rest = held.select("row", "length")
        n, opened = held.agg(F.count("*"), F.count_distinct("bin")).first()
    out = whole.select("row", (F.col("row") * ROUNDS + ROUNDS - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for df in done:
        out = out.unionByName(df.select("row", (F.col("bin") * ROUNDS + F.col("level")).alias("sequence_id"), "offset"))
    return cut.join(out, "row").drop("row")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset; one row per piece.

    Null texts are documents of one token. Equal or null doc_ids are separate documents. An empty table gives no rows.
    Columns other than doc_id and text are ignored.
    """
    return pack(stored(pieces(docs, tokenizer, size).withColumn("row", F.monotonically_increasing_id()), "pieces"), size)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
