"""Line deduplication by an exact set-similarity join."""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.ragged import HashMap64, hash_spans, mix64, owners, ranges, row_chunks, run_starts, utf8, word_spans
from ledgerloom.llm.sketch import key_filter, passes, summed_cells
from ledgerloom.llm.store import Written
from ledgerloom.llm.worker import giving_back

#: Cells of the table of token counts by which tokens are ordered; a fixed size, the order only steers the work.
CELLS = 1 << 19
#: Rows of one prefix token that one task compares; a token that may have more is dealt to several tasks.
HOT_ROWS = 8192
#: Earlier lines under one prefix token that a line is verified against at first, and by how much that number grows for
#: the lines that stay without a match.
TRIED, GROWTH = 8, 16
#: Places that a task remembers while it reads texts, and rows that are compared at once.
SEEN, TOGETHER = 1 << 18, 1 << 19
_HASH_BITS = 44
#: Bits of the table of documents that Spark tests before texts are handed to Python.
DOC_BITS = 1 << 20
#: The place of a line: id and hash of the text of its document, and its number; and as one number, for the filter.
_PLACE = ("doc", "sub", "line")
_PLACES = "doc long, sub long, line int"
_SPOT = "doc ^ sub ^ shiftleft(cast(line as bigint), 40)"
_NO_ID = (1 << 63) - 1
#: What a text or line with a word holds.
_WORD = r"[^\x20\x09-\x0D]"
#: Sets of more tokens than this are compared by wider parities than 64 bits; those that may meet such
#: sets have one of 256 bits, those of more than _WIDEST tokens one of 2048.
_NARROW, _WIDEST = 64, 512
#: Marks of a row: not all rows of its token are in its task; it seeks no earlier line; no line may find it.
_DEALT, _SILENT, _HIDDEN = 1 << 30, 1 << 29, 1 << 28
_POS = (1 << 28) - 1


def _line_spans(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, number in its row, start, end) of every line; an empty row is one empty line."""
    breaks = np.flatnonzero(flat == 10)
    count = 1 + np.bincount(np.searchsorted(offsets, breaks, side="right") - 1, minlength=len(offsets) - 1)
    rows = np.repeat(np.arange(len(offsets) - 1), count)
    starts = np.sort(np.r_[offsets[:-1], breaks + 1])
    ends = np.sort(np.r_[offsets[1:], breaks])
    return rows, np.arange(len(rows)) - (np.cumsum(count) - count)[rows], starts, ends


def _lines(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """By chunk of rows: (text bytes, row bounds, doc, hash of its text, line number, start, end) of the lines."""
    flat, offsets = utf8(batch.column(1))
    ids, subs = batch.column(0).to_numpy(), batch.column(2).to_numpy()
    for a, b in row_chunks(offsets):
        part, bounds = flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        rows, numbers, starts, ends = _line_spans(part, bounds)
        yield part, bounds, ids[a:b][rows], subs[a:b][rows], numbers, starts, ends


def _ordered_sets(words: np.ndarray, line: np.ndarray, lines: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, line of each): the distinct tokens of every line, rarest first.

    A token is the rank of its count cell above 44 bits of its hash, so that its number is its place in the order.
    """
    token = (ranks[(words & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(_HASH_BITS)) | (words >> np.uint64(64 - _HASH_BITS))
    tokens, owners = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    step = 1 << 11  # lines in one sort, so that line and token fit into 64 bits
    bounds = np.searchsorted(line, np.arange(0, lines + step, step))
    for k in range(len(bounds) - 1):
        a, b = bounds[k], bounds[k + 1]
        key = np.sort(((line[a:b] - k * step).astype(np.uint64) << np.uint64(53)) | token[a:b])
        key = key[run_starts(key)]
        tokens.append((key & np.uint64((1 << 53) - 1)).astype(np.int64))
        owners.append((key >> np.uint64(53)).astype(np.int64) + k * step)
    return np.concatenate(tokens), np.concatenate(owners)


def _prefix_sizes(n: np.ndarray, threshold: float) -> np.ndarray:
    """Tokens of a set of n that must hold one of any partner's first tokens."""
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def _binary(values: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary array of the given 64-bit runs."""
    total = np.r_[0, np.cumsum(sizes)] * 8
    data = values[ranges(heads, sizes)].astype("<i8").tobytes()
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(total.astype(np.int64).tobytes()), pa.py_buffer(data)]).cast(pa.binary())


def _flat64(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, bounds) of a binary column of 64-bit numbers; null counts as none."""
    column = column.fill_null(b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[0] == offsets[-1]:
        return np.zeros(0, dtype=np.int64), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), dtype="<i8"), (offsets - offsets[0]) // 8


def _before(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether places a stand before places b."""
    return (a[0] < b[0]) | ((a[0] == b[0]) & ((a[1] < b[1]) | ((a[1] == b[1]) & (a[2] < b[2]))))


def _rarity(rows: DataFrame, seed: int) -> np.ndarray:
    """The place in the order of rarity of each cell of word hashes, from counts over all texts."""

    def count(batch: pa.RecordBatch, table: np.ndarray) -> None:
        flat, offsets = utf8(batch.column(0))
        for a, b in row_chunks(offsets):
            part = flat[offsets[a] : offsets[b]]
            starts, ends, _ = word_spans(part, offsets[a : b + 1] - offsets[a])
            table += np.bincount((hash_spans(part, starts, ends, seed) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)

    return np.minimum(np.floor(8 * np.log2(summed_cells(rows.select("text"), CELLS, count) + 1)), 511).astype(np.uint16)


_SET = ("n", "parity", "wide", "prefix")
_SETS = _PLACES + ", n int, parity long, wide binary, prefix binary"


def _wide_parities(tokens: np.ndarray, heads: np.ndarray, sizes: np.ndarray, least: int) -> pa.Array:
    """For each set of more than ``least`` tokens: the parity of the number of its tokens in each of 256 or 2048 cells."""
    out = [None] * len(sizes)
    for k in np.flatnonzero(sizes > least).tolist():
        bits = 2048 if sizes[k] > _WIDEST else 256
        own = tokens[heads[k] : heads[k] + sizes[k]] & (bits - 1)
        out[k] = np.packbits((np.bincount(own, minlength=bits) & 1).astype(np.uint8)).tobytes()
    return pa.array(out, pa.binary())


def _first_places(rows: DataFrame, ranks: np.ndarray, threshold: float, seed: int) -> DataFrame:
    """One row per line with words: of lines of the same words, the first one with its number of tokens, their parities
    and its prefix; the others with a null prefix. Lines are told apart by 128 bits over their words.

    A task remembers which lines it has read, so that few rows of a frequent one are dealt out.
    """
    names = ["k1", "k2", *_PLACE, *_SET]
    least = min(_NARROW - 1, int(threshold * _NARROW))  # a partner of a set of over _NARROW tokens has a wide parity too

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, stored = HashMap64(1 << 12), [np.zeros(0, dtype=np.int64)] * 4  # k2 and place of the lines in it
        for batch in batches:
            for part, bounds, doc, sub, number, starts, ends in _lines(batch):
                begin, stop, _ = word_spans(part, bounds)
                line = owners(begin, np.r_[starts, len(part) + 1])
                words = hash_spans(part, begin, stop, seed)
                if not len(words):
                    continue
                heads = run_starts(line)
                which = line[heads]
                k1 = np.add.reduceat(mix64(words + np.uint64(seed)), heads).view(np.int64)
                k2 = np.add.reduceat(mix64(words ^ np.uint64(seed)), heads).view(np.int64)
                place = [doc[which], sub[which], number[which].astype(np.int64)]
                order = np.lexsort((*place[::-1], k2, k1))
                run = np.flatnonzero(np.r_[True, (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])])
                first = order[np.repeat(run, np.diff(np.r_[run, len(order)]))]
                gone = np.zeros(len(which), dtype=bool)
                gone[order] = _before([p[first] for p in place], [p[order] for p in place])
                lead = order[run]
                at = seen.get(k1[lead].view(np.uint64))
                known = (at >= 0) & (stored[0][at] == k2[lead]) if len(stored[0]) else np.zeros(len(lead), dtype=bool)
                old, mine = [p[at[known]] for p in stored[1:]], [p[lead[known]] for p in place]
                later = ~_before(mine, old)
                gone[lead[known][later]] = _before(old, mine)[later]
                emit = np.ones(len(lead), dtype=bool)
                emit[np.flatnonzero(known)[later]] = False
                for p, now in zip(stored[1:], mine, strict=True):
                    p[at[known][~later]] = now[~later]
                fresh = lead[(at < 0)]
                fresh = fresh[run_starts(k1[fresh])]
                if seen.size + len(fresh) > SEEN:
                    seen, stored = HashMap64(1 << 12), [np.zeros(0, dtype=np.int64)] * 4
                if len(fresh) <= SEEN:
                    seen.put(k1[fresh].view(np.uint64), len(stored[0]) + np.arange(len(fresh)))
                    stored = [np.r_[p, now[fresh]] for p, now in zip(stored, (k2, *place), strict=True)]
                lead = lead[emit]
                tokens, owner = _ordered_sets(words, line, len(starts), ranks)
                t_heads = run_starts(owner)  # every line of ``which`` has a token
                sizes = np.diff(np.r_[t_heads, len(owner)])
                parity = np.bitwise_xor.reduceat(np.uint64(1) << (tokens.view(np.uint64) & np.uint64(63)), t_heads).view(np.int64)
                parity[sizes > _NARROW] = 0  # the wide one stands for it
                lead.sort()
                out = [k1, k2, *place[:2], place[2].astype(np.int32), sizes.astype(np.int32), parity]
                yield pa.RecordBatch.from_arrays([*[pa.array(c[lead]) for c in out], _wide_parities(tokens, t_heads[lead], sizes[lead], least), _binary(tokens, t_heads[lead], _prefix_sizes(sizes[lead], threshold))], names=names)
                rest = np.flatnonzero(gone)
                anywhere = mix64((place[0] ^ place[1] ^ (place[2] << 40))[rest].view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(anywhere), *[pa.array(c[rest]) for c in out[1:]], *[pa.nulls(len(rest), pa.binary())] * 2], names=names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over rows sorted by k1: of each line its first place, the others without a prefix."""
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            now = {c: table.column(c).to_numpy() for c in ("k1", "k2", *_PLACE)}
            open_ = table.column("prefix").is_valid().to_numpy()
            order = np.lexsort((now["line"], now["sub"], now["doc"], now["k2"], ~open_, now["k1"]))
            same = (now["k1"][order][1:] == now["k1"][order][:-1]) & (now["k2"][order][1:] == now["k2"][order][:-1]) & open_[order][1:]
            lead = np.r_[True, ~same]
            run = np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))
            before = _before([now[c][order[run]] for c in _PLACE], [now[c][order] for c in _PLACE])
            last = now["k1"][order] == now["k1"][order[-1]]  # of the last k1 more rows may come
            first = open_[order] & lead
            held = table.take(pa.array(order[first & last]))
            yield from table.take(pa.array(order[first & ~last])).select([*_PLACE, *_SET]).to_batches()
            others = table.take(pa.array(order[~first & (before | ~open_[order])])).select([*_PLACE, "n", "parity"])
            none = pa.nulls(others.num_rows, pa.binary())
            yield from others.append_column("wide", none).append_column("prefix", none).to_batches()
        if held is not None:
            yield from held.select([*_PLACE, *_SET]).to_batches()

    dealt = rows.mapInArrow(giving_back(read), "k1 long, k2 long, " + _SETS).repartition("k1").sortWithinPartitions("k1")
    return dealt.mapInArrow(giving_back(merge), _SETS)


def _prefix_cells(sets: DataFrame) -> np.ndarray:
    """Number of prefix tokens in each cell of their hash, over all rows of ``sets``."""

    def count(batch: pa.RecordBatch, table: np.ndarray) -> None:
        table += np.bincount(_flat64(batch.column(0))[0] & (CELLS - 1), minlength=CELLS)

    return summed_cells(sets.select("prefix"), CELLS, count)


def _blocks(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells that hold more rows than one task compares, number of tasks for each)."""
    hot = np.flatnonzero(cells > HOT_ROWS)
    return hot, 1 + cells[hot] // HOT_ROWS


def _of_hot(tokens: np.ndarray, blocks: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Number of tasks of each token."""
    hot, number = blocks
    out = np.ones(len(tokens), dtype=np.int64)
    if len(hot):
        cell = tokens & (CELLS - 1)
        at = np.minimum(np.searchsorted(hot, cell), len(hot) - 1)
        found = hot[at] == cell
        out[found] = number[at[found]]
    return out


def _first_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Each line with the earliest ones that pass the filters under each token of its prefix (see ``_compared``). The
    lines of a hot token are dealt to several tasks, each of which tries its own."""
    blocks = _blocks(_prefix_cells(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, row, pos = _entries(batch)
            number = _of_hot(tokens, blocks)
            part = _part(batch, row) % number.astype(np.uint64)
            yield _dealt(batch, np.where(number > 1, _mixed(tokens, part), tokens), row, np.where(number > 1, pos | _DEALT, pos))

    return _compared(sets.select(*_PLACE, *_SET).mapInArrow(giving_back(run), _GROUPED), threshold, TRIED)


def _rest_pairs(sets: DataFrame, open_lines: DataFrame, threshold: float, tried: int) -> DataFrame:
    """As ``_first_pairs`` for ``open_lines`` alone, against all earlier lines: the rows of a hot token are dealt to a grid
    of tasks, so that each open line meets each other line in one of them."""
    own = Written(sets.join(open_lines.select(*_PLACE), [*_PLACE], "left_semi"), "line-open")
    tokens = own.df.select("prefix").mapInArrow(giving_back(_each_token), "token long").distinct()
    bits = key_filter(tokens, "token", tokens.count())
    theirs, mine = _blocks(_prefix_cells(sets)), _blocks(_prefix_cells(own.df))

    def run(seeks: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tokens, row, pos = _entries(batch)
                keep = passes(bits, tokens)
                tokens, row, pos = tokens[keep], row[keep], pos[keep]
                number, other = _of_hot(tokens, mine if seeks else theirs), _of_hot(tokens, theirs if seeks else mine)
                part = (_part(batch, row) % number.astype(np.uint64)).astype(np.int64)
                copy = np.repeat(np.arange(len(tokens)), other)
                across = np.arange(len(copy)) - np.repeat(np.cumsum(other) - other, other)
                a, b = (part[copy], across) if seeks else (across, part[copy])
                width = _of_hot(tokens, theirs)[copy]
                whole = (number * other)[copy] == 1
                group = np.where(whole, tokens[copy], _mixed(tokens[copy], (a * width + b).astype(np.uint64)))
                yield _dealt(batch, group, row[copy], pos[copy] | (_HIDDEN if seeks else _SILENT))

        return deal

    columns = [*_PLACE, *_SET]
    every = sets.select(*columns).mapInArrow(giving_back(run(False)), _GROUPED).unionByName(own.df.select(*columns).mapInArrow(giving_back(run(True)), _GROUPED))
    return _compared(every, threshold, tried)


#: A row of a token: document, hash, line, parity, size and marks, and the wide parity, as 64-bit numbers.
_GROUPED, _FIXED = "token long, row binary", 5


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, row, place in the prefix) of all prefix tokens of a batch of sets."""
    tokens, offsets = _flat64(batch.column(6))
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return tokens, row, np.arange(len(row)) - offsets[:-1][row]


def _each_token(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_flat64(batch.column(0))[0]))], names=["token"])


def _part(batch: pa.RecordBatch, row: np.ndarray) -> np.ndarray:
    return mix64((batch.column(0).to_numpy() ^ batch.column(1).to_numpy() ^ batch.column(2).to_numpy().astype(np.int64)).view(np.uint64))[row]


def _mixed(tokens: np.ndarray, part: np.ndarray) -> np.ndarray:
    """A key for a part of a token's rows; where it falls on another key, rows are compared in vain, never missed."""
    return mix64(tokens.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + part).view(np.int64)


def _dealt(batch: pa.RecordBatch, tokens: np.ndarray, row: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    values, bounds = _flat64(batch.column(5))
    wide = np.diff(bounds)[row]
    total = np.r_[0, np.cumsum(wide + _FIXED)]
    out = np.zeros(total[-1], dtype=np.int64)
    for k, c in enumerate((0, 1, 2, 4)):
        out[total[:-1] + k] = batch.column(c).to_numpy()[row]
    out[total[:-1] + 4] = (batch.column(3).to_numpy().astype(np.int64)[row] << 32) | pos
    out[ranges(total[:-1] + _FIXED, wide)] = values[ranges(bounds[:-1][row], wide)]
    return pa.RecordBatch.from_arrays([pa.array(tokens), _binary(out, total[:-1], wide + _FIXED)], names=["token", "row"])


_PAIRS = _PLACES + ", o_doc long, o_sub long, o_line int, more boolean"


def _compared(grouped: DataFrame, threshold: float, tried: int) -> DataFrame:
    """(place, o_ place, more): of the rows of one token, each line with up to ``tried`` of the earliest lines that pass
    the length, positional and bitmap filters. ``more`` says that others may follow; such a row may have no o_ place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.column("row").nbytes // 64
            if rows < TOGETHER:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            token = table.column("token").to_numpy()
            last = int(np.searchsorted(token, token[-1])) if token[0] != token[-1] else 0
            if last:
                yield from _pairs_of(token[:last], table.column("row").slice(0, last), threshold, tried)
            held = table.slice(last).to_batches()
            rows = sum(b.column("row").nbytes for b in held) // 64 if last else 0
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from _pairs_of(table.column("token").to_numpy(), table.column("row"), threshold, tried)

    return grouped.repartition("token").sortWithinPartitions("token").mapInArrow(giving_back(run), _PAIRS).distinct()


class _Wide:
    """The wide parities of some rows: 256 bits of each that has any, 2048 of the widest."""

    def __init__(self, values: np.ndarray, start: np.ndarray, size: np.ndarray):
        values = values.view(np.uint64)
        rows = np.flatnonzero(size > 0)
        full = size[rows] == 32
        self.at = [np.full(len(size), -1, dtype=np.int64) for _ in range(2)]
        self.at[0][rows[full]] = np.arange(full.sum())
        self.at[1][rows] = np.arange(len(rows))
        top = values[ranges(start[rows[full]], size[rows[full]])].reshape(-1, 32)
        low = np.zeros((len(rows), 4), dtype=np.uint64)
        low[~full] = values[ranges(start[rows[~full]], size[rows[~full]])].reshape(-1, 4)
        low[full] = np.bitwise_xor.reduce(top.reshape(-1, 8, 4), axis=1)
        self.words = [top, low]

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which two rows differ for sure: 0 where one has no wide parity."""
        out = np.zeros(len(a), dtype=np.int64)
        for at, words in zip(self.at[::-1], self.words[::-1], strict=True):
            both = np.flatnonzero((at[a] >= 0) & (at[b] >= 0))
            out[both] = np.bitwise_count(words[at[a[both]]] ^ words[at[b[both]]]).sum(axis=1)
        return out


def _place_order(doc: np.ndarray, sub: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The rows ordered by place. Where id and line fit into one number and no id has two texts, that is sorted."""
    low = doc.min()
    if int(doc.max()) - int(low) < 1 << 40 and line.max() < 1 << 22:
        order = np.argsort(((doc - low) << 22) | line)
        one = doc[order]
        if not ((one[1:] == one[:-1]) & (sub[order][1:] != sub[order][:-1])).any():
            return order
    return np.lexsort((line, sub, doc))


def _pairs_of(token: np.ndarray, column: pa.ChunkedArray, threshold: float, tried: int) -> Iterator[pa.RecordBatch]:
    """The pairs of whole groups of rows, which are sorted by token."""
    column = column.combine_chunks()
    values, bounds = _flat64(pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column)
    start, size = bounds[:-1], np.diff(bounds) - _FIXED
    group = np.cumsum(np.r_[True, token[1:] != token[:-1]]) - 1
    several = np.flatnonzero((np.bincount(group) > 1)[group] | ((values[start + 4] & _DEALT) > 0))
    group, start, size = group[several], start[several], size[several]
    if not len(group):
        return
    doc, sub, line = (values[start + k] for k in range(3))
    by_place = _place_order(doc, sub, line)
    n = values[start + 4] >> 32
    bucket = np.floor(np.log(n) / np.log(1 / threshold)).astype(np.int64) if threshold < 1 else n
    runs, dense = np.unique(group.astype(np.int64) * (1 << 40) + bucket + 1, return_inverse=True)  # rows of one token and size class
    width = len(group).bit_length()
    rank = np.empty(len(group), dtype=np.int64)
    rank[by_place] = np.arange(len(group))
    sorted_at = np.sort((dense.astype(np.int64) << width) | rank)
    place = sorted_at & ((1 << width) - 1)
    order = by_place[place]
    start, size = start[order], size[order]
    rows = {c: v[order] for c, v in zip(_PLACE, (doc, sub, line), strict=True)}
    rows |= {"parity": values[start + 3], "at": values[start + 4]}
    wide = _Wide(values, start + _FIXED, size)
    n, mark, dense = n[order], rows["at"] & 0xFFFFFFFF, sorted_at >> width
    pos, parity = mark & _POS, rows["parity"].view(np.uint64)
    heads = run_starts(dense)
    ends = np.r_[heads[1:], len(dense)]
    count = np.zeros(len(dense), dtype=np.int64)
    more = (mark & _DEALT) > 0
    seeks = (mark & _SILENT) == 0
    hidden = (mark & _HIDDEN) > 0
    some_hidden = hidden.any()
    share = threshold / (1 + threshold)
    found: list[np.ndarray] = []
    for step in (-1, 0, 1):  # lines of the sizes that a partner may have
        to = np.clip(dense + step, 0, len(runs) - 1)
        own = np.flatnonzero(seeks & (runs[to] == runs[dense] + step))
        until = np.searchsorted(sorted_at, (to[own] << width) | place[own]) if step else own
        at, until = heads[to[own]], np.minimum(until, ends[to[own]])
        on = at < until
        own, at, until = own[on], at[on], until[on]
        while len(own):
            n1, n2 = n[own], n[at]
            need = np.ceil(share * (n1 + n2) - 1e-9)
            good = np.flatnonzero(np.minimum(n1 - pos[own], n2 - pos[at]) >= need)
            if len(good):
                if some_hidden:
                    good = good[~hidden[at[good]]]
                hit, to_ = own[good], at[good]
                n1, n2 = n1[good], n2[good]
                slack = n1 + n2 - 2 * need[good]
                keep = (np.bitwise_count(parity[hit] ^ parity[to_]) <= slack) | (np.maximum(n1, n2) > _NARROW)
                keep &= (rows["doc"][hit] != rows["doc"][to_]) | (rows["sub"][hit] != rows["sub"][to_]) | (rows["line"][hit] != rows["line"][to_])
                hit, to_, slack = hit[keep], to_[keep], slack[keep]
                if len(hit):
                    keep = wide.differ(hit, to_) <= slack
                    hit, to_ = hit[keep], to_[keep]
                    found.append(np.stack([hit, to_]))
                    count[hit] += 1
            at = at + 1
            rest = at < until
            on = rest & (count[own] < tried)
            more[own[rest & ~on]] = True
            own, at, until = own[on], at[on], until[on]
    own, at = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
    alone = np.flatnonzero(more & seeks & (count == 0))
    left, right = np.r_[own, alone], pa.array(np.r_[at, np.zeros(len(alone), dtype=np.int64)], mask=np.arange(len(own) + len(alone)) >= len(own))
    columns = [pa.array(rows[c] if c != "line" else rows[c].astype(np.int32)) for c in _PLACE]
    yield pa.RecordBatch.from_arrays([*[c.take(pa.array(left)) for c in columns], *[c.take(right) for c in columns], pa.array(more[left])], names=[*_PLACE, *[f"o_{c}" for c in _PLACE], "more"])


def _similar(pairs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """The places of the lines of ``pairs`` that are similar to their partner.

    The lines in pairs are read from the texts again: a filter of bounded size lets few others pass.
    """
    theirs = pairs.select(*[F.col(f"o_{c}").alias(c) for c in _PLACE])
    wanted = Written(pairs.select(*_PLACE).unionByName(theirs).distinct().withColumn("spot", F.expr(_SPOT)), "line-wanted")
    bits = key_filter(wanted.df, "spot", wanted.df.count())
    rows = rows.where(_in_documents(wanted.df))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, doc, sub, number, starts, ends in _lines(batch):
                hit = np.flatnonzero(passes(bits, doc ^ sub ^ (number.astype(np.int64) << 40)))
                size = (ends - starts)[hit]
                total = np.r_[0, np.cumsum(size)].astype(np.int64)
                text = pa.Array.from_buffers(pa.large_binary(), len(hit), [None, pa.py_buffer(total.tobytes()), pa.py_buffer(part[ranges(starts[hit], size)].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(sub[hit]), pa.array(number[hit].astype(np.int32)), text.cast(pa.binary())], names=[*_PLACE, "text"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array([_reached(set(x.split()), set(y.split()), threshold) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(good) for k in range(3)], names=list(_PLACE))

    found = rows.mapInArrow(giving_back(read), _PLACES + ", text binary").join(wanted.df.select(*_PLACE), [*_PLACE], "left_semi")
    found = Written(found.dropDuplicates([*_PLACE]), "line-found")  # rows equal in id and text: one of them
    other = found.df.select(*[F.col(c).alias(f"o_{c}") for c in _PLACE], F.col("text").alias("theirs"))
    joined = pairs.join(found.df, [*_PLACE]).join(other, [f"o_{c}" for c in _PLACE]).select(*_PLACE, "text", "theirs")
    out = Written(joined.mapInArrow(giving_back(verify), _PLACES).distinct(), "line-matches")
    wanted.drop()
    found.drop()
    return out.df


def _in_documents(wanted: DataFrame) -> Column:
    """Whether a row (id, sub) may be one of the documents (doc, sub) in ``wanted``: a table of a fixed number of bits, as
    one binary literal. Where very many documents are wanted, more of the others pass; none is lost."""

    def mark(batch: pa.RecordBatch, table: np.ndarray) -> None:
        at = batch.column(0).to_numpy()
        np.bitwise_or.at(table.view(np.uint8), at >> 3, (1 << (at & 7)).astype(np.uint8))

    place = lambda doc: F.xxhash64(doc, "sub").bitwiseAND(F.lit(DOC_BITS - 1))
    table = summed_cells(wanted.select(place("doc").alias("at")), DOC_BITS // 64, mark, either=True).view(np.uint8).tobytes()
    at = place("id")
    byte = F.conv(F.hex(F.substring(F.lit(table), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1


def _reached(one: set[bytes], two: set[bytes], threshold: float) -> bool:
    shared = len(one & two)
    return shared >= threshold * (len(one) + len(two) - shared) - 1e-9


def later_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc, sub, lines): for each document that has them, the numbers (from 0) of the lines that an earlier line matches.

    A document is known by its id (doc; a null id counts as the largest one) and the hash of its whole text (sub, see
    ``_keyed``): of rows that share an id or have none, each text is a document of its own. Rows equal in both are one.
    A line is the set of its words (split at ASCII white space). Lines are ordered by (id, hash, line number); a
    line is removed if the Jaccard similarity with any earlier line, removed or not, is at least ``threshold``. Lines
    without words are never removed and match nothing.

    The join: lines of the same words are merged first; they stand where the first one does. Words are ordered by rarity
    (a count table of fixed size over all rows); sets that are similar share one of their first n - ceil(threshold n) + 1
    words. Among the rows of such a word each line seeks earlier ones of a size that may match, the earliest first, and
    goes on past those that fail the positional or bitmap filter; the first few that pass are verified on the texts.
    So a large group of similar lines costs a few comparisons a line. Lines without a match that have more to try go
    on with ever more of the others until none has. Rows of a word that has very many are dealt to several tasks.
    Ids must be whole numbers. Words are compared byte by byte in the end; up to there by 53-bit numbers, which
    make two words of a line one with a chance of 2^-44.
    """
    seed = secrets.randbits(63)
    doc, sub = _keyed(id_col, text_col)
    rows = docs.select(doc.alias("id"), F.col(text_col).alias("text"), sub.alias("sub"))
    places = Written(_first_places(rows, _rarity(rows, seed), threshold, seed), "line-sets")
    sets = places.df.where("prefix is not null")
    pairs, tried = Written(_first_pairs(sets, threshold), "line-pairs"), TRIED
    removed = _similar(pairs.df.where("o_doc is not null"), rows, threshold)
    while True:
        open_lines = Written(pairs.df.where("more").select(*_PLACE).distinct().join(removed, [*_PLACE], "left_anti"), "line-open")
        pairs.drop()
        if not open_lines.df.take(1):
            break
        tried *= GROWTH
        pairs = Written(_rest_pairs(sets, open_lines.df, threshold, tried), "line-pairs")
        more = _similar(pairs.df.where("o_doc is not null"), rows, threshold)
        removed = Written(removed.unionByName(more).distinct(), "line-matches").df
        open_lines.drop()
    gone = Written(places.df.where("prefix is null").select(*_PLACE).unionByName(removed), "line-gone").df
    places.drop()
    return gone.groupBy("doc", "sub").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def _keyed(id_col: str, text_col: str) -> tuple[Column, Column]:
    """The key of a document: its id, a null one as the largest number, and the hash of its text."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), F.xxhash64(F.col(text_col))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """Documents without the lines that an earlier line matches (see ``later_matches``).

    Returns id_col, text (the kept lines joined by line breaks), n_lines int (before), n_removed int, removed
    array<int> (line numbers from 0). A null text stays null and counts 0 lines; an empty text is one line without
    words. Of rows with one id and different texts, or with none, each is judged by its own text; of equal rows without
    an id, all but one lose every line that has words. Rows equal in id and text get the same decision. Other columns
    of ``docs`` are not read; an empty table gives an empty result.
    """
    gone = later_matches(docs, id_col, text_col, threshold)
    doc, sub = _keyed(id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), doc.alias("doc"), sub.alias("sub"))
    # rows without an id: equal ones are numbered, by their count alone as they are the same
    alike = rows.where("id is null").groupBy("doc", "sub").agg(F.first("id").alias("id"), F.first("text").alias("text"), F.count("*").alias("n"))
    alike = alike.withColumn("number", F.explode(F.sequence(F.lit(1), F.col("n")))).select("id", "text", "doc", "sub", "number")
    rows = rows.where("id is not null").withColumn("number", F.lit(1).cast("long")).unionByName(alike)
    joined = rows.join(gone, ["doc", "sub"], "left")
    every = F.filter(F.transform(F.split("text", "\n", -1), lambda x, k: F.when(x.rlike(_WORD), k)), lambda k: k.isNotNull())
    numbers = F.coalesce(F.when(F.col("number") > 1, every).otherwise(F.col("lines")), F.array().cast("array<int>"))
    split = F.split("text", "\n", -1)
    left = F.filter(split, lambda _, k: ~F.array_contains(numbers, k))
    text = F.when(F.size(numbers) == 0, F.col("text")).otherwise(F.array_join(left, "\n"))
    out = joined.select("id", "text", "lines", numbers.alias("removed"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n_lines"), text.alias("kept"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines"))
    return out.select(F.col("id").alias(id_col), F.col("kept").alias(text_col), n.cast("int").alias("n_lines"), F.size("removed").alias("n_removed"), "removed")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """``docs`` (all columns, in order) without the lines that an earlier line matches.

    Documents that lose lines and have no word left are dropped, so that of equal rows without an id one is left;
    documents without words before stay. Where there is a
    column ``n_chars`` it gets the new number of characters.
    """
    free = "gone"
    while any(c.lower().startswith(free) for c in docs.columns):
        free = "_" + free
    g_doc, g_sub, g_lines, kept = (f"{free}_{c}" for c in ("doc", "sub", "lines", "kept"))
    gone = later_matches(docs.select(id_col, text_col), id_col, text_col, threshold).select(F.col("doc").alias(g_doc), F.col("sub").alias(g_sub), F.col("lines").alias(g_lines))
    alike = F.col(id_col).isNull() & F.coalesce(F.col(text_col).rlike(_WORD), F.lit(False))
    docs = docs.where(~alike).unionByName(docs.where(alike).dropDuplicates([text_col]))
    doc, sub = _keyed(id_col, text_col)
    joined = docs.join(gone, (doc == F.col(g_doc)) & (sub == F.col(g_sub)), "left")
    left = F.filter(F.split(F.col(text_col), "\n", -1), lambda _, k: ~F.array_contains(g_lines, k))
    text = F.when(F.col(g_lines).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    named = joined.withColumn(kept, text).where(F.col(g_lines).isNull() | F.col(kept).rlike(_WORD))
    new = {text_col: F.col(kept)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col(g_lines).isNull(), F.col("n_chars")).otherwise(F.length(kept).cast(kind))
    return named.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
