"""SentencePiece encoding and decoding: N-best segmentations of the piece lattice.

The lattice of a text falls apart wherever no piece spans two neighbouring characters,
above all before white space. So the scores of all distinct segments of a batch come
from one vectorised forward Viterbi pass, and with a backward pass the loss of the
second-best path of each. The N best segmentations of a text can differ from the best
one only in the N - 1 segments that lose least; these get their own N best by backward
A* search, in which the forward scores are exact heuristics."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.textcols import BASE, mix64

SPACE = 0x2581  # the mark that stands for a space in pieces
#: A character that no piece has costs so much more than the worst ordinary piece, and becomes its UTF-8 bytes.
UNKNOWN_PENALTY = 10.0
#: Scores below this mark pieces that are only chosen where nothing else fits.
_RESERVED = -1e8
SLICE_CHARS = 4 << 20
_LONG = 64


def _range_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ranges of an array of code points."""
    up = np.full(len(codes) + 1, BASE, np.uint64)
    down = np.full(len(codes) + 1, np.uint64(pow(int(BASE), -1, 1 << 64)), np.uint64)
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix64(codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


class Lookup:
    """A hash table from distinct 64-bit keys to their numbers, probed for whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys, self._tables, left = keys, [], np.arange(len(keys))
        for shift in (42, 20, 0):
            table = np.zeros(1 << 22, np.int32)
            slot = (keys[left] >> np.uint64(shift) & np.uint64((1 << 22) - 1)).astype(np.int64)
            table[slot] = left
            self._tables.append((np.uint64(shift), table))
            left = left[table[slot] != left]
            if not len(left):
                return
        raise ValueError("hashes of pieces collide")

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Numbers of keys, -1 for what isn't one."""
        out = np.full(len(wanted), -1, np.int32)
        todo: np.ndarray | slice = slice(None)
        for shift, table in self._tables:
            some = wanted[todo]
            at = table[(some >> shift & np.uint64((1 << 22) - 1)).astype(np.int64)]
            hit = self.keys[at] == some
            if isinstance(todo, slice):
                out[hit] = at[hit]
                todo = np.flatnonzero(~hit)
            else:
                out[todo[hit]] = at[hit]
                todo = todo[~hit]
        return out


class PieceModel:
    """Pieces and scores of a SentencePiece model file with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        self.names = [m.id_to_piece(i) for i in range(size)]
        special = np.array([m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i) for i in range(size)])
        self.byte_ids = np.full(256, m.unk_id(), np.uint32)
        raw = []
        for i, name in enumerate(self.names):
            if m.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                raw.append(bytes([int(name[3:5], 16)]))
            else:
                raw.append(b"" if special[i] else name.replace(chr(SPACE), " ").encode())
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        own = np.flatnonzero(~special)
        scores = np.array([m.get_score(i) for i in range(size)])
        self.unknown = float(scores[own][scores[own] > _RESERVED].min()) - UNKNOWN_PENALTY
        names = [self.names[i] for i in own]
        # every prefix of a piece, and which of them are pieces
        prefixes: dict[int, int] = {}
        for i, name in zip(own.tolist(), names, strict=True):
            key = 0
            for k, c in enumerate(name, 1):
                key = (key * int(BASE) + ord(c) + 1) & ((1 << 64) - 1)
                if k == len(name):
                    prefixes[key] = i
                else:
                    prefixes.setdefault(key, -1)
        keys = np.fromiter(prefixes, np.uint64, len(prefixes))
        self.lookup = Lookup(mix64(keys))
        self.prefix_ids = np.fromiter(prefixes.values(), np.int32, len(prefixes))
        self.scores, self.own = scores, own
        self.longest = max(len(x) for x in names)
        pairs = {(ord(a), ord(b)) for x in names for a, b in zip(x, x[1:])}
        self.pairs = np.array(sorted(a << 21 | b for a, b in pairs), np.int64)
        self.splits_at_space = not any(b == SPACE and a != SPACE for a, b in pairs)

    def decode(self, ids: np.ndarray) -> bytes:
        """Text of pieces, without the space that encoding puts first."""
        start, size = self.raw_at[ids], self.raw_at[ids + 1] - self.raw_at[ids]
        at = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
        return self.raw[at].tobytes()[1:]


@lru_cache(maxsize=2)
def load_model(path: str) -> PieceModel:
    return PieceModel(path)


class Lattice:
    """The lattices of ``codes`` (length, segments): many segments of one length, one in each column."""

    def __init__(self, model: PieceModel, codes: np.ndarray):
        self.model, self.codes = model, codes
        length, n = codes.shape
        flat = codes.reshape(-1).astype(np.uint64) + np.uint64(1)
        self.piece: list[np.ndarray] = []  # by length - 1: id of the piece that starts at (place, segment), or -1
        at, key = np.arange(length * n), np.zeros(length * n, np.uint64)
        for k in range(min(model.longest, length)):
            inside = at < (length - k) * n
            at, key = at[inside], key[inside] * BASE + flat[at[inside] + k * n]
            found = model.lookup.find(mix64(key))
            begins = found >= 0
            at, key, ids = at[begins], key[begins], model.prefix_ids[found[begins]]
            piece = np.full((length - k) * n, -1, np.int32)
            piece[at] = ids
            self.piece.append(piece.reshape(length - k, n))
            if not len(at):
                break
        self.score = [np.where(p >= 0, model.scores[p], -np.inf if k else model.unknown) for k, p in enumerate(self.piece)]
        self.forward = np.full((length + 1, n), -np.inf)
        self.backward = np.full((length + 1, n), -np.inf)
        self.step = np.zeros((length + 1, n), np.int16)
        self.forward[0] = self.backward[length] = 0
        for i in range(1, length + 1):
            best, step, rear = self.forward[i], self.step[i], self.backward[length - i]
            for k in range(1, min(i, len(self.score)) + 1):
                value = self.forward[i - k] + self.score[k - 1][i - k]
                np.copyto(step, k, where=value > best)
                np.maximum(best, value, out=best)
                np.maximum(rear, self.score[k - 1][length - i] + self.backward[length - i + k], out=rear)
        self.best = self.forward[length]
        # used: length of the best path's piece that starts at (place, segment), or 0
        self.used = np.zeros((length, n), np.int16)
        place, alive = np.full(n, length), np.arange(n)
        while len(alive):
            k = self.step[place[alive], alive]
            place[alive] -= k
            self.used[place[alive], alive] = k
            alive = alive[place[alive] > 0]

    def losses(self) -> np.ndarray:
        """What the second-best path of each segment scores less than the best; infinite if there's one path."""
        second = np.full(len(self.best), -np.inf)
        for k, score in enumerate(self.score, 1):
            value = self.forward[: len(score)] + score + self.backward[k:]
            value[self.used[: len(score)] == k] = -np.inf
            np.maximum(second, value.max(axis=0), out=second)
        return self.best - second

    def best_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all best paths, one segment after the other, and their number by segment."""
        segment, start = np.nonzero(self.used.T)
        ids, count = self.ids(start, segment, self.used[start, segment])
        return ids, np.bincount(segment, weights=count, minlength=len(self.best)).astype(np.int64)

    def ids(self, start: np.ndarray, segment: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of edges, and how many each has: one, or the bytes of a character without a piece."""
        piece = np.full(len(start), -1, np.int64)
        for k in np.unique(length).tolist():
            some = length == k
            piece[some] = self.piece[k - 1][start[some], segment[some]]
        code = self.codes[start, segment]
        count = np.where(piece >= 0, 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)).astype(np.int64)
        out = np.repeat(np.maximum(piece, 0), count).astype(np.uint32)
        places = np.cumsum(count) - count
        for i in np.flatnonzero(piece < 0).tolist():
            raw = chr(code[i]).encode("utf-8", "surrogatepass")
            out[places[i] : places[i] + len(raw)] = self.model.byte_ids[list(raw)]
        return out, count

    def n_best(self, segment: int, n: int) -> list[tuple[float, np.ndarray]]:
        """The ``n`` best paths of one segment, (score, ids), by A* from its end: a partial path
        is taken in the order of its score plus the forward score of where it stands.

        Of equal ones the path that stands nearest to the start goes on, and no place is left
        more than ``n`` times, which is all that ``n`` paths need; so ties cost nothing."""
        forward = self.forward[:, segment].tolist()
        length = len(forward) - 1
        score, pieces = [s[:, segment].tolist() for s in self.score], [p[:, segment].tolist() for p in self.piece]
        # edges that end at each place, made when it is first reached
        edges: dict[int, list[tuple[int, int, float]]] = {}
        left = [0] * (length + 1)
        heap: list[tuple[float, int, int, float, tuple | None]] = [(-forward[-1], length, 0, 0.0, None)]
        out: list[tuple[float, np.ndarray]] = []
        pushed = 0
        while heap and len(out) < n:
            _, at, _, total, path = heapq.heappop(heap)
            if at == 0:
                steps: list[tuple[int, int]] = []
                while path:
                    begin, k, path = path
                    steps.append((begin, k))
                found = [pieces[k - 1][begin] for begin, k in steps]
                if min(found, default=0) >= 0:
                    out.append((total, np.array(found, np.uint32)))
                else:
                    begins, sizes = np.array(steps, np.int64).T
                    out.append((total, self.ids(begins, np.full(len(begins), segment), sizes)[0]))
                continue
            if left[at] == n:
                continue
            left[at] += 1
            if at not in edges:
                edges[at] = [(at - k, k, score[k - 1][at - k]) for k in range(1, min(at, len(score)) + 1) if score[k - 1][at - k] > -np.inf]
            for begin, k, value in edges[at]:
                if left[begin] < n:
                    pushed += 1
                    reached = total + value
                    heapq.heappush(heap, (-(reached + forward[begin]), begin, pushed, reached, (begin, k, path)))
        return out


def _segments(model: PieceModel, codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Starts of segments: of rows, before spaces, and in long stretches wherever no piece spans."""
    n = len(codes)
    cut = np.zeros(n + 1, bool)
    cut[rows] = True
    if model.splits_at_space:
        cut[1:n] |= (codes[1:] == SPACE) & (codes[:-1] != SPACE)
    starts = np.flatnonzero(cut[:n])
    for i in np.flatnonzero(np.diff(np.append(starts, n)) > _LONG).tolist():
        a, b = starts[i], starts[i + 1] if i + 1 < len(starts) else n
        pair = codes[a : b - 1].astype(np.int64) << 21 | codes[a + 1 : b]
        at = np.minimum(np.searchsorted(model.pairs, pair), len(model.pairs) - 1)
        cut[a + 1 : b] |= model.pairs[at] != pair
    return np.flatnonzero(cut[:n])


def segment_texts(model: PieceModel, texts: list[str], n: int) -> list[list[tuple[float, np.ndarray]]]:
    """For each text its up to ``n`` best segmentations, best first: (score, ids). An empty text has one, of no pieces."""
    full = [i for i, t in enumerate(texts) if t]
    marked = [chr(SPACE) + texts[i].replace(" ", chr(SPACE)) for i in full]
    out: list[list[tuple[float, np.ndarray]]] = [[(0.0, np.zeros(0, np.uint32))] for _ in texts]
    if not full:
        return out
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in marked])
    starts = _segments(model, codes, np.append(0, ends[:-1]))
    stops = np.append(starts[1:], len(codes))
    _, first, which = np.unique(_range_hashes(codes, starts, stops), return_index=True, return_inverse=True)
    size = (stops - starts)[first]
    order = np.argsort(size, kind="stable")  # distinct segments by length
    cuts = np.flatnonzero(np.append(True, np.diff(size[order]) > 0))
    groups = [Lattice(model, codes[starts[first[some]] + np.arange(size[some[0]])[:, None]]) for some in np.split(order, cuts[1:])]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    which = place[which]
    packed, counts = zip(*(g.best_ids() for g in groups), strict=True)
    ids, sizes = np.concatenate(packed), np.concatenate(counts)
    places = np.cumsum(sizes) - sizes
    scores = np.concatenate([g.best for g in groups])
    losses = np.concatenate([g.losses() for g in groups]) if n > 1 else np.full(len(size), np.inf)
    known: dict[int, list[tuple[float, np.ndarray]]] = {}

    def alternatives(segment: int) -> list[tuple[float, np.ndarray]]:
        if segment not in known:
            g = int(np.searchsorted(cuts, segment, "right")) - 1
            known[segment] = groups[g].n_best(segment - int(cuts[g]), n)
        return known[segment]

    bounds = np.searchsorted(starts, np.append(0, ends))
    for row, a, b in zip(full, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        mine = which[a:b]
        take = sizes[mine]
        at = np.cumsum(take) - take
        best = ids[np.arange(take.sum()) + np.repeat(places[mine] - at, take)]
        score = float(scores[mine].sum())
        found = [(score, best)]
        loss = losses[mine]
        if n > 1:
            near = np.argpartition(loss, n - 1)[:n] if len(loss) > n else np.arange(len(loss))
            limit = loss[near].max(initial=-np.inf)
            near = np.flatnonzero(loss <= limit) if np.isfinite(limit) else near[np.isfinite(loss[near])]
            near = near[np.argsort(loss[near], kind="stable")][: n - 1]
            near.sort()
            options = [alternatives(int(mine[k])) for k in near.tolist()]
            ranked: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
            for o in options:
                ranked = sorted(((change + x[0] - o[0][0], (*choice, c)) for change, choice in ranked for c, x in enumerate(o)), key=lambda x: (-x[0], x[1]))[:n]
            for change, choice in ranked[1:n]:
                parts, last = [], 0
                for k, c in zip(near.tolist(), choice, strict=True):
                    if c:
                        parts += [best[last : at[k]], known[int(mine[k])][c][1]]
                        last = at[k] + take[k]
                found.append((score + change, np.concatenate([*parts, best[last:]])))
        out[row] = found
    return out


def segment_nbest(df: DataFrame, model_path: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The ``n`` best segmentations of every whole text, by the sum of the pieces' scores.

    Returns ``id_col``, n_pieces (of the best), nbest (array of score, n_pieces and ids_crc32
    of the ids as unsigned little-endian 32-bit numbers, best first) and round_trip (whether
    decoding the best gives the text back), and ids (of the best) if ``with_ids``. Between equal scores
    the order is fixed by the places of the pieces. A text can have fewer segmentations than ``n``.

    A null or empty text has one segmentation of no pieces. A text with the mark that stands
    for a space (U+2581) decodes to a space there, and so doesn't make the round trip.
    Repeated rows repeat; only the two columns named are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(model_path)
        kind = pa.list_(pa.struct([("score", pa.float64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64())]))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            row = 0
            while row < len(texts):
                end, chars = row, 0
                while end < len(texts) and (end == row or chars + len(texts[end]) <= SLICE_CHARS):
                    chars += len(texts[end])
                    end += 1
                part = texts[row:end]
                found = segment_texts(model, part, n)
                nbest = [[{"score": s, "n_pieces": len(x), "ids_crc32": zlib.crc32(x.astype("<u4").tobytes())} for s, x in f] for f in found]
                same = [model.decode(f[0][1]) == t.encode("utf-8", "surrogatepass") for f, t in zip(found, part, strict=True)]
                columns = [batch.column(0).slice(row, end - row), pa.array([len(f[0][1]) for f in found], pa.int64()), pa.array(nbest, kind), pa.array(same)]
                names = ["id", "n_pieces", "nbest", "round_trip"]
                if with_ids:
                    columns.append(pa.array([f[0][1].astype(np.int32) for f in found], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
                row = end

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = "id long, n_pieces long, nbest array<struct<score: double, n_pieces: long, ids_crc32: long>>, round_trip boolean"
    return rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else "")).withColumnRenamed("id", id_col)


def decode_pieces(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and text: decodes a column of piece ids; a null gives a null, no ids the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(model_path)
        for batch in batches:
            texts = [model.decode(np.array(x.as_py(), np.int64)).decode("utf-8", "replace") if x.is_valid else None for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
