"""SentencePiece encoding and decoding as a relational lattice.

A text, with a leading U+2581 and U+2581 for each space, is cut into units that no piece can span. The distinct units of
all texts are encoded once, relationally: every substring of up to the longest piece's length is exploded and
equi-joined to the piece table; the edges of a unit are grouped and folded with Spark's higher-order ``aggregate``:

* by Viterbi: the best sum of scores up to each position and the piece that ends there, edge by edge in order of their
  ends, then the path back from the end. This is what a unigram model encodes to;
* a BPE model by merge order: edges that join exactly two neighbouring symbols are taken in the order of their scores, the
  leftmost of equals first. After a piece that may complete an earlier one, the order starts anew. Viterbi's best sum of
  scores is not what a BPE model encodes to, so for the public BPE model only this fold gives the library's ids;
  ``path_col`` gives Viterbi's path beside them.

The units' ids go back to the texts by broadcast as long as they take ``BROADCAST_BYTES`` at most. Beyond that texts are
put into chunks of about a megabyte, the distinct units of each chunk are joined to the table, and each chunk meets its
own units again: a frequent unit is one row for each chunk, and no task holds more than one chunk.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.store import saved
from arbora.llm.token_files import groups
from arbora.llm.words import span_hashes, text_chunks

SPACE = "▁"
BROADCAST_BYTES, MASK_CHARS, CHUNK = 96_000_000, 60, 1_000_000
#: Loss of pieces that the model all but forbids, in the packed fold; ``MASK_CHARS`` ordinary pieces cost less.
FORBIDDEN = 1 << 23
_GAP, _LETTER, _OTHER, _ALONE = range(4)


@dataclass(frozen=True)
class Pieces:
    """A model's piece table: (piece, score, id) of ordinary pieces, the ids of the 256 bytes, and all ids' bytes."""

    rows: tuple[tuple[str, float, int], ...]
    byte_ids: tuple[int, ...] | None
    unknown: int
    shown: tuple[bytes | None, ...]  # bytes of each id; None is a control piece

    @staticmethod
    def load(path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        rows, bytes_, shown = [], {}, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                bytes_[int(piece[3:5], 16)] = i
                shown.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                shown.append(" ⁇ ".encode() if sp.is_unknown(i) else None)
            else:
                rows.append((piece, sp.get_score(i), i))
                shown.append(piece.replace(SPACE, " ").encode())
        return Pieces(tuple(rows), tuple(bytes_[b] for b in range(256)) if len(bytes_) == 256 else None, sp.unk_id(), tuple(shown))

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.rows)

    def classes(self) -> np.ndarray:
        """Class of each code point: gap, letter, other, or alone (in no piece of several characters).

        Letters and others are told apart only if no piece holds both; a gap may stand only in front.
        """
        many = [p for p, _, _ in self.rows if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in many):
            raise ValueError("a piece holds a gap after another character")
        out = np.full(0x110000, _ALONE, np.uint8)
        for c in set("".join(many)):
            out[ord(c)] = _LETTER if c.isalpha() else _OTHER
        if any(len({out[ord(c)] for c in p.lstrip(SPACE)}) > 1 for p in many):
            out[out == _OTHER] = _LETTER
        out[[32, ord(SPACE)]] = _GAP
        return out

    def late(self) -> set[str]:
        """Pieces that, with a neighbour, make up a piece of better score: once one is taken, merging starts anew."""
        table = _scores(self)
        parts = lambda p: ((p[:k], p[k:]) for k in range(1, len(p)))
        known = lambda x: len(x) == 1 or x in table
        return {q for p, (score, _) in table.items() for x, y in parts(p) if known(x) and known(y) for q in (x, y) if len(q) > 1 and table[q][0] < score}

    def packed(self) -> bool:
        """Losses are whole numbers so small that the sums of all units fit the packed fold."""
        ordinary = [-s for _, s, _ in self.rows if -s < FORBIDDEN]
        return all(s == int(s) and s <= 0 for _, s, _ in self.rows) and max(ordinary, default=0) * MASK_CHARS < FORBIDDEN and max(i for _, _, i in self.rows) < 131071

    def best_path(self, unit: str) -> list[int]:
        """Viterbi ids of a unit that is too long for the packed fold; of equal sums the path whose last piece starts first."""
        table = _scores(self)
        best: list[tuple[float, int, list[int]]] = [(0.0, 0, [])]
        for e in range(1, len(unit) + 1):
            found = []
            for b in range(max(0, e - self.longest), e):
                piece = table.get(unit[b:e])
                if piece or b == e - 1:
                    loss = min(-piece[0], FORBIDDEN) if piece else FORBIDDEN + 10
                    found.append((best[b][0] + loss, b, [piece[1]] if piece else self.fallback(unit[b])))
            best.append(min(found, key=lambda x: x[:2]))
        ids, at = [], len(unit)
        while at:
            _, at, part = best[at]
            ids = [*part, *ids]
        return ids

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]

    def merge(self, unit: str) -> list[int]:
        """BPE ids of a unit, by a heap of neighbouring pairs; for units too long for the fold's bit mask."""
        table = _scores(self)
        symbols = list(unit)
        after, before = list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1))
        alive, heap = [True] * len(unit), []

        def offer(a: int) -> None:
            b = after[a]
            if b < len(unit) and (joined := symbols[a] + symbols[b]) in table:
                heapq.heappush(heap, (-table[joined][0], a, b, joined))

        for a in range(len(unit) - 1):
            offer(a)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if not (alive[a] and alive[b] and after[a] == b and symbols[a] + symbols[b] == joined):
                continue
            symbols[a], alive[b], after[a] = joined, False, after[b]
            if after[a] < len(unit):
                before[after[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [i for s, ok in zip(symbols, alive, strict=True) if ok for i in ([table[s][1]] if s in table else self.fallback(s))]


@lru_cache(4)
def _scores(pieces: Pieces) -> dict[str, tuple[float, int]]:
    return {p: (s, i) for p, s, i in pieces.rows}


@lru_cache(4)
def _load(path: str) -> Pieces:
    return Pieces.load(path)


def public_pieces(name: str = "piece_bpe_32k.model") -> Callable[[], Pieces]:
    """Finds a public model's pieces on whichever machine runs the task."""

    def resolve() -> Pieces:
        import public_tokenizers

        return _load(public_tokenizers.path(name))

    return resolve


@lru_cache(4)
def _classes(pieces: Pieces) -> np.ndarray:
    return pieces.classes()


def cut(texts: list[str], pieces: Pieces) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """Prefixed texts in a row, where units start, their hashes, and the first unit of each text (and the end)."""
    joined = "".join(SPACE + t if t else "" for t in texts).replace(" ", SPACE)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.concatenate([[0], np.cumsum([len(t) + 1 if t else 0 for t in texts])])
    kind = _classes(pieces)[codes]
    start = np.ones(len(codes), bool)
    start[1:] = ((kind[1:] != kind[:-1]) & (kind[:-1] != _GAP)) | (kind[1:] == _ALONE)
    start[edge[:-1][edge[:-1] < len(codes)]] = True
    start = np.flatnonzero(start)
    hashes = span_hashes(codes.astype(np.uint64) + np.uint64(1), start, np.append(start[1:], len(codes))) if len(codes) else np.zeros(0, np.uint64)
    return joined, start, hashes, np.searchsorted(start, edge)


def _units(resolve: Callable[[], Pieces]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, seen = resolve(), np.zeros(0, np.uint64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in groups(texts):
                joined, start, hashes, _ = cut(texts[a:b], pieces)
                keys, inverse = np.unique(hashes, return_inverse=True)
                first = np.zeros(len(keys), np.int64)
                first[inverse] = np.arange(len(inverse))
                seen = seen if len(seen) < CHUNK else np.zeros(0, np.uint64)
                place = np.searchsorted(seen, keys)
                new = seen[np.minimum(place, len(seen) - 1)] != keys if len(seen) else np.ones(len(keys), bool)
                seen = np.insert(seen, place[new], keys[new])
                end = np.append(start[1:], len(joined))[: len(start)]
                at = first[new]
                yield pa.RecordBatch.from_pydict({"unit": pa.array([joined[x:y] for x, y in zip(start[at].tolist(), end[at].tolist(), strict=True)], pa.string())})

    return run


def _long(resolve: Callable[[], Pieces]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, pieces = batch.column(0).to_pylist(), resolve()
            yield pa.RecordBatch.from_pydict({"unit": pa.array(units, pa.string()), "ids": pa.array([pieces.merge(u) for u in units], pa.list_(pa.int32())), "path": pa.array([pieces.best_path(u) for u in units], pa.list_(pa.int32()))})

    return run


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """(piece, score, id, rank, late): rank is the piece's place by falling score; see :meth:`Pieces.late`."""
    rows, late = sorted(pieces.rows, key=lambda r: (-r[1], r[2])), pieces.late()
    return spark.createDataFrame(pa.Table.from_pydict({"piece": [p for p, _, _ in rows], "score": [s for _, s, _ in rows], "id": pa.array([i for _, _, i in rows], pa.int32()), "rank": pa.array(range(len(rows)), pa.int64()), "late": [p in late for p, _, _ in rows]}))


def _edges(units: DataFrame, pieces: Pieces) -> DataFrame:
    """The pieces among each unit's substrings; single characters always, with null if they are no piece.

    ``units`` must be partitioned by unit: then no row moves when its edges are grouped. The piece table is as large as
    the model's vocabulary.
    """
    starts = units.select("unit", F.char_length("unit").alias("n"), F.explode(F.expr("sequence(0, char_length(unit) - 1)")).alias("s"))
    ends = starts.select("unit", "s", F.explode(F.expr(f"sequence(s + 1, least(s + {pieces.longest}, n))")).alias("e"))
    subs = ends.select("unit", "s", "e", F.expr("substring(unit, s + 1, e - s)").alias("sub"))
    return subs.join(F.broadcast(piece_table(units.sparkSession, pieces)), F.col("sub") == F.col("piece"), "left").filter("id is not null or e = s + 1")


def _bytes_sql(pieces: Pieces, char: str) -> str:
    if not pieces.byte_ids:
        return f"array({pieces.unknown})"
    table = "array(" + ",".join(map(str, pieces.byte_ids)) + ")"
    return f"transform(sequence(1, octet_length({char})), k -> {table}[cast(conv(substring(hex({char}), 2 * k - 1, 2), 16, 10) as int)])"


def _ids_sql(chosen: str, start: str, number: str, pieces: Pieces) -> str:
    """SQL: ids of chosen edges ``x``: their number less 1; of a character that is no piece (number 0) the fallback's."""
    return f"flatten(transform({chosen}, x -> if({number} = 0, transform(array(substring(unit, {start} + 1, 1)), c -> {_bytes_sql(pieces, 'c')})[0], array(cast({number} - 1 as int)))))"


def merge_fold(units: DataFrame, pieces: Pieces, path: bool = False) -> DataFrame:
    """(unit, ids) of a BPE model, for units of up to ``MASK_CHARS`` characters; with ``path`` Viterbi's path as well.

    An edge is a long: rank, start, end, a bit for late pieces and id + 1 (0: no piece), from the highest bits to the
    lowest, so edges sort by merge order. Bit k of the mask says that a symbol starts or ends at k; an edge can be merged
    if its ends are set and just one bit between them is. A pass goes over all edges in order. It stops merging at a late
    piece, and another pass follows; without one, no edge passed over can have become possible.

    For Viterbi an edge is another long: end, start, loss and id + 1, so edges sort by their ends. best has, for each
    position done, loss << 23 | start << 17 | id + 1 of the best way there; now is the least for the position in work.
    """
    edge = "(coalesce(rank, 1048575L) << 43) | (cast(s as bigint) << 37) | (cast(e as bigint) << 31) | if(late, 1073741824L, 0L) | cast(coalesce(id, -1) + 1 as bigint)"
    marks = "struct(" + edge + " as k, shiftleft(1L, s) | shiftleft(1L, e) as ends, shiftleft(1L, e + 1) - shiftleft(1L, s) as span)"
    step = f"(cast(e as bigint) << 52) | (cast(s as bigint) << 46) | (cast(coalesce(least(-score, {FORBIDDEN}), {FORBIDDEN + 10}) as bigint) << 17) | cast(coalesce(id, -1) + 1 as bigint)"
    lists = [F.collect_list("edge").alias("edges"), *([F.collect_list("step").alias("steps")] if path else [])]
    grouped = _edges(units, pieces).select("unit", F.expr(marks).alias("edge"), F.expr(step).alias("step")).groupBy("unit").agg(*lists)
    kept = ["unit", "edges", *(["steps"] if path else [])]
    one = """aggregate(marks, struct(a.m as m, true as go, false as again), (b, x) -> if(b.go and (b.m & x.ends) = x.ends and bit_count(b.m & x.span) = 3,
               struct((b.m & ~x.span) | x.ends as m, x.k & 1073741824L = 0 as go, x.k & 1073741824L != 0 as again), b))"""
    mask = grouped.select(*kept, F.expr(f"""
        aggregate(array(sort_array(filter(edges, x -> bit_count(x.span) > 2))), 0L, (none, marks) ->
          aggregate(sequence(1, char_length(unit)), struct(shiftleft(1L, char_length(unit) + 1) - 1L as m, true as again),
            (a, i) -> if(a.again, transform(array({one}), b -> struct(b.m as m, b.again as again))[0], a)).m)""").alias("mask"))
    # the mask is bound to a name: inside the lambda the optimizer may put its whole expression in its place
    chosen = F.expr("transform(array(mask), m -> sort_array(transform(filter(edges, x -> (m & x.span) = x.ends), x -> x.k & 8796093022207L)))[0]")  # without the rank, edges sort by start
    out = mask.select("unit", chosen.alias("chosen"), *(["steps"] if path else []))
    ids = F.expr(_ids_sql("chosen", "cast(shiftright(x, 37) & 63 as int)", "(x & 1073741823L)", pieces)).alias("ids")
    if not path:
        return out.select("unit", ids)
    start = "cast(shiftright(x, 46) & 63 as int)"
    way = f"(shiftleft(shiftright(best[{start}], 23) + (shiftright(x, 17) & 536870911L), 23) | shiftleft(shiftright(x, 46) & 63, 17) | (x & 131071L))"
    done = f"""aggregate(sort_array(steps), struct(array(0L) as best, 0L as now), (a, x) ->
        transform(array(if(shiftright(x, 52) > size(a.best), array_append(a.best, a.now), a.best)), best ->
          struct(best as best, if(size(best) > size(a.best) or a.now = 0, {way}, least(a.now, {way})) as now))[0])"""
    out = out.select("unit", ids, F.expr(f"transform(array({done}), a -> array_append(a.best, a.now))[0]").alias("best"))
    back = "aggregate(sequence(1, char_length(unit)), struct(char_length(unit) as at, cast(array() as array<bigint>) as way), (p, i) -> if(p.at > 0, struct(cast(shiftright(best[p.at], 17) & 63 as int) as at, concat(array(best[p.at]), p.way) as way), p)).way"
    return out.select("unit", "ids", F.expr(_ids_sql(f"({back})", "cast(shiftright(x, 17) & 63 as int)", "(x & 131071L)", pieces)).alias("path"))


def viterbi_fold(units: DataFrame, pieces: Pieces, unknown_penalty: float = 10.0) -> DataFrame:
    """(unit, ids) of a unigram model: the path of the best sum of scores; of equals, that whose last piece starts first.

    A character that is no piece costs the worst piece's loss and ``unknown_penalty`` more.
    """
    worst = max(-s for _, s, _ in pieces.rows) + unknown_penalty
    edges = _edges(units, pieces).groupBy("unit").agg(F.collect_list(F.expr("struct(-score as loss, s, e, id)")).alias("edges"))
    path = F.expr(f"""
        aggregate(array_sort(transform(edges, x -> struct(x.e as e, x.s as s, coalesce(x.loss, {worst}D) as loss, x.id as id))),
          transform(sequence(0, char_length(unit)), k -> struct(if(k = 0, 0D, double('inf')) as loss, cast(array() as array<struct<s: int, id: int>>) as path)),
          (best, x) -> if(best[x.s].loss + x.loss < best[x.e].loss,
            transform(best, (b, k) -> if(k = x.e, struct(best[x.s].loss + x.loss as loss, concat(best[x.s].path, array(struct(x.s as s, x.id as id))) as path), b)), best)
        )[char_length(unit)].path""")
    chosen = edges.select("unit", path.alias("chosen"))
    return chosen.select("unit", F.expr(f"flatten(transform(chosen, x -> if(x.id is null, transform(array(substring(unit, x.s + 1, 1)), c -> {_bytes_sql(pieces, 'c')})[0], array(x.id))))").alias("ids"))


def unit_table(texts: DataFrame, resolve: Callable[[], Pieces], algorithm: str, path: bool = False) -> DataFrame:
    """(unit, ids) of all distinct units of the text column, in the shared folder; with ``path`` also Viterbi's path."""
    pieces, spark = resolve(), texts.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    units = texts.mapInArrow(_units(resolve), "unit string").distinct().repartition(n, "unit")
    if algorithm == "unigram":
        found = viterbi_fold(units, pieces)
        return saved(found.withColumn("path", F.col("ids")) if path else found, "units")
    if path and not pieces.packed():
        raise ValueError("the model's scores don't fit the packed fold")
    units = saved(units, "distinct-units")
    short = units.filter(F.char_length("unit") <= MASK_CHARS).repartition(n, "unit")
    long_ = units.filter(F.char_length("unit") > MASK_CHARS).mapInArrow(_long(resolve), "unit string, ids array<int>, path array<int>")
    return saved(merge_fold(short, pieces, path).unionByName(long_ if path else long_.drop("path")), "units")


def _unit_hashes(units: pa.Array) -> np.ndarray:
    texts = units.to_pylist()
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    end = np.cumsum([len(u) for u in texts])
    return span_hashes(codes, np.concatenate([[0], end[:-1]]), end) if texts else np.zeros(0, np.uint64)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of lists, and all their values in a row."""
    offsets = lists.offsets.to_numpy()
    return np.diff(offsets), lists.values[offsets[0] : offsets[-1]].to_numpy(zero_copy_only=False) if len(lists) else np.zeros(0, np.int32)


def _hashed(columns: int, kind: type) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch of the unit table as one row: keys, and for each list column lengths and values, as bytes."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = [_unit_hashes(batch.column(0)).tobytes()]
                for k in range(1, columns + 1):
                    n, values = _flat(batch.column(k))
                    parts += [n.astype(np.uint32).tobytes() if n.max() > 65535 else n.astype(np.uint16).tobytes(), values.astype(kind).tobytes()]
                yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())} | {f"c{k}": pa.array([x], pa.binary()) for k, x in enumerate(parts)})

    return run


@dataclass
class Table:
    """Units' hashes in order, and for each list column where each unit's values start, and the values."""

    keys: np.ndarray
    lists: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(keys: np.ndarray, lists: Iterable[tuple[np.ndarray, np.ndarray]]) -> Table:
        order, out = np.argsort(keys), []
        for n, values in lists:
            at = np.concatenate([[0], np.cumsum(n[order], dtype=np.int64)])
            out.append((at.astype(np.int64 if at[-1] >> 31 else np.int32), _spans(values, (np.cumsum(n, dtype=np.int64) - n)[order], n[order])))
        return Table(keys[order], out)

    def values(self, units: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a sequence of units: where each one's values end in a row of all, from 0 on, and the row."""
        distinct, inverse = np.unique(units, return_inverse=True)
        row, (at, flat) = np.searchsorted(self.keys, distinct)[inverse], self.lists[k]
        n = (at[row + 1] - at[row]).astype(np.int64) if len(row) else np.zeros(0, np.int64)
        return np.concatenate([[0], np.cumsum(n)]), _spans(flat, at[row], n).astype(np.int32)


def _spans(values: np.ndarray, first: np.ndarray, n: np.ndarray, part: int = 1 << 18) -> np.ndarray:
    """values[first[i] : first[i] + n[i]] for all i in a row; the index of one part at a time is in memory."""
    ends = np.cumsum(n, dtype=np.int64)
    out = np.empty(int(ends[-1]) if len(ends) else 0, values.dtype)
    for a in range(0, len(ends), part):
        own, base = slice(a, a + part), int(ends[a - 1]) if a else 0
        size = n[own].astype(np.int64)
        at = np.arange(size.sum()) + np.repeat(first[own] - (ends[own] - size - base), size)
        out[base : base + len(at)] = values[at]
    return out


def _collected(table: DataFrame, columns: int, kind: type) -> Table:
    """The unit table on the driver, as compact bytes."""
    schema = ", ".join(["n long", *(f"c{k} binary" for k in range(2 * columns + 1))])
    rows = table.mapInArrow(_hashed(columns, kind), schema).toArrow()

    def taken(name: str, kind_: type | None) -> np.ndarray:  # a column's bytes; the column goes
        nonlocal rows
        count = rows["n"].to_pylist()
        parts = [x.as_buffer() for x in rows[name]]
        rows = rows.drop_columns([name])
        sized = [np.frombuffer(x, kind_ or (np.uint16 if x.size == 2 * n else np.uint32)) for x, n in zip(parts, count, strict=True)]
        return np.concatenate([np.zeros(0, kind_ or np.uint16), *sized])

    return Table.of(taken("c0", np.uint64), ((taken(f"c{2 * k + 1}", None), taken(f"c{2 * k + 2}", kind)) for k in range(columns)))


@lru_cache(4)
def _shown(pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """All ids' bytes in a row, and where each id's start."""
    shown = [b or b"" for b in pieces.shown]
    return np.frombuffer(b"".join(shown), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in shown])])


def texts_of(ids: np.ndarray, bounds: np.ndarray, pieces: Pieces) -> list[str]:
    """The texts of lists of ids in a row: their pieces' bytes as UTF-8, without the leading space."""
    flat, at = _shown(pieces)
    n = at[ids + 1] - at[ids] if len(ids) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    data = flat[np.arange(ends[-1]) + np.repeat(at[ids] - ends[:-1], n)].tobytes() if len(ids) else b""
    cut_ = ends[bounds].tolist()
    return [data[a:b].removeprefix(b" ").decode(errors="replace") for a, b in zip(cut_[:-1], cut_[1:], strict=True)]


def _encoded(texts: list[str], table: Table, pieces: Pieces, types: list[pa.DataType], columns: int, decoded: bool) -> list[pa.Array]:
    """For each list column the texts' values, and at last the text that the first of them decode to."""
    _, _, hashes, bounds = cut(texts, pieces)
    made = []
    for k in range(columns):
        ends, ids = table.values(hashes, k)
        made.append(pa.ListArray.from_arrays(pa.array(ends[bounds].astype(np.int32)), pa.array(ids)).cast(types[k]))
        if k == 0 and decoded:
            shown = pa.array(texts_of(ids, ends[bounds], pieces), pa.string())
    return [*made, *([shown.cast(types[columns])] if decoded else [])]


def _encode(resolve: Callable[[], Pieces], table, schema, text_at: int, width: int, columns: int, decoded: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        types = [f.type for f in arrow][width:]
        for batch in batches:
            for a, b, _, _ in text_chunks(batch.column(text_at), 1_000_000):
                made = _encoded(batch.column(text_at).slice(a, b - a).fill_null("").to_pylist(), table.value, resolve(), types, columns, decoded)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(width)), *made], schema=arrow)

    return run


def encode(docs: DataFrame, text_col: str = "text", out_col: str = "ids", model: str = "piece_bpe_32k.model", algorithm: str = "bpe", broadcast_bytes: int = BROADCAST_BYTES, decoded_col: str | None = None, path_col: str | None = None) -> DataFrame:
    """docs with ``out_col``, the array of the text's piece ids; a column of that name is replaced.

    ``path_col`` names a further column for the ids of Viterbi's path, ``decoded_col`` one for the text that the ids
    decode to, as :func:`decode` gives it. Null and empty texts have no ids. U+2581 in a text counts as a space. Rows are
    kept as they are, whatever repeats. An empty table comes back empty.
    """
    from pyspark.sql import types as T

    spark, resolve = docs.sparkSession, public_pieces(model)
    text = F.col(text_col).cast("string")
    table = unit_table(docs.select(F.coalesce(text, F.lit("")).alias("text")), resolve, algorithm, bool(path_col))
    keep = [c for c in docs.columns if c not in (out_col, path_col, decoded_col)]
    lists, columns, kind = [out_col, *([path_col] if path_col else [])], 1 + bool(path_col), np.uint16 if len(resolve().shown) <= 65536 else np.int32
    kept = docs.select(*keep)
    added = [*(T.StructField(c, T.ArrayType(T.IntegerType())) for c in lists), *([T.StructField(decoded_col, T.StringType())] if decoded_col else [])]
    schema = T.StructType([*kept.schema.fields, *added])
    width = sum(2 + np.dtype(kind).itemsize * F.size(c) for c in ("ids", "path")[:columns])
    if (table.agg(F.sum(8 + width)).first()[0] or 0) > broadcast_bytes:
        return _encode_joined(kept, docs.select(*keep, text.alias("__piece_text")), table, resolve, schema, columns, bool(decoded_col))
    shared = spark.sparkContext.broadcast(_collected(table, columns, kind))
    pa.default_memory_pool().release_unused()
    if text_col in keep and schema[text_col].dataType == T.StringType():
        return kept.mapInArrow(_encode(resolve, shared, schema, keep.index(text_col), len(keep), columns, bool(decoded_col)), schema)
    return docs.select(*keep, text.alias("__piece_text")).mapInArrow(_encode(resolve, shared, schema, len(keep), len(keep), columns, bool(decoded_col)), schema)


def _chunked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the number of their chunk, a run of texts (the last column) of about a megabyte."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        for a, b, _, _ in text_chunks(batch.column(batch.num_columns - 1), 1_000_000):
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array([number] * (b - a), pa.int64())], names=[*batch.schema.names, "__piece_chunk"])
            number += 1


def _chunk_units(resolve: Callable[[], Pieces]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(chunk, unit) of the distinct units of each chunk within a batch."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk = batch.column(0).to_numpy()
            first = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]) if len(chunk) else np.zeros(0, np.int64)
            for a, b in zip(first.tolist(), [*first.tolist()[1:], len(chunk)], strict=True):
                joined, start, hashes, _ = cut(batch.column(1).slice(a, b - a).fill_null("").to_pylist(), resolve())
                end, one = np.append(start[1:], len(joined))[: len(start)], np.unique(hashes, return_index=True)[1]
                yield pa.RecordBatch.from_pydict({"__piece_chunk": pa.array(np.full(len(one), chunk[a])), "unit": pa.array([joined[x:y] for x, y in zip(start[one].tolist(), end[one].tolist(), strict=True)], pa.string())})

    return run


def _encode_joined(kept: DataFrame, rows: DataFrame, table: DataFrame, resolve: Callable[[], Pieces], schema, columns: int, decoded: bool) -> DataFrame:  # noqa: ANN001
    """The way for more units than are broadcast: chunks of rows meet the ids of their own distinct units."""
    from pyspark.sql import types as T

    width = len(kept.columns)
    rows = saved(rows.mapInArrow(_chunked, T.StructType([*rows.schema.fields, T.StructField("__piece_chunk", T.LongType())])), "chunks")
    units = rows.select("__piece_chunk", "__piece_text").mapInArrow(_chunk_units(resolve), "__piece_chunk long, unit string")
    own = units.join(table, "unit").select("__piece_chunk", "unit", *("ids", "path")[:columns])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        right = right.combine_chunks()
        column = lambda k: right.column(k).combine_chunks() if right.num_rows else pa.array([], right.schema.field(k).type)
        known = Table.of(_unit_hashes(column(1)), [_flat(column(k)) for k in range(2, 2 + columns)])
        texts = left.column(width).combine_chunks() if left.num_rows else pa.array([], pa.string())
        made = _encoded(texts.fill_null("").to_pylist(), known, resolve(), [f.type for f in arrow][width:], columns, decoded)
        return pa.Table.from_arrays([*left.columns[:width], *made], schema=arrow)

    return rows.groupBy("__piece_chunk").cogroup(own.groupBy("__piece_chunk")).applyInArrow(meet, schema)


def _decode(resolve: Callable[[], Pieces], schema) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            last = batch.num_columns - 1
            lists = batch.column(last)
            offsets = lists.offsets.to_numpy()
            ids = lists.values[offsets[0] : offsets[-1]].to_numpy(zero_copy_only=False) if len(lists) else np.zeros(0, np.int32)
            null = lists.is_null().to_pylist()
            texts = texts_of(ids.astype(np.int64), offsets - offsets[0], resolve()) if len(lists) else []
            texts = [None if n else t for t, n in zip(texts, null, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(texts, arrow.field(last).type)], schema=arrow)

    return run


def decode(docs: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model: str = "piece_bpe_32k.model") -> DataFrame:
    """docs with ``out_col``, the text of the ids; null ids give null. Runs of byte pieces decode as UTF-8."""
    from pyspark.sql import types as T

    keep = [c for c in docs.columns if c != out_col]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(out_col, T.StringType())])
    return docs.select(*keep, F.col(ids_col).alias("__piece_ids")).mapInArrow(_decode(public_pieces(model), schema), schema)
