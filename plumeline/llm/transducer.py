"""Token counts by a deterministic transducer compiled from a vocabulary of pieces.

Pieces merge best score first, so the pieces of a text end in exactly one piece that fits the last
piece of the text before it. A state of the transducer holds, for each end of the text read so far
that may begin a piece, the piece before that end and how many pieces have come since. Reading a code
point leads to one state and adds a number of pieces, which may be negative where pieces merge. The
vocabulary's own prefixes are compiled on the driver; further states are compiled when a text first
leads to them, within a bound.

Texts are cut into chunks of CHUNK code points that advance together. A chunk's map takes the state
before it to the state after it. Where two neighbouring code points are together in no piece, the
transducer is at its start again, and a chunk that holds such a place has a constant map. Maps of
other chunks are tables over the states that can stand before them; they compose by doubling, as a
parallel prefix scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import pick, pieces, text_bytes

CHUNK = 256
#: Code points that are handled at a time, a multiple of CHUNK; a longer text takes several windows.
WINDOW = 1 << 20
PIECE_BYTES = 2_000_000
#: States beyond which those that texts have added are forgotten.
MAX_STATES = 400_000
#: Code points before an open chunk from which the states that may stand before it are guessed.
CONTEXT = 64
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_NODE, _LAST, _SINCE = 21, 21, 8  # bits of a code point beside a node; of a piece's node and of a number of pieces in a state's entry
_PAGE = 16  # bits of a row's place in a page of the table
_ZERO = 1 << _SINCE - 1  # pieces since may be negative
SPACE_MARK = "▁"


def read_pieces(path: str) -> dict[str, int]:
    """The mergeable pieces of a sentencepiece model with their ranks, best score first; equal scores share a rank.

    Supported: BPE with byte fallback, identity normaliser, a space put before the text, no user-defined
    pieces, and every code point in a piece is a piece itself.
    """
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm, trained = proto.normalizer_spec, proto.trainer_spec
    known = norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
    if not (known and trained.model_type == trained.BPE and trained.byte_fallback and not trained.treat_whitespace_as_suffix):
        raise ValueError("the model's kind or normaliser is not supported")
    plain = [p for p in proto.pieces if p.type == p.NORMAL]
    if not plain or any(p.type not in (p.NORMAL, p.BYTE, p.CONTROL, p.UNKNOWN) for p in proto.pieces):
        raise ValueError("user-defined and unused pieces are not supported")
    if {c for p in plain for c in p.piece} - {p.piece for p in plain}:
        raise ValueError("all code points must be pieces")
    rank = {s: k for k, s in enumerate(sorted({p.score for p in plain}, reverse=True))}
    return {p.piece: rank[p.score] for p in sorted(plain, key=lambda p: -p.score)}


class Transducer:
    """States, transitions and counts; `tables` and `of` carry a compiled one to other processes."""

    def __init__(self, rank: dict[str, int]) -> None:
        self.rank, ordered = rank, list(rank)
        letters = sorted({c for p in ordered for c in p})
        self.classes = len(letters) + 1
        self.letters = [0, *(ord(c) for c in letters)]
        self.class_of = np.zeros(0x110000, np.uint16)
        self.class_of[self.letters[1:]] = np.arange(1, self.classes)
        self.class_of[0x20] = self.class_of[ord(SPACE_MARK)]
        pairs = {(p[i], p[i + 1]) for p in ordered for i in range(len(p) - 1)}
        joining = sorted({c for ab in pairs for c in ab})
        self.group = np.zeros(self.classes, np.int32)
        self.group[self.class_of[[ord(c) for c in joining]]] = np.arange(1, len(joining) + 1)
        at = {c: k for k, c in enumerate(joining, 1)}
        self.joins = np.zeros((len(joining) + 1, len(joining) + 1), bool)
        for a, b in pairs:
            self.joins[at[a], at[b]] = True
        self.longest = max(map(len, ordered))
        self.child: dict[int, int] = {}
        self.text, self.inner = [""], [False]
        for p in ordered:
            node = 0
            for c in p:
                self.inner[node] = True
                key = node << _NODE | ord(c)
                if key not in self.child:
                    self.child[key] = len(self.text)
                    self.text.append(self.text[node] + c)
                    self.inner.append(False)
                node = self.child[key]
        self.piece = [t in self.rank for t in self.text]
        self.states: list[tuple[int, ...]] = [(_ZERO,)]  # entries: node, the last piece's node, pieces since
        self.number = {self.states[0]: 0}
        self._meets: dict[int, bool] = {}
        self._table(1 << _PAGE + 2)
        self._place(np.array([[0, _ZERO]]))  # a code point of no piece: counted by its bytes
        for p in ordered:  # compile the vocabulary's own prefixes
            s = 0
            for c in p:
                k = s * self.classes + int(self.class_of[ord(c)])
                if k not in self.known:
                    self._learn(np.array([k]))
                s = self.known[k]
        self.base = (len(self.states), self.table.copy(), self.rest.copy(), self.filled)

    def tables(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "known"}

    @classmethod
    def of(cls, tables: dict) -> Transducer:
        out = cls.__new__(cls)
        out.__dict__.update(tables)
        out.known = None
        return out

    def meet(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a: their joined text has just these two pieces. Node 0 stands for no piece."""
        k = a << _LAST | b
        if (hit := self._meets.get(k)) is None:
            hit = self._meets[k] = self._two(self.text[a], self.text[b])
        return hit

    def _two(self, a: str, b: str) -> bool:
        rank, sym, left = self.rank, list(a + b), len(a)
        while True:
            best, at = None, -1
            for i in range(len(sym) - 1):
                r = rank.get(sym[i] + sym[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return left == bool(a) and len(sym) == left + 1
            if at == left - 1:
                return False
            sym[at : at + 2] = [sym[at] + sym[at + 1]]
            left -= at < left

    def _step(self, s: int, cp: int) -> tuple[int, int]:
        """The state after a code point, and how many pieces it adds."""
        chosen, going = None, []
        for entry in self.states[s]:
            v = self.child.get(entry >> (_LAST + _SINCE) << _NODE | cp)
            if v is None:
                continue
            if self.inner[v]:
                going.append(v << (_LAST + _SINCE) | entry & ((1 << _LAST + _SINCE) - 1))
            if chosen is None and self.piece[v] and self.meet(entry >> _SINCE & ((1 << _LAST) - 1), v):
                chosen = v, 1 + _ZERO - (entry & ((1 << _SINCE) - 1))
        v, adds = chosen
        state = (v << _SINCE | _ZERO, *(e + adds for e in going))
        if (k := self.number.get(state)) is None:
            k = self.number[state] = len(self.states)
            self.states.append(state)
        return k, adds

    def _table(self, size: int) -> None:
        """An empty table; a row is a key (state and class) and what it leads to (state and added pieces).

        A key has one place. A state's keys lie in the page of its number, so that states which texts lead
        to early, and often, lie close together; the start's keys stand behind, by class. Keys whose
        place is taken stand apart, sorted.
        """
        self.size, self.filled = size, 0
        self.table = np.full((size + self.classes, 2), -1, np.int64)
        self.rest = np.full((1, 2), np.iinfo(np.int64).max, np.int64)
        self.known: dict[int, int] | None = {0: 0}

    def _slot(self, s: np.ndarray, c: np.ndarray, key: np.ndarray) -> np.ndarray:
        place = ((key.view(np.uint64) * _MULTIPLIER) >> np.uint64(64 - _PAGE)).view(np.int64) | (s << 2 >> _PAGE << _PAGE)
        return np.where(s == 0, self.size + c, place)

    def _place(self, rows: np.ndarray) -> None:
        """Put rows with distinct new keys in the table, all at once."""
        if 4 * len(self.states) > self.size:
            rows, known = np.r_[self.table[self.table[:, 0] >= 0], self.rest[:-1], rows], self.known
            self._table(2 * self.size)
            self.known = known
        key = np.ascontiguousarray(rows[:, 0])
        slot = self._slot(key // self.classes, key % self.classes, key)
        free = np.flatnonzero(self.table[slot, 0] < 0)
        self.table[slot[free[::-1]]] = rows[free[::-1]]
        left = rows[self.table[slot, 0] != key]
        if len(left):
            left = left[np.argsort(left[:, 0])]
            self.rest = np.insert(self.rest, np.searchsorted(self.rest[:, 0], left[:, 0]), left, axis=0)
        self.filled += len(rows)

    def _learn(self, key: np.ndarray) -> None:
        made = [self._step(k // self.classes, self.letters[k % self.classes]) for k in key.tolist()]
        self._place(np.column_stack([key, np.array([s << _SINCE | n + _ZERO for s, n in made], np.int64)]))
        if self.known is not None:
            self.known.update(zip(key.tolist(), [s for s, _ in made], strict=True))

    def trim(self) -> None:
        """Forget what texts have added, where it is more than MAX_STATES."""
        if len(self.states) > MAX_STATES or len(self._meets) > 8 * MAX_STATES:
            n, table, rest, self.filled = self.base
            self.table, self.rest, self.size = table.copy(), rest.copy(), len(table) - self.classes
            del self.states[n:]
            self.number = {s: k for k, s in enumerate(self.states)}
            self._meets = {}

    def advance(self, s: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States and added pieces after each lane reads its class."""
        key = s * self.classes + c
        while True:
            got = self.table.take(self._slot(s, c, key), axis=0)
            bad = np.flatnonzero(got[:, 0] != key)
            if bad.size:
                other = key[bad]
                found = self.rest.take(np.searchsorted(self.rest[:, 0], other), axis=0)
                new = found[:, 0] != other
                if new.any():
                    self._learn(np.unique(other[new]))
                    continue
                got[bad] = found
            to = got[:, 1]
            return to >> _SINCE, (to & ((1 << _SINCE) - 1)) - _ZERO

    def resets(self, cls: np.ndarray) -> np.ndarray:
        """Places whose code point is in no piece together with the one before; the first is not judged."""
        g = self.group[cls]
        out = np.zeros(len(cls), bool)
        out[1:] = ~self.joins[g[:-1], g[1:]]
        return out

    def window(self, cls: np.ndarray, reset: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
        """Added pieces at each place, and the state after the last, entering in state `entry`."""
        n, lanes = len(cls), -(-len(cls) // CHUNK)
        c, r = np.zeros(lanes * CHUNK, np.int32), np.ones(lanes * CHUNK, bool)
        c[:n], r[:n] = cls, reset
        c, r = np.ascontiguousarray(c.reshape(lanes, CHUNK).T), np.ascontiguousarray(r.reshape(lanes, CHUNK).T)
        closed, first = r.any(axis=0), r.argmax(axis=0)
        added = np.zeros((CHUNK, lanes), np.int8)
        s = np.zeros(lanes, np.int64)
        for i in range(CHUNK):
            s[r[i]] = 0
            s, added[i] = self.advance(s, c[i])
        enter = np.r_[entry, s[:-1]]
        if not closed.all():
            self._enter_open(c, closed, enter, s)
        lane = np.flatnonzero(~r[0])  # what stands before a chunk's first reset is read again from the right state
        state, until = enter[lane], np.where(closed[lane], first[lane], CHUNK)
        for i in range(CHUNK):
            more = until > i
            if not more.all():
                lane, state, until = lane[more], state[more], until[more]
            if not lane.size:
                break
            state, added[i, lane] = self.advance(state, c[i, lane])
        last = s[-1] if closed[-1] else state[lane == lanes - 1][0]
        return added.T.reshape(-1)[:n], int(last)

    def _run(self, s: np.ndarray, c: np.ndarray) -> np.ndarray:
        for row in c:
            s = self.advance(s, row)[0]
        return s

    def _enter_open(self, c: np.ndarray, closed: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> None:
        """Set the states before and after the chunks that hold no reset, and before those that follow them."""
        lanes = len(closed)
        opened = np.flatnonzero(~closed)
        head = opened[(opened == 0) | closed[opened - 1]]
        after = opened[(opened > 0) & ~closed[opened - 1]]
        chunk, state = [head], [enter[head]]
        for a in range(min(self.longest, CONTEXT)):  # states that may stand before a chunk, from starts at successive places
            chunk.append(after)
            state.append(self._run(np.zeros(len(after), np.int64), c[CHUNK - CONTEXT + a :, after - 1]))
        have, out = np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.unique((np.concatenate(chunk) << 32) | np.concatenate(state))
        right = np.full(lanes, -1, np.int64)
        while True:
            exits = self._run(new & 0xFFFFFFFF, c[:, new >> 32])
            have, out = np.r_[have, new], np.r_[out, exits]
            order = np.argsort(have)
            have, out = have[order], out[order]
            follows = (have >> 32) + 1
            want = (follows << 32) | out
            at = np.minimum(np.searchsorted(have, want), len(have) - 1)
            going = (follows < lanes) & ~closed[np.minimum(follows, lanes - 1)]
            jump = np.where(going & (have[at] == want), at, -1)
            right[:] = -1
            right[head] = np.searchsorted(have, (head << 32) | enter[head])
            jumps = [jump]
            while (1 << len(jumps)) < lanes:  # maps of twice as many chunks
                j = jumps[-1]
                jumps.append(np.where(j >= 0, j[np.maximum(j, 0)], -1))
            for k in reversed(range(len(jumps))):
                ok = np.flatnonzero(right >= 0)
                to = jumps[k][right[ok]]
                right[ok[to >= 0] + (1 << k)] = to[to >= 0]
            if (right[opened] >= 0).all():
                break
            new = np.unique(want[going & (jump < 0)])  # states that no guess had: tables grow by them
        enter[opened], leave[opened] = have[right[opened]] & 0xFFFFFFFF, out[right[opened]]
        then = opened[opened + 1 < lanes] + 1
        enter[then] = leave[then - 1]

    def count(self, texts: list[str]) -> np.ndarray:
        """Pieces of each text."""
        code = np.frombuffer("".join([SPACE_MARK + t for t in texts if t]).encode("utf-32-le"), np.uint32)
        size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        starts = np.cumsum(size) - size
        total, entry, before = np.zeros(len(code) + 1, np.int64), 0, None
        first = np.zeros(len(code), bool)
        first[starts[size > 0]] = True
        for a in range(0, len(code), WINDOW):
            cp = code[a : a + WINDOW]
            cls = self.class_of[cp].astype(np.int32)
            reset = self.resets(cls if before is None else np.r_[before, cls])
            reset = (reset if before is None else reset[1:]) | first[a : a + WINDOW]
            before = cls[-1:]
            added, entry = self.window(cls, reset, entry)
            added = added.astype(np.int64)
            other = np.flatnonzero(cls == 0)
            x = cp[other]
            added[other] = 1 + (x >= 0x80).astype(np.int64) + (x >= 0x800) + (x >= 0x10000)
            np.cumsum(added, out=total[a + 1 : a + 1 + len(cp)])
            total[a + 1 : a + 1 + len(cp)] += total[a]
        return total[starts + size] - total[starts]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, n_bytes, n_tokens), as the model's library counts them.

    The vocabulary is compiled on the driver, its tables, whose size it bounds, go to the executors.
    Strings of control pieces inside texts are plain text. A null text counts as empty, with no
    tokens. A very long text is taken in windows, so a task holds little more than the text itself.
    Ids may be null or repeat; other columns are left out.
    """
    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast(Transducer(read_pieces(model_path)).tables())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables.value.setdefault("live", None) or Transducer.of({k: v for k, v in tables.value.items() if k != "live"})
        tables.value["live"] = t  # a process's later tasks go on with what it has compiled
        for batch in batches:
            for part in pieces(batch, text_bytes(batch.column(1)), PIECE_BYTES):
                n = t.count([x or "" for x in part.column(1).to_pylist()])
                t.trim()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text_bytes(part.column(1))), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
