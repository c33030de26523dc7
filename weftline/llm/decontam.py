"""Benchmark decontamination: passages of benchmark items within a small edit distance, anywhere in whole texts.

The CGK random walk embeds a string so that edits become a bounded number of differing positions: step j copies the
character it stands on and moves on if a random bit for (j, character) says so. Strings that share a window's walk
agree on most positions, so bit-sampling LSH (a few sampled positions a table, several tables for each of several
walks) brings near copies together. Item windows start at every word of an item, document windows at every few
words: whatever the passage's place, some document window in it starts where an item window does. Colliding
windows within a Hamming bound give candidates, and the item's exact edit distance to the best place there decides.
In scripts without spaces every character counts as a word.

Walks and tables are as many as meet the recall target for items edited as much as is allowed, whatever number of
windows they have. Items too short for windows, and those that no number of tables brings there, are searched exactly: cut
into one piece more than the edits allowed, an edited passage keeps one piece unedited, and an automaton of all pieces
finds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import send

#: Share of an item's characters that may be edited; for candidates, of a walk's steps that may differ and of a
#: window's first 64 bytes that may be edited.
MAX_EDITS, MAX_WALK_GAP, MAX_PIECE_EDITS = 0.2, 0.7, 0.36
#: Walks, sampled positions of a table, most tables of a walk, and the recall to reach for items with as many edits as
#: are allowed, measured on TRIALS of them.
WALKS, SAMPLED, MOST_TABLES, TARGET_RECALL, TRIALS = 4, 8, 16, 0.97, 400
#: Window kinds, longest first: least characters of an item window, words between document windows, steps of the walk.
KINDS = ((44, 4, 64), (22, 2, 32))
#: What a step of a walk, a look into a table and a pair to compare cost a document window, in about nanoseconds.
STEP_COST, TABLE_COST, PAIR_COST = 4, 13, 2000
#: Bytes of benchmark text whose index is held at once, some 0.2 KB a byte; a larger benchmark is searched for in parts.
PART_BYTES = 4 << 20
TABLE_BITS = 20
_BLOCK = 1 << 17


def normal(text: str | None) -> bytes:
    """ASCII lower case, white space as single spaces."""
    return b" ".join((text or "").encode().lower().split())


def edits_within(item: bytes, text: bytes, most: int) -> int | None:
    """The least edit distance of the item to any substring of the text, by Myers' bit vectors; None above ``most``."""
    if not item:
        return None
    if item in text:
        return 0
    m = len(item)
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(d | plus) & full
        down = plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            best = min(best, score)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(x | up) & full, up & x
    return best if best <= most else None


def piece_masks(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For Myers' algorithm over many pieces of at most 64 bytes: positions by byte (its low six bits), lengths."""
    masks = np.zeros((len(pieces), 64), np.uint64)
    for i, piece in enumerate(pieces):
        for j, c in enumerate(piece[:64]):
            masks[i, c & 63] |= np.uint64(1 << j)
    return masks, np.array([min(64, len(p)) for p in pieces], np.int32)


def edits_between_borders(item: bytes, text: bytes, starts: range, ends: np.ndarray, most: int) -> int | None:
    """The least edit distance of the item to text[a:b], a of starts and b of ends where borders are; None above ``most``."""
    m = len(item)
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top, best = (1 << m) - 1, 1 << (m - 1), most + 1
    for a in starts:
        if not ends[a]:
            continue
        plus, minus, score = full, 0, m
        for at in range(a, min(len(text), a + m + most)):
            eq = masks.get(text[at], 0)
            x = eq | minus
            d = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | ~(d | plus) & full, plus & d
            score += 1 if up & top else -1 if down & top else 0
            if score < best and ends[at + 1]:
                best = score
            up, down = (up << 1 | 1) & full, down << 1 & full
            plus, minus = down | ~(x | up) & full, up & x
    return best if best <= most else None


def piece_edits(masks: np.ndarray, lengths: np.ndarray, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The least edit distance of each piece to a stretch of the text that begins at its start; never above the true one."""
    one = np.uint64(1)
    plus, minus = np.full(len(starts), ~np.uint64(0)), np.zeros(len(starts), np.uint64)
    top = one << (lengths - 1).astype(np.uint64)
    score = lengths.copy()
    best = score.copy()
    row = np.arange(len(starts))
    at = starts.astype(np.int64)
    for _ in range(80):
        eq = masks[row, text[np.minimum(at, len(text) - 1)] & 63]
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(d | plus), plus & d
        score += (up & top) != 0
        score -= (down & top) != 0
        np.minimum(best, score, out=best)
        up, down = up << one | one, down << one
        plus, minus = down | ~(x | up), up & x
        at += 1
    return best


@dataclass
class Kind:
    """The index of all item windows of one kind."""

    stride: int
    moves: np.ndarray  # walks x steps x 256
    sampled: np.ndarray  # walks x tables x SAMPLED, sorted
    item: np.ndarray  # of each window
    offset: np.ndarray  # its start in the item, in bytes
    walked: np.ndarray  # walks x steps x windows
    masks: np.ndarray  # of each window's first 64 bytes
    lengths: np.ndarray
    chance: np.ndarray  # walks x tables: of how many windows a document window collides with by chance
    present: np.ndarray = field(init=False)
    hashes: list = field(init=False)
    order: list = field(init=False)
    mix: np.ndarray = field(init=False)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "present"}  # a megabyte a table, quickly made again

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.mark()

    def mark(self) -> None:
        """Which leading bits of hashes there are in each table."""
        walks, tables = self.sampled.shape[:2]
        self.present = np.zeros((walks, tables, 1 << TABLE_BITS), bool)
        for n, h in enumerate(self.hashes):
            self.present[n // tables, n % tables, h >> np.uint32(32 - TABLE_BITS)] = True

    def __post_init__(self) -> None:
        walks, tables = self.sampled.shape[:2]
        self.mix = np.random.default_rng(7).integers(1, 1 << 32, (walks, tables, SAMPLED), dtype=np.uint32) | np.uint32(1)
        self.hashes, self.order = [], []
        for w in range(walks):
            for t in range(tables):
                h = self.hash_of(self.walked[w], w, t)
                order = np.argsort(h, kind="stable")
                self.hashes.append(h[order])
                self.order.append(order)
        self.mark()

    def cut(self, walks: int, tables: int, kept: np.ndarray) -> Kind:
        """The first walks and tables, and the windows kept."""
        return Kind(self.stride, self.moves[:walks], self.sampled[:walks, :tables], self.item[kept], self.offset[kept], self.walked[:walks, :, kept], self.masks[kept], self.lengths[kept], self.chance[:walks, :tables])

    def candidates(self, text: np.ndarray, begins: list[int] | None = None) -> Iterator[tuple[int, int, int, int]]:
        """(place of the item's start, item, walk, table) of windows that collide and are close.

        Document windows are every ``stride`` words of the whole text, or of each part where ``begins`` are given.
        """
        starts = word_starts(text)
        if begins is None:
            own = starts[:: self.stride]
        else:
            cuts = [*np.searchsorted(starts, begins).tolist(), len(starts)]
            own = np.concatenate([starts[a:b][:: self.stride] for a, b in zip(cuts, cuts[1:], strict=False)])
        steps = self.moves.shape[1]
        padded = np.concatenate([text, np.zeros(steps + 1, np.uint8)])
        for begin in range(0, len(own), _BLOCK):
            part = own[begin : begin + _BLOCK]
            for w, moves in enumerate(self.moves):
                walked = walk(padded, part, moves)
                for t in range(self.sampled.shape[1]):
                    h = self.hash_of(walked, w, t)
                    at = np.flatnonzero(self.present[w, t][h >> np.uint32(32 - TABLE_BITS)])
                    if not len(at):
                        continue
                    n = w * self.sampled.shape[1] + t
                    low = np.searchsorted(self.hashes[n], h[at])
                    count = np.searchsorted(self.hashes[n], h[at], side="right") - low
                    a = np.repeat(at, count)
                    if not len(a):
                        continue
                    b = self.order[n][np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
                    gap = (walked[:, a] != self.walked[w][:, b]).sum(axis=0)
                    ok = gap <= MAX_WALK_GAP * steps
                    a, b = a[ok], b[ok]
                    ok = piece_edits(self.masks[b], self.lengths[b], text, part[a]) <= MAX_PIECE_EDITS * self.lengths[b]
                    yield from ((start, own_, w, t) for start, own_ in zip((part[a[ok]] - self.offset[b[ok]]).tolist(), self.item[b[ok]].tolist(), strict=True))

    def hash_of(self, walked: np.ndarray, w: int, t: int) -> np.ndarray:
        h = np.zeros(walked.shape[1], np.uint32)
        for k, at in enumerate(self.sampled[w, t]):
            h = (h ^ walked[at]) * self.mix[w, t, k]
        return h ^ (h >> np.uint32(15)) * np.uint32(2654435769)


def walk(text: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The embedding of the windows that start at ``starts``: steps x windows. The text ends in enough padding."""
    at = starts.astype(np.int32)
    out = np.empty((len(moves), len(starts)), np.uint8)
    for j, move in enumerate(moves):
        c = text[at]
        out[j] = c
        at += move[c]
    return out


_byte = np.arange(256)
#: Letters, digits and bytes of characters beyond ASCII; of these, first bytes of three or four are words of their own.
_WORDY = (_byte >= 128) | ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 97) & (_byte <= 122))


def word_starts(text: np.ndarray) -> np.ndarray:
    wordy = _WORDY[text]
    return np.flatnonzero((wordy & ~np.r_[False, wordy[:-1]]) | (text >= 0xE0)).astype(np.int32)


def word_borders(text: np.ndarray) -> np.ndarray:
    """For each place, the end included, whether it is inside no word."""
    wordy = np.r_[False, _WORDY[text], False]
    return ~(wordy[:-1] & wordy[1:]) | np.r_[text >= 0xE0, True]


def _perturbed(windows: list[bytes], rng: np.random.Generator, share: float) -> list[bytes]:
    out = []
    for window in windows:
        s = bytearray(window)
        for _ in range(max(1, round(share * len(window)))):
            at, kind, c = int(rng.integers(len(s))), int(rng.integers(3)), int(rng.integers(97, 123))
            if kind == 0:
                s[at] = c
            elif kind == 1:
                s.insert(at, c)
            elif len(s) > 1:
                del s[at]
        out.append(bytes(s))
    return out


def _collisions(rows: np.ndarray) -> float:
    """How many other columns a column is like, on average."""
    mixed = np.zeros(rows.shape[1], np.uint64)
    for row in rows:
        mixed = (mixed ^ row) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    _, counts = np.unique(mixed, return_counts=True)
    return float((counts * (counts - 1)).sum() / max(1, counts.sum()))


def build_kind(items: list[bytes], which: list[int], least: int, stride: int, steps: int, seed: int, max_edits: float) -> tuple[Kind, dict[int, np.ndarray]]:
    """Windows of the given items at every word with ``least`` characters or more after it, in MOST_TABLES of WALKS.

    And for each item the recall that the first walks and tables give to items with as many windows (those with few
    are the hardest), walks x tables, measured with ``max_edits`` of their characters edited at random.
    """
    rng = np.random.default_rng(seed)
    moves = rng.integers(0, 2, (WALKS, steps, 256)).astype(np.int32)
    item, offset, windows = [], [], []
    for i in which:
        text = np.frombuffer(items[i], np.uint8)
        for at in word_starts(text):
            if len(text) - at >= least:
                item.append(i)
                offset.append(int(at))
                windows.append(items[i][at:])
    cut = [w[:steps].ljust(steps + 1, b"\0") for w in windows]
    text = np.frombuffer(b"".join(cut) + b"\0" * steps, np.uint8)
    walked = np.stack([walk(text, np.arange(len(windows)) * (steps + 1), m) for m in moves])
    used = min(steps, 2 * least)  # positions that the shortest windows reach
    sampled = np.sort(np.stack([[rng.choice(used, SAMPLED, replace=False) for _ in range(3 * MOST_TABLES)] for _ in range(WALKS)]), axis=2)
    # of the draws those stay that bring the fewest windows of other items together
    chance = np.array([[_collisions(w[draw]) for draw in draws] for w, draws in zip(walked, sampled, strict=True)])
    kept = np.argsort(chance, axis=1, kind="stable")[:, :MOST_TABLES]
    sampled, chance = np.take_along_axis(sampled, kept[:, :, None], axis=1), np.take_along_axis(chance, kept, axis=1)
    kind = Kind(stride, moves, sampled, np.array(item, np.int32), np.array(offset, np.int32), walked, *piece_masks(windows), chance)
    owners, counts = np.unique(kind.item, return_counts=True)
    aligned = np.minimum(counts // stride, 6)
    recalls: dict[int, np.ndarray] = {}
    for group in np.unique(aligned):
        members = owners[aligned == group]
        picked = rng.choice(members, TRIALS)
        # each trial is a document of a word or more, the edited item and a word more
        trials = [b"lorem " * int(rng.integers(1, 5)) + t + b" ipsum" for t in _perturbed([items[i] for i in picked], rng, max_edits)]
        begins = np.cumsum([0, *(len(t) + 1 for t in trials)])
        hit = np.zeros((WALKS, MOST_TABLES, len(trials)), bool)
        for start, own, w, t in kind.candidates(np.frombuffer(b"\0".join(trials), np.uint8), [int(b) for b in begins[:-1]]):
            at = np.searchsorted(begins, start + len(items[own]) // 2, side="right") - 1
            if 0 <= at < len(trials) and picked[at] == own:
                hit[w, t, at] = True
        found = np.logical_or.accumulate(np.logical_or.accumulate(hit, axis=0), axis=1).mean(axis=2)
        recalls |= dict.fromkeys(members.tolist(), found)
    return kind, recalls


def chosen_kinds(built: list[tuple[Kind, dict[int, np.ndarray]]], n_items: int) -> list[Kind]:
    """The kinds, walks and tables that reach the target for as many items as any do, at the least cost for documents.

    Each kind takes the items that its walks and tables suffice for, the longest windows first.
    """
    options = [None, *((w, t) for w in range(WALKS) for t in range(MOST_TABLES))]
    enough = [[np.array([o is not None and i in r and r[i][o] >= TARGET_RECALL for i in range(n_items)]) for o in options] for _, r in built]

    def best(n: int, left: np.ndarray) -> tuple[tuple[int, float], list[int]]:
        """(items left in the end, cost) and the options of kinds n and later, for the items still left."""
        if n == len(built):
            return (int(left.sum()), 0.0), []
        kind, seen, found = built[n][0], {}, []
        for o, option in enumerate(options):
            rest = left & ~enough[n][o]
            if option is not None and rest.sum() == left.sum():
                continue
            cost = 0.0 if option is None else cost_of(kind, *option)
            if cost < seen.get(rest.tobytes(), np.inf):
                seen[rest.tobytes()] = cost
                found.append((o, cost, rest))
        each = [((out[0], out[1] + cost), [o, *picks]) for o, cost, rest in found if cost == seen[rest.tobytes()] for out, picks in [best(n + 1, rest)]]
        return min(each)

    def cost_of(kind: Kind, w: int, t: int) -> float:
        steps = (w + 1) * (STEP_COST * kind.moves.shape[1] + TABLE_COST * (t + 1))
        return (steps + PAIR_COST * kind.chance[: w + 1, : t + 1].sum()) / kind.stride

    left, kinds = np.ones(n_items, bool), []
    for n, o in enumerate(best(0, left)[1]):
        taken = left & enough[n][o]
        left = left & ~taken
        if taken.any():
            kinds.append(built[n][0].cut(options[o][0] + 1, options[o][1] + 1, taken[built[n][0].item]))
    return kinds


class Finder:
    """Finds benchmark items in texts; small enough to broadcast for some megabytes of items."""

    def __init__(self, items: list[tuple[int, str | None]], max_edits: float = MAX_EDITS, seed: int = 42) -> None:
        kept = [(i, b) for i, t in items if (b := normal(t))]
        self.ids, self.items, self.max_edits = [i for i, _ in kept], [b for _, b in kept], max_edits
        built = []
        for least, stride, steps in KINDS:
            # an item needs long enough windows at all the words between two document windows, and one more
            starts = [word_starts(np.frombuffer(b, np.uint8)) for b in self.items]
            fits = [i for i, b in enumerate(self.items) if len(starts[i]) > stride and len(b) - starts[i][stride] >= least]
            if fits:
                built.append(build_kind(self.items, fits, least, stride, steps, seed, max_edits))
        self.kinds = chosen_kinds(built, len(self.items))
        rest = sorted(set(range(len(self.items))).difference(*(k.item.tolist() for k in self.kinds)))
        self.exact = rest
        self.pieces: dict[str, list[tuple[int, int]]] = {}
        for i in rest:
            text, n = self.items[i].decode("latin-1"), int(max_edits * len(self.items[i])) + 1
            cuts = [len(text) * j // n for j in range(n + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                self.pieces.setdefault(text[a:b], []).append((i, a))
        self.automaton = None

    def _piece_hits(self, joined: bytes) -> Iterator[tuple[int, int]]:
        """(place of the item's start, item) wherever a piece of an item without windows stands."""
        if not self.pieces:
            return
        if self.automaton is None:
            from ahocorasick import Automaton

            self.automaton = Automaton()
            for piece, own in self.pieces.items():
                self.automaton.add_word(piece, (len(piece), own))
            self.automaton.make_automaton()
        for end, (size, own) in self.automaton.iter(joined.decode("latin-1")):
            for i, offset in own:
                yield end + 1 - size - offset, i

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(text's index, item_id, edit distance, item's length) for each text and item in it."""
        docs = [normal(t) for t in texts]
        begins = np.cumsum([0, *(len(d) + 1 for d in docs)])
        joined = b"\0".join(docs)
        text = np.frombuffer(joined, np.uint8)
        best: dict[tuple[int, int], int] = {}
        seen = set()
        borders = word_borders(text) if self.exact else None
        for start, i in self._piece_hits(joined):
            if (start, i) in seen:
                continue
            seen.add((start, i))
            item, most = self.items[i], int(self.max_edits * len(self.items[i]))
            d = min(int(np.searchsorted(begins, max(0, start + min(len(item) // 2, most)), side="right")) - 1, len(docs) - 1)
            for d_ in {d, max(d - 1, 0), min(d + 1, len(docs) - 1)}:
                a, b = int(begins[d_]), int(begins[d_]) + len(docs[d_])
                low, high = max(a, start - most), min(b, start + most)
                if low > high or best.get((d_, i), most + 1) == 0:
                    continue
                # the passage begins within the edits of where the piece says, and ends in the same text
                if (e := edits_between_borders(item, joined[:b], range(low, min(high + 1, b)), borders, most)) is not None:
                    best[d_, i] = min(e, best.get((d_, i), e))
        for kind in self.kinds:
            for start, i, *_ in kind.candidates(text):
                if (start >> 4, i) in seen:
                    continue
                seen.add((start >> 4, i))
                item = self.items[i]
                most = int(self.max_edits * len(item))
                slack = most + 16
                doc = int(np.searchsorted(begins, max(0, start + min(len(item) // 2, slack)), side="right")) - 1
                doc = min(max(doc, 0), len(docs) - 1)
                for d in {doc, max(doc - 1, 0), min(doc + 1, len(docs) - 1)}:
                    a, b = max(begins[d], start - slack), min(begins[d] + len(docs[d]), start + len(item) + slack)
                    if b - a < len(item) - most or best.get((d, i), most + 1) == 0:
                        continue
                    if (e := edits_within(item, joined[a:b], most)) is not None:
                        best[d, i] = min(e, best.get((d, i), e))
        return [(d, self.ids[i], e, len(self.items[i])) for (d, i), e in sorted(best.items())]


def _groups(batch: pa.RecordBatch, chars: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Pieces of about so many characters, so that windows of many short texts are walked at once."""
    lengths = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths) // chars
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        yield batch.slice(int(at[0]), len(at))


def load_finders(benchmark: DataFrame, max_edits: float = MAX_EDITS, part_bytes: int = PART_BYTES) -> Iterator[Finder]:
    """Finders of the whole benchmark, each of some ``part_bytes`` of items; one for a benchmark of that size.

    Items go to parts by hash, so whatever the benchmark's size no more than a part is on the driver or in a task.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    parts = max(1, -(-int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes))
    for n in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == n)
        yield Finder(sorted(map(tuple, own.collect()), key=lambda r: (r[0] is None, r)), max_edits)


def contaminated(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, item_id, edit_distance, item_chars, similarity): each row of documents with each item it holds.

    An item is held if some passage lies within ``max_edits`` of its characters (bytes of normal form: ASCII lower
    case, single spaces). Null, empty and blank texts and items hold nothing and are held by nothing; very long texts
    are searched whole; repeated rows give rows each; of places that tie one is counted; a null doc_id or item_id is
    returned as null. Columns beside doc_id, item_id and text are not read. The LSH finds TARGET_RECALL or more of the
    items with as many edits as are allowed; of unedited ones several windows collide in every table. Items too short
    for windows are found exactly, where the passage begins and ends at word borders. The documents are read once for
    each ``part_bytes`` of benchmark.
    """
    found = None
    for one in load_finders(benchmark, max_edits, part_bytes):
        finder = send(docs.sparkSession, one)

        def run(batches: Iterator[pa.RecordBatch], finder=finder) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            own = finder()
            for batch in batches:
                for part in _groups(batch):
                    ids = part.column("doc_id").to_pylist()
                    rows = own.find(part.column("text").to_pylist())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[d] for d, *_ in rows], pa.int64()), pa.array([i for _, i, *_ in rows], pa.int64()), pa.array([e for *_, e, _ in rows], pa.int64()), pa.array([n for *_, n in rows], pa.int64()), pa.array([1 - e / n for *_, e, n in rows], pa.float64())],
                        ["doc_id", "item_id", "edit_distance", "item_chars", "similarity"],
                    )

        some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, edit_distance long, item_chars long, similarity double")
        found = some if found is None else found.unionByName(some)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents, all columns, that hold no benchmark item; null and empty texts stay. See ``contaminated``."""
    for one in load_finders(benchmark, max_edits, part_bytes):
        finder = send(docs.sparkSession, one)

        def run(batches: Iterator[pa.RecordBatch], finder=finder) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            own = finder()
            for batch in batches:
                for part in _groups(batch):
                    hit = {d for d, *_ in own.find(part.column("text").to_pylist())}
                    yield part.filter(pa.array([d not in hit for d in range(part.num_rows)]))

        docs = docs.mapInArrow(run, T.StructType(docs.schema.fields))
    return docs
