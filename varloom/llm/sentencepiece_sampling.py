"""SentencePiece encoding and decoding by Gumbel top-k without replacement (operator 7).

The pieces of a model span a lattice over the text. A piece of rank r weighs (r + OFFSET) ** -ALPHA,
which makes a distribution over the segmentations of the text. Every segmentation gets a Gumbel
perturbed log-probability, and a perturbed A* search emits those with the largest: the search's
node bound is the maximum of a set of segmentations, drawn top-down, so the first SAMPLES leaves it
reaches are a sample without replacement. inclusion is the probability of a segmentation to exceed
the next perturbed value (1 - exp(-exp(log_prob - threshold))), the weight of a Horvitz-Thompson sum.

No piece crosses from a non-space to a space or over a line feed, so the lattice is a chain of
independent units. Along an emitted segmentation the siblings of each unit are one node of the
search, whose bounds are drawn for the whole text at once. The lattices of all distinct units of a
group of texts are built and drawn from together, one piece a step.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.llm.common import release, table, values

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, OFFSET, ALPHA = 2, 2.7, 1.0
#: Characters of a group of texts (a longer text is a group), and bits of a drawn number.
GROUP, BITS = 200_000, 36

#: A literal U+2581 is kept apart from the one that stands for a space; no text holds a lone surrogate.
SPACE, LITERAL = "▁", "\udc81"
_UNITS = re.compile(rf"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
_STEP, _UNIT, _ROUND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), 0x8CB92BA72F3D8DD7
_MASK = (1 << 64) - 1
Seg = tuple[int, ...]


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: the random numbers are a function of seed, round, unit and step alone."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class Pieces:
    """A model's pieces, as a table of prefixes and as a hashed table of steps from prefix to prefix."""

    def __init__(self, model: str | bytes = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(**{"model_file" if isinstance(model, str) else "model_proto": model})
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.id_of_byte, ids, ranks = [0] * 256, [], []
        for i in range(n):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.id_of_byte[int(name[3:-1], 16)], self.bytes_of[i] = i, bytes([int(name[3:-1], 16)])
            elif not sp.is_control(i) and not sp.is_unknown(i):
                ids.append(i)
                ranks.append(max(0.0, -sp.get_score(i)))
                self.bytes_of[i] = name.replace(SPACE, " ").encode()
        total = sum((r + OFFSET) ** -ALPHA for r in ranks)
        named = {sp.id_to_piece(i): (math.log((r + OFFSET) ** -ALPHA / total), (i,)) for i, r in zip(ids, ranks, strict=True)}
        self.byte_p = math.log((max(ranks) + OFFSET) ** -ALPHA / total)
        #: Every prefix of a piece: its log-probability (0 if it is none itself) and ids.
        self.nodes = {p[:k]: named.get(p[:k], (0.0, ())) for p in named for k in range(1, len(p) + 1)}
        at = {"": 0} | {p: i for i, p in enumerate(self.nodes, 1)}
        self.piece = np.full(len(at), -1, np.int32)
        self.log_p = np.zeros(n)
        for p, (lp, (i,)) in named.items():
            self.piece[at[p]], self.log_p[i] = i, lp
        letters = {c: i for i, c in enumerate(sorted({p[-1] for p in self.nodes}), 1)}
        self.letter = np.zeros(0x110000, np.int32)
        for c, i in letters.items():
            self.letter[ord(c)] = i
        self.fan = len(letters) + 1
        self._hashed(np.array([at[p[:-1]] * self.fan + letters[p[-1]] for p in self.nodes], np.int64), np.arange(1, len(at)))

    def _hashed(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(8, int(len(keys) * 8).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full((1 << bits) + 64, -1, np.int64), np.zeros((1 << bits) + 64, np.int32)
        self.probes, todo, home = 0, np.arange(len(keys)), self._home(keys)
        while len(todo):  # each round puts one key into every free place that is asked for
            at = home[todo] + self.probes
            free = np.flatnonzero(self.keys[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.values[at[put]] = keys[todo[put]], values[todo[put]]
            todo, self.probes = np.delete(todo, put), self.probes + 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _STEP) >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The prefix that a letter makes of a prefix; 0 where it is none."""
        keys = node.astype(np.int64) * self.fan + letter
        at = self._home(keys)
        out, todo = np.zeros(len(keys), np.int32), slice(None)
        for _ in range(self.probes):
            held = self.keys[at]
            met = held == keys
            out[todo] = np.where(met, self.values[at], 0)
            left = np.flatnonzero(~met & (held >= 0))
            if not len(left):
                break
            todo = left if isinstance(todo, slice) else todo[left]
            at, keys = at[left] + 1, keys[left]
        return out

    def raw(self, letter: str) -> Seg:
        """The byte pieces of a character that is no piece."""
        return tuple(self.id_of_byte[b] for b in (SPACE if letter == LITERAL else letter).encode())

    def lattice(self, unit: str) -> tuple[list, list[float]]:
        """Arcs (log-probability, end, ids) from each place of one unit, and the log-mass from there to the end."""
        n, nodes = len(unit), self.nodes
        arcs, mass = [None] * n, [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            here = []
            for j in range(i + 1, n + 1):
                if (node := nodes.get(unit[i:j])) is None:
                    break
                if node[1]:
                    here.append((node[0], j, node[1]))
            if not here or here[0][1] != i + 1:
                ids = self.raw(unit[i])
                here.append((self.byte_p * len(ids), i + 1, ids))
            values = [a[0] + mass[a[1]] for a in here]
            high = max(values)
            arcs[i], mass[i] = here, high + math.log(sum([math.exp(v - high) for v in values]))
        return arcs, mass

    def other(self, unit: str, taken: list[Seg], draw: Callable[[], float]) -> tuple[Seg, float, float]:
        """A segmentation that is none of those taken, its log-probability, and the probability of those taken.

        Top-down: at a place that taken ones run through, their mass is left out of each arc's.
        """
        arcs, mass = self.lattice(unit)
        left = [self._path(arcs, t) for t in taken]
        spent = sum(math.exp(p[0][0][0] + p[0][1] - mass[0]) for p in left)
        seg, i, q = [], 0, 0.0
        while i < len(unit):
            free = [math.exp(a[0] + mass[a[1]] - mass[i]) for a in arcs[i]]
            for path in left:
                step, rest = path[0]
                free[arcs[i].index(step)] -= math.exp(step[0] + rest - mass[i])
            total = sum(f for f in free if f > 0.0)
            if total <= 0.0:  # rounding has used up the rest
                return taken[-1], -math.inf, spent
            u, k = draw() * total, -1
            while u >= 0.0 and k < len(free) - 1:
                k += 1
                u -= max(0.0, free[k])
            while free[k] <= 0.0:
                k -= 1
            a = arcs[i][k]
            left = [p[1:] for p in left if p[0][0] is a and len(p) > 1]
            seg += a[2]
            q += a[0]
            i = a[1]
        return tuple(seg), q - mass[0], spent

    @staticmethod
    def _path(arcs: list, seg: Seg) -> list:
        """The arcs of a segmentation, each with the log-probability of what follows it."""
        path, i, k = [], 0, 0
        while i < len(arcs):
            a = next(a for a in arcs[i] if a[2] == seg[k : k + len(a[2])])
            path.append(a)
            i, k = a[1], k + len(a[2])
        out, rest = [], 0.0
        for a in reversed(path):
            out.append((a, rest))
            rest += a[0]
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode()[1:] if len(ids) else ""

    def sample(self, text: str, seed: int, k: int = SAMPLES) -> list[tuple[np.ndarray, float, float]]:
        """(ids, log_prob, inclusion) of k distinct segmentations, or of all where there are fewer."""
        return self.sample_texts([text], [seed], k)[0]

    def sample_texts(self, texts: list[str], seeds: list[int], k: int = SAMPLES) -> list[list[tuple[np.ndarray, float, float]]]:
        """sample() of each text; what a text gets depends on itself and its seed alone."""
        codes: dict[str, int] = {}
        number, at, ends = codes.setdefault, [], [0]
        for t in texts:
            if t:
                at += [number(u, len(codes)) for u in _UNITS.findall(f"{SPACE}{t.replace(SPACE, LITERAL).replace(' ', SPACE)}")]
            ends.append(len(at))
        if not at:
            return [[] for _ in texts]
        return _Search(self, list(codes), np.array(at, np.int64), np.array(ends), seeds).run(k)


class Lattices:
    """The lattices of many units. A node is a place in a unit; nodes are numbered by their distance
    from the unit's end, ends first. Arcs are sorted by node, longest first, and each node's share of
    2 ** BITS is dealt out to its arcs in whole numbers, so that a draw is exact however it is grouped."""

    def __init__(self, pieces: Pieces, units: list[str]):
        n = np.fromiter(map(len, units), np.int64, len(units))
        letters = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends, places, self.units = np.cumsum(n), len(letters), len(units)
        unit = np.repeat(np.arange(len(units)), n)
        far = ends[unit] - np.arange(places)
        order = np.argsort(far.astype(np.uint16) if len(n) and n.max() < 1 << 16 else far, kind="stable")
        node = np.empty(places, np.int64)
        node[order] = np.arange(places) + self.units
        self.root = node[ends - n]

        known, at, here, found = pieces.letter[letters], np.arange(places), np.zeros(places, np.int32), []
        size, alone = 0, np.ones(places, bool)
        while len(at):
            here = pieces.step(here, known[at + size])
            size += 1
            live = np.flatnonzero(here)
            at, here = at[live], here[live]
            piece = pieces.piece[here]
            whole = np.flatnonzero(piece >= 0)
            found.append((at[whole], np.full(len(whole), size), piece[whole]))
            if size == 1:
                alone[at[whole]] = False
            on = np.flatnonzero(far[at] > size)
            at, here = at[on], here[on]
        raw = np.flatnonzero(alone)
        odd, which = np.unique(letters[raw], return_inverse=True)
        self.first, spelled = len(pieces.log_p), [pieces.raw(chr(c)) for c in odd]
        self.spelled = np.array([s + (0,) * (4 - len(s)) for s in spelled], np.int32).reshape(-1, 4)
        self.width = np.array([len(s) for s in spelled], np.int64)
        found.append((raw, np.ones(len(raw), np.int64), which + self.first))
        at, size, self.piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort((node[at] << 32) - size)
        at, size, self.piece = at[order], size[order], self.piece[order]
        self.log_p = np.concatenate([pieces.log_p, pieces.byte_p * self.width])[self.piece]
        start = node[at]
        self.end = np.where(far[at] == size, unit[at], node[np.minimum(at + size, places - 1)])

        fan = np.bincount(start, minlength=places + self.units)
        self.at = np.cumsum(fan) - fan
        self.mass = np.zeros(places + self.units)
        level = np.cumsum(np.bincount(far, minlength=1)) + self.units if places else np.zeros(1, np.int64)
        for lo, hi in zip(level[:-1].tolist(), level[1:].tolist(), strict=True):
            if lo == hi:
                continue
            a, b = self.at[lo], self.at[hi - 1] + fan[hi - 1]
            v, cuts = self.log_p[a:b] + self.mass[self.end[a:b]], self.at[lo:hi] - a
            high = np.maximum.reduceat(v, cuts)
            self.mass[lo:hi] = high + np.log(np.add.reduceat(np.exp(v - np.repeat(high, fan[lo:hi])), cuts))
        share = np.rint(np.exp(self.log_p + self.mass[self.end] - self.mass[start]) * 2.0**BITS).astype(np.int64)
        dealt = np.cumsum(share)
        self.upto = np.minimum(dealt - (dealt - share)[self.at[start]], 1 << BITS)
        last = (self.at + fan - 1)[self.units :]
        self.upto[last] = 1 << BITS

    def draw(self, unit: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A segmentation of each unit: log-probabilities, numbers of ids, and all ids in order."""
        node, who, rest = self.root[unit], np.arange(len(unit)), state
        log_q, width, steps = -self.mass[node], np.zeros(len(unit), np.int64), []
        while len(who):
            rest = rest + _STEP
            u = (_mixed(rest) >> np.uint64(64 - BITS)).astype(np.int64)
            arc = self.at[node]
            late = np.flatnonzero(self.upto[arc] <= u)
            while len(late):
                arc[late] += 1
                late = late[self.upto[arc[late]] <= u[late]]
            piece = self.piece[arc]
            wide = np.ones(len(arc), np.int64)
            spelled = np.flatnonzero(piece >= self.first)
            if len(spelled):
                wide[spelled] = self.width[piece[spelled] - self.first]
            log_q[who] += self.log_p[arc]
            steps.append((who, piece, wide, spelled))
            width[who] += wide
            node = self.end[arc]
            on = np.flatnonzero(node >= self.units)
            node, who, rest = node[on], who[on], rest[on]
        at = np.cumsum(width) - width
        ids = np.empty(int(width.sum()), np.int32)
        for who, piece, wide, spelled in steps:
            to = at[who]
            ids[to] = piece
            if len(spelled):
                rows = self.spelled[piece[spelled] - self.first]
                for j in range(4):
                    more = wide[spelled] > j
                    ids[to[spelled[more]] + j] = rows[more, j]
            at[who] = to + wide
        return log_q, width, ids


class _Search:
    """The perturbed A* search of a group of texts, side by side. A path is a list of arrays over all units."""

    def __init__(self, pieces: Pieces, units: list[str], at: np.ndarray, ends: np.ndarray, seeds: list[int]):
        self.pieces, self.units, self.at, self.ends = pieces, units, at, ends.tolist()
        self.lattices = Lattices(pieces, units)
        n = np.diff(ends)
        own = np.arange(len(at), dtype=np.uint64) - np.repeat(ends[:-1], n).astype(np.uint64)
        self.seeds = [s & _MASK for s in seeds]
        self.state = np.repeat(np.array(self.seeds, np.uint64), n) + own * _UNIT
        self.live = np.flatnonzero(n).tolist()

    def draws(self, doc: int, turn: int) -> Callable[[], float]:
        x = (self.seeds[doc] ^ (turn * _ROUND + 1) * 0xD6E8FEB86659FD93) & _MASK

        def draw() -> float:
            nonlocal x
            x = (x + 0x9E3779B97F4A7C15) & _MASK
            z = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
            z = (z ^ (z >> 27)) * 0x94D049BB133111EB & _MASK
            return (((z ^ (z >> 31)) >> 12) + 0.5) * 2.0**-52

        return draw

    def grow(self, turn: int, fresh: np.ndarray, path: dict, bound: np.ndarray, start: dict) -> None:
        """Draws the units from fresh on, and the bounds of the siblings of every unit of the path."""
        state = _mixed(self.state + np.uint64(turn * _ROUND & _MASK))
        if len(fresh):
            path["log_q"][fresh], path["width"][fresh], ids = self.lattices.draw(self.at[fresh], state[fresh])
            path["fresh"], path["ids_at"] = ids, np.cumsum(path["width"][fresh]) - path["width"][fresh]
        before = np.empty(len(self.at))
        for d in path["docs"]:
            lo, hi = self.ends[d], self.ends[d + 1]
            sums = np.cumsum(path["log_q"][lo:hi])
            before[lo], before[lo + 1 : hi], path["log_prob"][d] = 0.0, sums[:-1], sums[-1]
        rest = -np.expm1(path["log_q"])
        for i, spent in start.items():
            rest[i] -= spent
        rest[rest < 1e-12] = 0.0
        with np.errstate(divide="ignore", over="ignore"):
            mass = before + np.log(rest)
            path["open"] = mass - np.log(np.exp(mass - bound) - np.log(_uniform(_mixed(state ^ _UNIT))))
        path["open"][rest == 0.0] = -np.inf

    def run(self, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
        n, total = len(self.ends) - 1, len(self.at)
        gumbel = np.zeros(n)
        for d in self.live:
            gumbel[d] = -math.log(-math.log(self.draws(d, 0)()))
        sizes = np.diff(self.ends)
        path = {"log_q": np.empty(total), "width": np.empty(total, np.int64), "log_prob": np.zeros(n), "docs": self.live}
        self.grow(0, np.arange(total), path, np.repeat(gumbel, sizes), {})
        at = np.append(path["ids_at"], len(path["fresh"]))
        #: Of each text: its emitted paths, as (path, ids, start, taken).
        out = [[] for _ in range(n)]
        for d in self.live:
            out[d].append((path, path["fresh"][at[self.ends[d]] : at[self.ends[d + 1]]], self.ends[d], []))
        live, turn = self.live, 1
        while turn < k and live:
            path = {"log_q": np.zeros(total), "width": np.zeros(total, np.int64), "log_prob": np.zeros(n), "docs": []}
            bound, start, new, fresh = np.zeros(total), {}, {}, np.zeros(total, bool)
            for d in live:
                lo, hi = self.ends[d], self.ends[d + 1]
                i, (base, ids, begun, taken) = max(((lo + int(p[0]["open"][lo:hi].argmax()), p) for p in out[d]), key=lambda x: x[1][0]["open"][x[0]])
                g = base["open"][i]
                if g == -np.inf:
                    continue
                base["open"][i] = -np.inf
                a = int(base["width"][lo:i].sum())
                b = a + int(base["width"][i])
                taken = [*(taken if i == begun else []), tuple(ids[a:b].tolist())]
                seg, q, spent = self.pieces.other(self.units[self.at[i]], taken, self.draws(d, turn))
                path["log_q"][lo:i], path["log_q"][i] = base["log_q"][lo:i], q
                path["width"][lo:i], path["width"][i] = base["width"][lo:i], len(seg)
                path["docs"].append(d)
                bound[lo:hi], start[i], fresh[i + 1 : hi] = g, spent, True
                new[d] = (i, ids[:a], np.array(seg, np.int32), taken)
            todo = np.flatnonzero(fresh)
            self.grow(turn, todo, path, bound, start)
            cuts = np.append(path["ids_at"], len(path["fresh"])) if len(todo) else np.zeros(1, np.int64)
            for d, (i, head, seg, taken) in new.items():
                lo, hi = self.ends[d], self.ends[d + 1]
                a, b = np.searchsorted(todo, (i + 1, hi))
                tail = path["fresh"][cuts[a] : cuts[b]] if b > a else seg[:0]
                path["open"][lo:i] = -np.inf
                out[d].append((path, np.concatenate([head, seg, tail]), i, taken))
            live, turn = list(new), turn + 1
        return [self.scored(d, paths) for d, paths in enumerate(out)]

    def scored(self, d: int, paths: list) -> list[tuple[np.ndarray, float, float]]:
        lo, hi = self.ends[d], self.ends[d + 1]
        threshold = max((float(p[0]["open"][lo:hi].max()) for p in paths), default=-math.inf)
        scores = [float(p[0]["log_prob"][d]) for p in paths]
        return [(p[1], s, 1.0 if threshold == -math.inf else -math.expm1(-math.exp(min(700.0, s - threshold)))) for p, s in zip(paths, scores, strict=True)]


SCHEMA = "doc_id long, samples array<struct<ids:array<int>,log_prob:double,inclusion:double>>, round_trip boolean"
_SAMPLE = pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("inclusion", pa.float64())])


def encode_samples(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, k: int = SAMPLES) -> DataFrame:
    """doc_id, samples (ids, log_prob, inclusion), round_trip (all samples decode to the text).

    Null and empty texts have no samples. A text with fewer than k segmentations gives them all,
    with inclusion 1 (a set of segmentations with a share under 1e-12 of its node, below what doubles
    can tell from none, counts as empty). The seed is the row key (a null key is a key), so a repeated
    row has the same samples and a lost task draws the same again. Whole texts are read, of any length. Other
    columns are ignored; no rows give no rows. The model is read by the driver and goes along with the tasks.
    """
    proto = Path(model).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(proto)
        names = ["doc_id", "samples", "round_trip"]

        def batch(ids: list, texts: list) -> pa.RecordBatch:
            sampled = pieces.sample_texts(texts, [xxhash.xxh64_intdigest(str(i)) for i in ids], k)
            flat = [s for d in sampled for s in d]
            sizes = np.cumsum([0, *(len(s[0]) for s in flat)]).astype(np.int32)
            values = np.concatenate([np.empty(0, np.int32), *(s[0] for s in flat)])
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(values))
            structs = pa.StructArray.from_arrays([lists, pa.array([s[1] for s in flat], pa.float64()), pa.array([s[2] for s in flat], pa.float64())], fields=list(_SAMPLE))
            outer = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sampled)]).astype(np.int32)), structs)
            good = [all(pieces.decode(s[0].tolist()) == t for s in d) for t, d in zip(texts, sampled, strict=True)]
            return pa.record_batch([pa.array(ids, pa.int64()), outer, pa.array(good, pa.bool_())], names=names)

        for b in batches:
            ids, texts, n = [], [], 0
            for i, t in zip(values(b.column(0)), values(b.column(1)), strict=True):
                ids.append(i)
                texts.append(t or "")
                n += len(texts[-1])
                if n > GROUP:
                    yield batch(ids, texts)
                    ids, texts, n = [], [], 0
            yield batch(ids, texts)
            del b
            release()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def decode_ids(rows: DataFrame, ids: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """Adds the text of a column of ids, in place of any column of that name; null ids give null."""
    kept, proto = rows.drop(out), Path(model).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(proto)
        for b in batches:
            texts = [None if x is None else pieces.decode(x) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return kept.mapInArrow(run, T.StructType([*kept.schema, T.StructField(out, T.StringType())]))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every row: the number, sizes and digests of its sampled segmentations, their scores, and
    whether they decode to the text; nulls, repeats and empty tables as in encode_samples()."""
    rows = encode_samples(table(spark, sf_dir, "documents").select("doc_id", "text"))
    each = lambda f: F.transform("samples", f)
    return rows.select("doc_id", F.size("samples").cast("long").alias("n_samples"), each(lambda s: F.size(s["ids"]).cast("long")).alias("n_pieces"), each(lambda s: F.xxhash64(s["ids"])).alias("ids_hash"), each(lambda s: s["log_prob"]).alias("log_prob"), each(lambda s: s["inclusion"]).alias("inclusion"), "round_trip")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: doc_id and the sampled segmentations of each row. Null and empty texts have none;
    repeated rows stay and have the same; an empty table gives no rows."""
    return encode_samples(docs).select("doc_id", "samples")


SQL: dict[str, str] = {}
QUERIES = {"op7_sentencepiece": op7_sentencepiece}
