"""SentencePiece BPE: exact encoding by backtracking, and decoding.

The merge rule (join the adjacent pair whose string has the best score, leftmost
on ties) has one result for a string. That result is the only sequence of
pieces in which every two neighbours are compatible: merging the characters of
both again gives just those two. So the encoder walks from left to right, takes
the longest piece that an Aho-Corasick automaton finds at the position, checks it
against the piece before, tries shorter pieces if they don't fit, and
steps back otherwise; a bitfield holds the positions known to fail.

A text is encoded in segments that start where a space follows something
else. No piece of the vocabulary crosses such a place (checked when the model is
read; otherwise a whole text is one segment), so segments are independent. All
different segments of a slice of text walk in step, one numpy operation for all
of them at a time: first the automaton, which reads them from their ends (it holds
the pieces backwards, so its state at a place tells the longest piece that begins
there), then the backtracking. Segments of more than ``LONGEST`` characters and
those that need many steps are walked one by one. Characters outside the
vocabulary become their UTF-8 bytes' pieces, or the unknown piece in models
without those.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import SLICE_BYTES, mapped, mixed, powers, slices, text_bytes

SPACE = "▁"
PAIRS = 400_000  # compatibility results kept; half of them go when there are more
LONGEST = 64  # characters looked at for the longest match; no longer pieces are accepted
STEPS = 48  # steps that segments take together; what needs more goes on alone
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


class Table:
    """A map from numbers of 0 or more to small numbers of 0 or more, asked and filled with whole arrays: open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(10, (2 * len(keys)).bit_length())
        self.keys, self.values, self.n = np.full(1 << self.bits, -1), np.full(1 << self.bits, -1, np.int32), 0
        self.put(keys, values)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 for keys that are not there."""
        at = self.slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], -1)
        other = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(other):
            at[other] = (at[other] + 1) & (len(self.keys) - 1)
            seen = self.keys[at[other]]
            same = seen == keys[other]
            out[other[same]] = self.values[at[other[same]]]
            other = other[~same & (seen >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that differ and are not there yet."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            used = self.keys >= 0
            return self.__init__(np.r_[self.keys[used], keys], np.r_[self.values[used], values])
        self.n += len(keys)
        at, left = self.slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]
            mine = free[self.keys[at[free]] == keys[free]]
            self.values[at[mine]] = values[mine]
            left = np.setdiff1d(left, mine, assume_unique=True)
            at[left] = (at[left] + 1) & (len(self.keys) - 1)


class Bpe:
    """A BPE model read from a ``.model`` file's bytes. Only identity normalisation is supported."""

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb2

        proto = pb2.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only BPE models with identity normalisation are supported")
        kinds = {p.type for p in proto.pieces}
        if kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.piece = [p.piece for p in proto.pieces]
        self.kind = [p.type for p in proto.pieces]
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.bytes = [0] * 256
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
        self.fallback = proto.trainer_spec.byte_fallback
        ids = {p.type: i for i, p in enumerate(proto.pieces)}
        self.unk = ids[UNKNOWN]
        self.bos, self.eos = (next(i for i, p in enumerate(proto.pieces) if p.piece == s) for s in (proto.trainer_spec.bos_piece or "<s>", proto.trainer_spec.eos_piece or "</s>"))
        self.unk_text = proto.trainer_spec.unk_surface or " ⁇ "
        alone = {p for p in self.id if len(p) == 1}
        if any(c not in alone for p in self.id for c in p):
            raise ValueError("a piece holds a character that is no piece itself")
        # A piece that its own characters don't merge to can't come up.
        reach = [p for p in self.id if len(p) == 1 or self.merged(p) == [p]]
        if len(reach) < len(self.id):
            raise ValueError("a piece can't be reached by merging")
        if max(map(len, reach)) > LONGEST:
            raise ValueError("a piece is too long")
        self.auto = ahocorasick.Automaton()
        for p in reach:
            self.auto.add_word(p, len(p))
        self.auto.make_automaton()
        self.crossing = any(SPACE in p.lstrip(SPACE) for p in self.id)
        self.segment = re.compile(r"(?s).+" if self.crossing else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.pair: dict[tuple[str, str], bool] = {}
        self.chars = frozenset(alone)
        self.utf8 = [(p.replace(SPACE, " ") if k == NORMAL else "" if k in (CONTROL, BYTE) else self.unk_text).encode() for p, k in zip(self.piece, self.kind, strict=True)]
        for value, i in enumerate(self.bytes):
            if i:
                self.utf8[i] = bytes([value])
        self.out_size = np.array([len(t) for t in self.utf8])
        self.out_at = np.r_[0, np.cumsum(self.out_size)]
        self.out = np.frombuffer(b"".join(self.utf8), np.uint8)
        self.fit = Table(np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.automaton()

    def automaton(self) -> None:
        """Aho-Corasick over the pieces read backwards: states' links (``goto``, ``fail``) and the longest piece each ends with.

        ``shorter`` leads from a piece to the longest piece that it begins with.
        """
        self.char = np.full(0x110000, -1, np.int32)
        self.char[[ord(c) for c in self.chars]] = np.arange(len(self.chars))
        links: list[dict[int, int]] = [{}]
        ends = [-1]
        for p, i in self.id.items():
            at = 0
            for c in self.char[[ord(c) for c in reversed(p)]].tolist():
                if c not in links[at]:
                    links[at][c] = len(links)
                    links.append({})
                    ends.append(-1)
                at = links[at][c]
            ends[at] = i
        fail, wave = [0] * len(links), list(links[0].values())
        while wave:
            for s in wave:
                for c, t in links[s].items():
                    f = fail[s]
                    while f and c not in links[f]:
                        f = fail[f]
                    fail[t] = links[f].get(c, 0)
                    if ends[t] < 0:
                        ends[t] = ends[fail[t]]
            wave = [t for s in wave for t in links[s].values()]
        flat = [(s * len(self.chars) + c, t) for s, more in enumerate(links) for c, t in more.items()]
        self.goto = Table(*(np.array(x, np.int64) for x in zip(*flat, strict=True)))
        self.fail, self.ends = np.array(fail), np.array(ends)
        self.size = np.array([len(p) for p in self.piece])
        self.shorter = np.full(len(self.piece), -1)
        for p, i in self.id.items():
            self.shorter[i] = next((self.id[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id), -1)

    def merged(self, text: str) -> list[str]:
        """The merge rule itself, for short strings: what two neighbouring pieces become."""
        score, parts = self.score, list(text)
        found = [score.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best = max((s for s in found if s is not None), default=None)
            if best is None:
                return parts
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = score.get(parts[at - 1] + parts[at])
            if at < len(found):
                found[at] = score.get(parts[at] + parts[at + 1])

    def fits(self, a: str, b: str) -> bool:
        """Whether two pieces may stand side by side: re-merging their characters gives them back."""
        key = (a, b)
        got = self.pair.get(key)
        if got is None:
            got = self.merged(a + b) == [a, b]
            if len(self.pair) >= PAIRS // 8:
                self.pair.clear()
            self.pair[key] = got
        return got

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a run of vocabulary characters."""
        if text in self.id:
            return [text]
        n, ids, reach = len(text), self.id, self.auto.longest_prefix
        failed = bytearray(n + 1)
        path: list[str] = []
        left: list[int] = []  # the longest size still to be tried at each position of the path
        pos, before, pair = 0, "", self.pair
        size = reach(text[:LONGEST])
        while True:
            while size:
                end = pos + size
                piece = text[pos:end]
                if piece in ids and not failed[end]:
                    if not before:
                        break
                    ok = pair.get((before, piece))
                    if ok is None:
                        ok = self.fits(before, piece)
                    if ok:
                        break
                size -= 1
            if size:
                path.append(piece)
                if end == n:
                    return path
                left.append(size)
                pos, before = end, piece
                size = reach(text[pos : pos + LONGEST])
            else:
                # Nothing follows here: the position has failed and the piece before gives way to a shorter one.
                failed[pos] = 1
                size = left.pop() - 1
                pos -= len(path.pop())
                before = path[-1] if path else ""

    def encode_segment(self, text: str) -> list[int]:
        """Ids of one segment; characters outside the vocabulary split it."""
        ids = self.id
        if self.chars.issuperset(text):
            return [ids[p] for p in self.backtrack(text)]
        out: list[int] = []
        lost = False
        for known, run in groupby(text, self.chars.__contains__):
            part = "".join(run)
            if known:
                out += [ids[p] for p in self.backtrack(part)]
            elif self.fallback:
                out += [self.bytes[b] for b in part.encode()]
            elif not lost:
                out.append(self.unk)
            lost = not known
        return out

    def fitting(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``fits`` of many pairs of piece ids; each new pair is merged once."""
        keys = a * len(self.piece) + b
        got = self.fit.get(keys)
        new = np.unique(keys[got < 0])
        if len(new):
            if self.fit.n + len(new) > PAIRS:
                keep = np.flatnonzero(self.fit.keys >= 0)[::2]
                self.fit = Table(self.fit.keys[keep], self.fit.values[keep])
            pieces = [(self.piece[k // len(self.piece)], self.piece[k % len(self.piece)]) for k in new.tolist()]
            value = np.array([self.merged(x + y) == [x, y] for x, y in pieces], np.int32)
            self.fit.put(new, value)
            got[got < 0] = value[np.searchsorted(new, keys[got < 0])]
        return got == 1

    def longest(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """At each place of the given segments of character numbers the longest piece that begins there."""
        out = np.full(len(codes), -1)
        order = np.argsort(-size, kind="stable")
        last, fewer = (start + size)[order] - 1, -size[order]
        state = np.zeros(len(order), np.int64)
        for k in range(int(size.max(initial=0))):
            n = int(np.searchsorted(fewer, -k))  # segments with more than k characters
            state, c = state[:n], codes[last[:n] - k]
            to = self.goto.get(state * len(self.chars) + c)
            back = np.flatnonzero(to < 0)
            while len(back):
                state[back] = self.fail[state[back]]
                to[back] = self.goto.get(state[back] * len(self.chars) + c[back])
                back = back[to[back] < 0]
            state = to.astype(np.int64)
            out[last[:n] - k] = self.ends[state]
        return out

    def walk(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backtracking of all segments in step: how many pieces each has (0: not done) and a table of them, a row a segment.

        Between two segments in ``codes`` lies a place that belongs to neither.
        """
        longest = self.longest(codes, start, size)
        end, pos = start + size, start.copy()
        failed = np.zeros(len(codes) + 1, bool)
        before, depth = np.full(len(start), -1), np.zeros(len(start), np.int64)
        path = np.zeros((len(start), int(size.max(initial=0)) + 1), np.int32)
        piece = longest[start]
        active = np.arange(len(start))
        for _ in range(STEPS):
            if not len(active):
                break
            left = piece[active] >= 0
            mine, stuck = active[left], active[~left]
            p = piece[mine]
            to = pos[mine] + self.size[p]
            ok = ~failed[to]
            ask = np.flatnonzero(ok & (before[mine] >= 0))
            ok[ask] = self.fitting(before[mine[ask]], p[ask])
            on, no = mine[ok], mine[~ok]
            path[on, depth[on]] = before[on] = p[ok]
            depth[on] += 1
            pos[on] = to[ok]
            on = on[pos[on] < end[on]]
            piece[on] = longest[pos[on]]
            piece[no] = self.shorter[p[~ok]]
            # Nothing follows here: the position has failed and the piece before gives way to a shorter one.
            failed[pos[stuck]] = True
            depth[stuck] -= 1
            last = path[stuck, depth[stuck]]
            pos[stuck] -= self.size[last]
            piece[stuck] = self.shorter[last]
            before[stuck] = np.where(depth[stuck] > 0, path[stuck, depth[stuck] - 1], -1)
            active = active[pos[active] < end[active]]
        depth[active] = 0
        return depth, path

    def encode_rows(self, raw: np.ndarray, starts: np.ndarray, prefix: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts given as UTF-8 bytes, and each text's first id plus the total; ``prefix`` puts the dummy space before them."""
        codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        row = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][starts]
        codes[codes == 0x20] = ord(SPACE)
        if prefix and self.prefix:
            full = row[:-1][np.diff(row) > 0]
            codes = np.insert(codes, full, ord(SPACE))
            row = row + np.searchsorted(full, row)
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(len(row), np.int64)
        char = self.char[codes].astype(np.int64)
        known, space = char >= 0, codes == ord(SPACE)
        first = np.zeros(len(codes), bool)
        first[1:] = (known[1:] != known[:-1]) | (False if self.crossing else space[1:] & ~space[:-1])
        first[row[:-1][np.diff(row) > 0]] = True
        start = np.flatnonzero(first)
        size = np.diff(np.r_[start, len(codes)])
        one, of = self.different(codes, start, size)
        s, n = start[one], size[one]
        short = known[s] & (n <= LONGEST)
        # The different segments side by side, a place apart.
        at = np.r_[0, np.cumsum(n[short] + 1)][:-1]
        place = np.repeat(at, n[short]) + within(n[short])
        side = np.full(int((n[short] + 1).sum()), -1)
        side[place] = char[np.repeat(s[short], n[short]) + within(n[short])]
        depth, path = self.walk(side, at, n[short])
        count = np.zeros(len(one), np.int64)
        count[short] = depth
        alone = {}
        for k in np.flatnonzero(count == 0).tolist():
            text = "".join(map(chr, codes[s[k] : s[k] + n[k]]))
            alone[k] = self.encode_segment(text)
            count[k] = len(alone[k])
        begin = np.r_[0, np.cumsum(count)]
        flat = np.zeros(begin[-1], np.int64)
        flat[np.repeat(begin[:-1][short], depth) + within(depth)] = path[np.repeat(np.arange(len(depth)), depth), within(depth)]
        for k, ids in alone.items():
            flat[begin[k] : begin[k + 1]] = ids
        many = count[of]
        ids = flat[np.repeat(begin[:-1][of], many) + within(many)]
        return ids, np.r_[0, np.cumsum(many)][np.searchsorted(start, row)]

    def different(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One segment of each different string, and for every segment which of these it equals (found by hash, then compared)."""
        up, down = powers(len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * up[: len(codes)], out=sums[1:])
        _, one, of = np.unique(mixed((sums[start + size] - sums[start]) * down[start] + size.astype(np.uint64)), return_index=True, return_inverse=True)
        if (size[one[of]] == size).all() and (codes[np.repeat(start[one[of]], size) + within(size)] == codes).all():
            return one, of
        return np.arange(len(start)), np.arange(len(start))

    def decode_rows(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of the pieces of many texts, spaces restored (the leading ones too), and each text's first byte plus the total."""
        size = self.out_size[ids]
        return self.out[np.repeat(self.out_at[ids], size) + within(size)], np.r_[0, np.cumsum(size)][starts]

    def encode(self, text: str, bos: bool = True, eos: bool = True) -> list[int]:
        raw = np.frombuffer(text.encode(), np.uint8)
        return [self.bos] * bos + self.encode_rows(raw, np.array([0, len(raw)]))[0].tolist() + [self.eos] * eos

    def pieces_text(self, ids: list[int]) -> bytes:
        """UTF-8 of the pieces with spaces restored, byte pieces as bytes."""
        utf8 = self.utf8
        return b"".join([utf8[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """Text of any ids: control pieces vanish, the leading dummy space goes, bytes that aren't UTF-8 become U+FFFD each."""
        raw = self.pieces_text(ids)
        first = next((i for i in ids if self.kind[i] != CONTROL), None)
        if self.prefix and first is not None and self.kind[first] == NORMAL and raw[:1] == b" ":
            raw = raw[1:]
        return replaced(raw)


def within(size: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of runs of the given sizes."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def replaced(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_models: dict[bytes, Bpe] = {}


def model_of(data: bytes) -> Bpe:
    key = hashlib.sha256(data).digest()
    if key not in _models:
        _models[key] = Bpe(data)
    return _models[key]


def cut_places(raw: np.ndarray, limit: int) -> list[int]:
    """Bytes at which a long text may be cut into pieces of about ``limit`` bytes: spaces that follow something else."""
    space = raw == 0x20
    mark = np.zeros(len(raw), bool)  # a character that already is the space mark ends here
    mark[3:] = (raw[:-3] == 0xE2) & (raw[1:-2] == 0x96) & (raw[2:-1] == 0x81)
    ok = np.flatnonzero(space[1:] & ~space[:-1] & ~mark[1:]) + 1
    at = np.searchsorted(ok, np.arange(limit, len(raw), limit))
    return np.unique(ok[at[at < len(ok)]]).tolist()


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if asked for.

    A map over partitions, no shuffle; the model file (half a megabyte, read
    once on the driver) is broadcast. Null and empty texts give begin and end
    only; repeated rows and null ids give a row each; very long texts are walked
    in parts that end where a segment does; further columns aren't read.
    """
    model = docs.sparkSession.sparkContext.broadcast(open(model_path, "rb").read())
    schema = T.StructType([*SCHEMA.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model_of(model.value)
        begin, end = (np.array([i], "<u4").tobytes() for i in (bpe.bos, bpe.eos))

        def parts(raw: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
            """Bytes and starts of the rows, or one long row part by part; the last value tells the first part."""
            cuts = cut_places(raw, SLICE_BYTES) if len(starts) == 2 and len(raw) > 2 * SLICE_BYTES and not bpe.crossing else []
            if not cuts:
                yield raw, starts, True
            for a, b in zip([0, *cuts], [*cuts, len(raw)], strict=True) if cuts else ():
                yield raw[a:b], np.array([0, b - a]), a == 0

        for batch in slices(batches, 1):
            n, sums = [0] * batch.num_rows, [(hashlib.sha256(begin), hashlib.sha256()) for _ in range(batch.num_rows)]
            kept: list[list[np.ndarray]] = [[np.frombuffer(begin, "<i4")] for _ in range(batch.num_rows)]
            for raw, starts, first in parts(*text_bytes(batch.column(1))):
                ids, at = bpe.encode_rows(raw, starts, first)
                back, to = bpe.decode_rows(ids, at)
                ids = ids.astype("<u4")
                for k, (a, b, x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), to[:-1].tolist(), to[1:].tolist(), strict=True)):
                    if first and bpe.prefix and x < y and back[x] == 0x20:
                        x += 1
                    n[k] += b - a
                    sums[k][0].update(ids[a:b])
                    sums[k][1].update(back[x:y])
                    if with_ids:
                        kept[k].append(ids[a:b].view("<i4"))
            for ids_sum, _ in sums:
                ids_sum.update(end)
            cols = [batch.column(0), pa.array([k + 2 for k in n], pa.int64()), *(pa.array([s[i].hexdigest() for s in sums], pa.string()) for i in (0, 1))]
            ids = [pa.array([np.concatenate([*k, np.frombuffer(end, "<i4")]) for k in kept], pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(cols + ids, names=schema.names)

    return mapped(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, schema)
