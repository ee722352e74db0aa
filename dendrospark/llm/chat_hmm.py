"""Chat formatting: a hidden Markov model recovers who speaks in plain transcripts.

A transcript is text whose turns may or may not begin with a speaker marker
("User:", "### Assistant", "<|system|>", "Q."). Each line is an observation with
three features: the marker class it begins with, a shape (blank, bullet, quoted,
code, question, plain) and its length class. States are roles, each as the first
line of a turn or a line that goes on. Transitions and emission tables are counted by
Spark over labelled lines, smoothed, and small; Viterbi decoding finds the best
path, from which turns are cut and rendered in one canonical form.

Transcripts are decoded in parts of ``PART`` lines, wherever turns begin, so a
conversation of any length is spread over tasks, and still along the one best path of
the whole. For conversations of several parts each part first gives a table of its
best scores from every state before it to every last state; these small tables, in
order, tell the states at the edges of the parts, between which each is then decoded.
Lines by which a part goes on with a turn of a part before it are given back to that
turn, so renderings hold whole turns, and those of a conversation's parts in order
are the rendering of the whole. A conversation of up to ``PART`` lines has one.

Input rows with a null conv_id or turn are left out, and rows that repeat another
in full count once. Turn numbers only order a conversation: negative, missing and
repeated ones are fine, turns of one number follow by role, then text. Roles other
than the three are no states: their turns are not learned from and come back as one
of the three. Null text is empty, an empty table has no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import mapped, slices, written

ROLES = ("system", "user", "assistant")
STATES = [(role, first) for role in ROLES for first in (True, False)]
PART = 1024  # lines decoded at a time
BLOCK = 1024  # turn numbers whose lines are counted together
SAMPLE = 20_000
# Speaker markers of common transcript styles, by role.
MARKERS = {
    "system": ("system", "sys", "instruction", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "me", "prompt", "usuario", "nutzer", "utilisateur"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "agent", "gpt", "response", "asistente", "assistent"),
}
STYLES = ("{0}: {1}", "### {0}\n{1}", "<|{0}|>{1}", "[{0}] {1}", "**{0}**: {1}")
CLASS = {word: role for role, words in MARKERS.items() for word in words}
MARKER = re.compile(r"\s*(?:#{1,4}\s*|\*\*|\[|<\|)?([A-Za-z]{1,12})(?:\*\*\s*:|\]\s*:?|\|>|\s*:|\.(?=\s)|\s*$)[ \t]*")
MARKS = ("none", *ROLES)
SHAPES = ("blank", "bullet", "quoted", "code", "question", "plain")
LENGTHS = (40, 120, 400)


def marker(line: str) -> tuple[str, int]:
    """The marker class a line begins with and where its text begins."""
    m = MARKER.match(line)
    role = CLASS.get(m[1].lower()) if m else None
    return (role, m.end()) if role else ("none", 0)


def shape(line: str) -> str:
    s = line.strip()
    if not s:
        return "blank"
    if re.match(r"[-*•]\s|\d+[.)]\s", s):
        return "bullet"
    if s.startswith(">"):
        return "quoted"
    if s.startswith(("```", "    ")) or s.endswith(("{", ";", "}")):
        return "code"
    return "question" if s.endswith("?") else "plain"


def observed(line: str) -> tuple[int, int, int]:
    role, at = marker(line)
    rest = line[at:]
    return MARKS.index(role), SHAPES.index(shape(rest)), sum(len(rest) > x for x in LENGTHS)


class Hmm:
    """Log tables: start, transitions, emissions per feature."""

    def __init__(self, transitions: dict[tuple[int, int], float], emissions: dict[tuple[int, int, int], float], starts: dict[int, float]):
        n = len(STATES)
        self.trans = np.full((n, n), 0.1)
        for (a, b), c in transitions.items():
            self.trans[a, b] += c
        for a, b in [(a, b) for a in range(n) for b in range(n)]:
            if not STATES[b][1] and STATES[a][0] != STATES[b][0]:
                self.trans[a, b] = 1e-12  # a turn goes on with its own role
        self.start = np.array([(1e-12 if not STATES[s][1] else 1.0) + starts.get(s, 0.0) for s in range(n)])
        sizes = (len(MARKS), len(SHAPES), len(LENGTHS) + 1)
        self.emit = [np.full((n, k), 0.5) for k in sizes]
        for s, (role, first) in enumerate(STATES):  # what a marker says is known beforehand
            self.emit[0][s, MARKS.index(role) if first else 0] += 20.0
        for (s, f, v), c in emissions.items():
            self.emit[f][s, v] += c
        self.trans = np.log(self.trans / self.trans.sum(axis=1, keepdims=True))
        self.start = np.log(self.start / self.start.sum())
        self.emit = [np.log(e / e.sum(axis=1, keepdims=True)) for e in self.emit]

    def emitted(self, lines: list[tuple[int, int, int]]) -> np.ndarray:
        return sum(self.emit[f][:, [x[f] for x in lines]] for f in range(3))

    def transfer(self, lines: list[tuple[int, int, int]], begins: bool) -> np.ndarray:
        """The best score of the lines from each state before them (all alike where the transcript begins) to each last state."""
        e = self.emitted(lines)
        score = (np.repeat(self.start[None], len(STATES), axis=0) if begins else self.trans) + e[:, 0]
        for t in range(1, len(lines)):
            score = (score[:, :, None] + self.trans).max(axis=1) + e[:, t]
        return score

    def path(self, lines: list[tuple[int, int, int]], before: int | None = None, last: int | None = None) -> list[int]:
        """The best state sequence from the state before the lines (none: the transcript begins) to a last state, if given; ties go to the lower state."""
        if not lines:
            return []
        e = self.emitted(lines)
        score = (self.start if before is None else self.trans[before]) + e[:, 0]
        back = np.zeros((len(lines), len(STATES)), np.int8)
        for t in range(1, len(lines)):
            each = score[:, None] + self.trans
            back[t] = each.argmax(axis=0)
            score = each.max(axis=0) + e[:, t]
        out = [int(score.argmax()) if last is None else last]
        for t in range(len(lines) - 1, 0, -1):
            out.append(int(back[t, out[-1]]))
        return out[::-1]


def pieces(text: str, model: Hmm, before: int | None = None, last: int | None = None) -> tuple[str | None, list[tuple[str, int, str]]]:
    """The text that goes on with the turn before, if any, and (role, line, text) of the turns that begin; markers are removed."""
    lines = text.split("\n")
    role_before = None if before is None else STATES[before][0]
    head: list[str] = []
    out: list[tuple[str, int, list[str]]] = []
    for k, (line, state) in enumerate(zip(lines, model.path([observed(x) for x in lines], before, last), strict=True)):
        role, first = STATES[state]
        marked, at = marker(line)
        body = line[at:] if marked == role else line
        if first or role != (out[-1][0] if out else role_before):
            out.append((role, k, [body]))
        else:
            (out[-1][2] if out else head).append(body)
    return "\n".join(head) if head else None, [(role, k, "\n".join(body)) for role, k, body in out]


def turns(text: str, model: Hmm) -> list[tuple[str, str]]:
    """(role, text) of a whole transcript's turns, markers removed."""
    return [(role, body.strip()) for role, _, body in pieces(text, model)[1]]


def render(pairs: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in pairs)


def transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, roles, begins, lines, text): plain transcripts of labelled turns, to be parsed again.

    A conversation's style and which of its later turns lost their marker come
    from hashes of its id and the turn. A part is ``PART`` lines of the transcript;
    ``begins`` tells a turn that begins in it from the rest of one that began before.
    Lines are numbered from sums over ``BLOCK`` turn numbers and the order inside each.
    """
    c = conversations.selectExpr("cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "role", "coalesce(text, '') text").where("conv_id is not null and turn is not null").distinct()
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    name = F.initcap(F.coalesce("role", F.lit("user")))
    text = F.coalesce(*[F.when(style == k, F.concat(*[{"0": name, "1": F.col("text")}.get(p, F.lit(p)) if p in ("0", "1") else F.lit(p) for p in re.split(r"\{([01])\}", s) if p])) for k, s in enumerate(STYLES)])
    bare = (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(6)) == 0) & (F.col("turn") > 0)
    rows = c.select("conv_id", F.floor(F.col("turn") / BLOCK).alias("block"), "turn", "role", F.when(bare, F.col("text")).otherwise(text).alias("text")).withColumn("n", F.size(F.split("text", "\n")).cast("long"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("n").alias("n")).select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, ["conv_id", "block"]).withColumn("at", F.col("at") + F.col("offset"))
    cut = at.select("conv_id", "role", "text", "at", "n", F.explode_outer(F.expr(f"sequence(at div {PART}, (at + n - 1) div {PART})")).alias("part"))
    lo, hi = F.greatest("at", F.col("part") * PART), F.least(F.col("at") + F.col("n"), (F.col("part") + 1) * PART)
    some = F.array_join(F.slice(F.split("text", "\n"), (lo - F.col("at") + 1).cast("int"), (hi - lo).cast("int")), "\n")
    piece = F.struct(lo.alias("lo"), (lo == F.col("at")).alias("begins"), "role", (hi - lo).alias("n"), F.when(hi - lo == F.col("n"), F.col("text")).otherwise(some).alias("text"))
    group = cut.select("conv_id", "part", piece.alias("t")).groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return group.select("conv_id", "part", F.col("t.role").alias("roles"), F.col("t.begins").alias("begins"), F.col("t.n").alias("lines"), F.array_join("t.text", "\n").alias("text"))


def held_out():
    return F.pmod(F.xxhash64("conv_id"), F.lit(4)) == 2


def learn(parts: DataFrame, sample: int = SAMPLE) -> Hmm:
    """Tables from at most ``sample`` labelled parts, those with the smallest hashes of their id; held-out ids (hash mod 4 = 2) are not used."""
    some = parts.where(~held_out()).orderBy(F.xxhash64("conv_id", F.lit(5)), "conv_id", "part").limit(sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            seen: dict[tuple[str, int, int, int], int] = {}
            for part, text, roles, begins, lines in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if any(r not in ROLES for r in roles):
                    continue
                states = [STATES.index((r, b and k == 0)) for r, b, n in zip(roles, begins, lines, strict=True) for k in range(n)]
                keys = [*[("s", states[0], 0, 0)][part:], *[("t", a, b, 0) for a, b in zip(states, states[1:], strict=False)]]
                keys += [("e", s, f, v) for s, line in zip(states, text.split("\n"), strict=True) for f, v in enumerate(observed(line))]
                for k in keys:
                    seen[k] = seen.get(k, 0) + 1
            rows = [(*k, n) for k, n in seen.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["what", "x", "y", "z", "n"])

    counts = mapped(some.select("part", "text", "roles", "begins", "lines"), count, "what string, x long, y long, z long, n long").groupBy("what", "x", "y", "z").agg(F.sum("n").alias("n")).collect()
    by = lambda what: [(r["x"], r["y"], r["z"], float(r["n"])) for r in counts if r["what"] == what]
    return Hmm({(x, y): n for x, y, _, n in by("t")}, {(x, y, z): n for x, y, z, n in by("e")}, {x: n for x, _, _, n in by("s")})


def edges(parts: DataFrame, shared) -> DataFrame:
    """(conv_id, part, before, last): the states around each part of the conversations that have several.

    A conversation's tables (one of 36 numbers a part) meet in one task.
    """
    several = parts.groupBy("conv_id").agg(F.min("part").alias("first"), F.count("*").alias("n")).where("n > 1").select("conv_id", "first")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            scores = [shared.value.transfer([observed(x) for x in (t or "").split("\n")], b).ravel() for t, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(scores, pa.list_(pa.float64()))], names=["conv_id", "part", "scores"])

    def joined(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        each = np.array(t.column("scores").to_pylist()).reshape(-1, len(STATES), len(STATES))
        best = [each[0, 0]]  # the first part's table is the same from every state
        for m in each[1:]:
            best.append((best[-1][:, None] + m).max(axis=0))
        last = [int(best[-1].argmax())]
        for before, m in zip(best[-2::-1], each[:0:-1], strict=True):
            last.append(int((before + m[:, last[-1]]).argmax()))
        last = last[::-1]
        return pa.table({"conv_id": t.column("conv_id"), "part": t.column("part"), "before": pa.array([None, *last[:-1]], pa.int32()), "last": pa.array(last, pa.int32())})

    rows = parts.join(several, "conv_id").select("conv_id", "part", "text", (F.col("part") == F.col("first")).alias("begins"))
    return mapped(rows, tables, "conv_id long, part long, scores array<double>").groupBy("conv_id").applyInArrow(joined, "conv_id long, part long, before int, last int")


def format_chats(parts: DataFrame, model: Hmm) -> DataFrame:
    """Per row of ``parts`` (conv_id, part, text): the turns that begin in it, whole, and their canonical rendering.

    Null text is one empty turn where the transcript begins, else an empty line. A part
    that begins no turn has an empty rendering; the last turn before it has its text.
    Very long lines are decoded whole. One turn is one value, however many parts it spans.
    """
    shared = parts.sparkSession.sparkContext.broadcast(model)
    edge = written(edges(parts, shared), "chat-edges")
    rows = parts.select("conv_id", "part", "text")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            got = [pieces(t or "", shared.value, a, b) for t, a, b in zip(*[c.to_pylist() for c in batch.columns[2:5]], strict=True)]
            columns = [pa.array([[x[k] for x in new] for _, new in got], pa.list_(kind)) for k, kind in ((0, pa.string()), (1, pa.int32()), (2, pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns, pa.array([head for head, _ in got], pa.string())], names=["conv_id", "part", "found_roles", "starts", "texts", "head"])

    def rendering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for roles, texts, tail in zip(*[c.to_pylist() for c in batch.columns[3:6]], strict=True):
                if tail is not None:
                    texts[-1] += "\n" + tail
                out.append(render([(role, text.strip()) for role, text in zip(roles, texts, strict=True)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), batch.column(2), pa.array(out, pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in out], pa.string())], names=["conv_id", "part", "found_roles", "starts", "rendered", "rendered_sha256"])

    schema = "conv_id long, part long, found_roles array<string>, starts array<int>, texts array<string>, head string"
    none = F.lit(None).cast("int")
    alone = mapped(rows.join(edge, ["conv_id", "part"], "left_anti").select("*", none.alias("before"), none.alias("last")), decode, schema)
    several = written(mapped(rows.join(edge, ["conv_id", "part"]).select("conv_id", "part", "text", "before", "last"), decode, schema), "chat-parts")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    owners = several.select("conv_id", "part", F.last(F.when(F.size("starts") > 0, F.col("part")), ignorenulls=True).over(earlier).alias("owner"))
    heads = several.where("head is not null").select("conv_id", "part", "head").join(owners, ["conv_id", "part"])
    tails = heads.groupBy("conv_id", F.col("owner").alias("part")).agg(F.array_join(F.sort_array(F.collect_list(F.struct("part", "head")))["head"], "\n").alias("tail"))
    all_turns = alone.withColumn("tail", F.lit(None).cast("string")).unionByName(several.join(tails, ["conv_id", "part"], "left"))
    return mapped(all_turns.select("conv_id", "part", "starts", "found_roles", "texts", "tail"), rendering, "conv_id long, part long, found_roles array<string>, starts array<int>, rendered string, rendered_sha256 string")


def recovered(conversations: DataFrame) -> DataFrame:
    """Per conversation (of more than ``PART`` lines, per part in which turns begin): turns written and found, whether all roles came back, whether its id is held out from learning, the rendering."""
    parts = written(transcripts(conversations), "transcripts")
    found = format_chats(parts, learn(parts))
    roles = F.transform(F.filter(F.arrays_zip("roles", "begins"), lambda x: x["begins"]), lambda x: x["roles"])
    both = parts.select("conv_id", "part", roles.alias("roles")).join(found, ["conv_id", "part"])
    same = F.col("roles") == F.col("found_roles")
    return both.select("conv_id", "part", F.size("roles").alias("n_turns"), F.size("found_roles").alias("n_found"), same.alias("same_roles"), held_out().alias("held_out"), "rendered", "rendered_sha256").where("n_turns > 0 or n_found > 0")
