"""Filter interaction audit: what each filter of a set takes away, in every order the filters can be applied.

Every row gets a mask of the filters it fails. Masks are counted per part in
Spark (at most 2^filters rows a part). A part's counts become a decision diagram:
a level for each filter, a node for each different table of counts that the levels
below can lead to, the two branches "passes" and "fails", and in every node the
weight of what it stands for. The order of the levels is changed by swapping
neighbouring ones in place; a sequence of swaps visits every order once. In each
order the path on which everything passes has the steps: a step keeps the weight of
its passing branch and removes that of its failing one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "[\\\\x20\\\\x09-\\\\x0D]+"
SALTS = 64

Weight = tuple[int, ...]
STEP = "filter_order string, step bigint, filter string, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


class Node:
    """A node of a diagram: the branches of its level's filter (None: no rows) and the weight of both."""

    __slots__ = ("fails", "passes", "weight")

    def __init__(self, passes, fails, weight: Weight):
        self.passes, self.fails, self.weight = passes, fails, weight


class Diagram:
    """A count-weighted decision diagram of ``masks`` (bit i: filter i fails; value: a tuple of counts). Equal parts are shared."""

    def __init__(self, masks: dict[int, Weight], filters: int):
        self.order = list(range(filters))
        self.width = len(next(iter(masks.values()), (0,)))
        self.leaves: dict[Weight, Node] = {}
        self.root = self.built({m: w for m, w in masks.items() if any(w)}, 0, [{} for _ in self.order])

    def built(self, masks: dict[int, Weight], level: int, known: list[dict]) -> Node | None:
        if not masks:
            return None
        if level == len(self.order):
            (weight,) = masks.values()
            return self.leaves.setdefault(weight, Node(None, None, weight))
        bit = 1 << self.order[level]
        branches = (self.built({m: w for m, w in masks.items() if bool(m & bit) == fails}, level + 1, known) for fails in (False, True))
        return self.shared(*branches, known[level])

    def shared(self, passes: Node | None, fails: Node | None, known: dict) -> Node | None:
        if passes is None and fails is None:
            return None
        if (id(passes), id(fails)) not in known:
            known[id(passes), id(fails)] = Node(passes, fails, self.sum(passes, fails))
        return known[id(passes), id(fails)]

    def sum(self, *nodes: Node | None) -> Weight:
        return tuple(map(sum, zip((0,) * self.width, *(n.weight for n in nodes if n), strict=True)))

    def level(self, level: int) -> list[Node]:
        """The different nodes of a level."""
        nodes = {id(self.root): self.root} if self.root else {}
        for _ in range(level):
            nodes = {id(c): c for n in nodes.values() for c in (n.passes, n.fails) if c}
        return list(nodes.values())

    def swap(self, level: int) -> None:
        """Exchanges a level with the next. Nodes above and below stay as they are."""
        known: dict = {}
        for n in self.level(level):
            pp, pf = (n.passes.passes, n.passes.fails) if n.passes else (None, None)
            fp, ff = (n.fails.passes, n.fails.fails) if n.fails else (None, None)
            n.passes, n.fails = self.shared(pp, fp, known), self.shared(pf, ff, known)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[int, Weight, Weight]]:
        """Filter, weight kept and weight removed of each step of the present order."""
        none, node = (0,) * self.width, self.root
        for f in self.order:
            kept, lost = (node.passes, node.fails) if node else (None, None)
            yield f, kept.weight if kept else none, lost.weight if lost else none
            node = kept


def swaps(n: int) -> Iterator[int]:
    """The levels whose swaps lead through all orders of n filters: the last one wanders through every order of the others, forth and back."""
    if n < 2:
        return
    inner, down = swaps(n - 1), True
    for _ in range(factorial(n - 1)):
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is not None:
            yield step + 1 if down else step
        down = not down


def audited(masks: dict[int, Weight], names: str) -> list[tuple]:
    """Rows of STEP for all orders. Weights are (rows, good rows, toxic rows)."""
    diagram = Diagram(masks, len(names))
    runs = [list(diagram.steps())]
    for level in swaps(len(names)):
        diagram.swap(level)
        runs.append(list(diagram.steps()))
    failing = [next(r[0][2][0] for r in runs if r[0][0] == f) for f in range(len(names))]
    alone = [next(r[-1][2][0] for r in runs if r[-1][0] == f) for f in range(len(names))]
    shapley = [sum(lost[0] for r in runs for f, _, lost in r if f == g) for g in range(len(names))]
    return [
        ("".join(names[f] for f, _, _ in run), i, names[f], kept[0], lost[0], failing[f] - lost[0], alone[f], lost[1], lost[2], shapley[f])
        for run in runs
        for i, (f, kept, lost) in enumerate(run, 1)
    ]


def audit(masks: DataFrame, names: str) -> DataFrame:
    """``masks`` (part, mask, n, good, toxic; further rows of a mask add up) to one row per part, order and step.

    Masks are summed before parts are gathered, so a part is a group of at most
    2^filters rows; bit i of a mask stands for letter i of ``names``. Null masks
    or counts aren't allowed; null parts count as empty strings; no rows give no rows.
    """

    def run(key: tuple, group: pa.Table) -> pa.Table:
        found = {m: w for m, *w in zip(*(group[c].to_pylist() for c in ("mask", "n", "good", "toxic")), strict=True)}
        rows = audited({m: tuple(w) for m, w in found.items()}, names)
        return pa.table({"part": [key[0].as_py()] * len(rows)} | dict(zip((c.split()[0] for c in STEP.split(", ")), map(list, zip(*rows, strict=True)), strict=True)))

    cells = masks.groupBy(F.coalesce("part", F.lit("")).alias("part"), "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    return cells.groupBy("part").applyInArrow(run, f"part string, {STEP}")


def text_checks() -> dict[str, Column]:
    """Conditions of ``text`` under which the first four filters fail."""
    words = F.expr(f"filter(split(text, '{SPACES}'), w -> w <> '')")
    capitals = F.expr("length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length("text"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of failure masks: part, mask, n, good, toxic, for filters A to D (``text_checks``) and E: a smaller doc_id has the same text.

    Texts are compared by SHA-256. Rows are counted by digest, id, part and mask
    first, so many copies of a row are one; the smallest id of a digest is a
    minimum combined before the shuffle and found again by (digest, id), so no
    group of copies meets in a task. A null text is empty, a null lang the part ''.
    Rows of the same id and text don't fail E through each other; rows without an
    id never fail it nor make others fail. Of several labels of an id any counts;
    further columns aren't read.
    """
    checks = text_checks()
    mask = reduce(lambda a, b: a + b, (F.when(c, 1 << i).otherwise(0) for i, c in enumerate(checks.values())))
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "coalesce(cast(lang as string), '') part", "coalesce(text, '') text")
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
    rows = rows.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    salt = F.when(F.col("doc_id").isNull(), F.expr(f"pmod(hash(digest), {SALTS}) + 1")).otherwise(0)
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    said = said.agg(F.max(F.expr("quality <=> 1")).alias("is_good"), F.max(F.expr("toxic <=> 1")).alias("is_toxic")).withColumn("salt", F.lit(0))
    rows = rows.join(first, ["digest", "doc_id"], "left").withColumn("salt", salt).join(said, ["doc_id", "salt"], "left")
    copy = F.expr(f"if(doc_id is null or first, 0, {1 << len(checks)})")  # "first" is null for all but the smallest ids
    return rows.groupBy("part", (F.col("mask") + copy).alias("mask")).agg(
        F.sum("n").alias("n"), F.sum(F.expr("if(is_good, n, 0L)")).alias("good"), F.sum(F.expr("if(is_toxic, n, 0L)")).alias("toxic")
    )


def document_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over ``docs`` per lang: part, filter_order, step, filter and the counts."""
    return audit(masked(docs, labels), "ABCDE")
