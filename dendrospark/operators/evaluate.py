"""Retrieval and classification figures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .vectors import Vectors, dot, normalised, plain, scanned, units

MOST_FIGURES = 10_000
PART = 512  # queries multiplied together
PAIRS = 16_384  # of vectors that are multiplied one by one at a time
TIE = 1e-9  # a similarity that is greater by no more is as good


def below(v: np.ndarray) -> np.ndarray:
    """``v`` in single precision, rounded down."""
    return np.nextafter(v.astype(np.float32), np.float32(-np.inf))


def slack(size: int) -> float:
    """What a product of two vectors of ``size`` components and length 1 at most may be off in single precision, in any order of its sum."""
    return (size + 8) * 2.0**-24


def exact(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Products of the rows ``r`` of x with the rows ``c`` of y; if these are many, out of all products."""
    if len(r) * 16 > len(x) * len(y):
        return (x @ y.T)[r, c]
    each = [np.einsum("ij,ij->i", x[r[at : at + PAIRS]], y[c[at : at + PAIRS]]) for at in range(0, len(r), PAIRS)]
    return np.concatenate(each) if each else np.zeros(0)


def raise_best(best: np.ndarray, x: Vectors, mine: np.ndarray, y: Vectors, theirs: np.ndarray) -> None:
    """Raises ``best`` of each row of x to its greatest product with a row of y of the same code.

    Both are in the order of their codes, so a part of x meets only those of y between its own; where items are stored
    in the order of their labels, these are more at a time. Single precision tells which products may be the greatest; these alone are taken exactly.
    """
    for size in x.keys() & y.keys():
        (i, xs, xf), (j, ys, yf) = x[size], y[size]
        own, other = mine[i], theirs[j]
        first, last = np.searchsorted(own, other[0]), np.searchsorted(own, other[-1], "right")
        for at in range(first, last, PART):
            p = slice(at, min(at + PART, last))
            q = slice(np.searchsorted(other, own[p][0]), np.searchsorted(other, own[p][-1], "right"))
            if q.start >= q.stop:
                continue
            s = xf[p] @ yf[q].T
            if own[p][0] != own[p][-1] or other[q][0] != other[q][-1]:
                s[own[p, None] != other[None, q]] = -np.inf
            top, now = s.max(axis=1), best[i[p]]
            rows = np.flatnonzero((top > -np.inf) & (top >= now - slack(size)))
            low = below(np.maximum(top - 2 * slack(size), now - slack(size))[rows])
            r, c = np.divmod(np.flatnonzero(s[rows] >= low[:, None]), s.shape[1])
            np.maximum.at(now, rows[r], exact(xs[p], ys[q], rows[r], c))
            best[i[p]] = now


def count_above(s: np.ndarray, least: np.ndarray, x: np.ndarray, y: np.ndarray, columns: bool = False) -> np.ndarray:
    """How many products of each row of x with the rows of y, or of each row of y with those of x (``columns``), are above its ``least``.

    ``s`` has the products in single precision and is never turned over; those too near to tell are taken exactly.
    """
    off = slack(x.shape[1])
    low = below(least - off)
    k = np.flatnonzero(s.max(axis=0 if columns else 1) >= low)
    if 2 * len(k) > len(low):
        k, part = np.arange(len(low)), s
    else:
        part = s[:, k] if columns else s[k]
    r, c = np.divmod(np.flatnonzero(part >= (low[k] if columns else low[k, None])), max(1, part.shape[1]))
    r, c = (r, k[c]) if columns else (k[r], c)
    own = c if columns else r
    there = s[r, c] > least[own] + off
    near = np.flatnonzero(~there)
    there[near] = exact(x, y, r[near], c[near]) > least[own[near]]
    return np.bincount(own[there], minlength=len(least))


def codes_of(labels: pa.ChunkedArray) -> Callable[[pa.Table], np.ndarray]:
    """Numbers of a table's labels in the order of ``labels``, -1 for others. Null is a label."""
    known = pc.unique(labels)
    known = known.take(pc.array_sort_indices(known))
    return lambda t: pc.fill_null(pc.index_in(t.column("label"), value_set=known), -1).to_numpy()


def least_above(best: np.ndarray) -> np.ndarray:
    return np.where(np.isneginf(best), np.inf, best + TIE)


def ranks(queries: DataFrame, items: DataFrame, query_id: str, label: str = "label", query_vec: str = "vec", item_vec: str = "vec") -> DataFrame:
    """(query, rank): the place of the best item of the query's own label, 1 + the number of items more similar (by over ``TIE``); null if there is none.

    Each task holds one block of queries and reads the stored items twice (``scanned``):
    for the best right similarity, among those of its labels alone, then for the count above it. What is moved and
    written grows with the tables; the products are all pairs, by nature, but in single precision:
    only those that its error leaves open are taken in double. Null
    labels equal each other.
    """
    own = F.col(label).cast("string").alias("label")
    q = queries.select(F.col(query_id).alias("id"), own, plain(queries, query_vec).alias("v"))
    it = items.select(own, plain(items, item_vec).alias("v"))
    kind = q.schema["id"].dataType.simpleString()

    def run(block: pa.Table, chunks: Callable[[], Iterator[pa.Table]]) -> Iterator[pa.Table]:
        codes = codes_of(block.column("label"))
        mine, best, above = codes(block), np.full(len(block), -np.inf), np.zeros(len(block), np.int64)
        x = units(block.column("v"), mine)
        for it in chunks():
            theirs = codes(it)
            raise_best(best, x, mine, units(it.column("v"), theirs), theirs)
        least = least_above(best)
        for it in chunks():
            for size, (_, ys, yf) in units(it.column("v")).items():
                i, xs, xf = x.get(size, ((), None, None))
                for at in range(0, len(i), PART):
                    p = slice(at, at + PART)
                    above[i[p]] += count_above(xf[p] @ yf.T, least[i[p]], xs[p], ys)
        yield pa.table({"id": block.column("id"), "rank": pa.array(above + 1, mask=np.isneginf(best))})

    return scanned(q, it.sortWithinPartitions("label"), run, f"id {kind}, rank long").withColumnRenamed("id", query_id)


def ranks_both_ways(pairs: DataFrame, label: str, image_vec: str, text_vec: str) -> DataFrame:
    """(n, i2t, t2i): the ranks of each row's image among all texts and of its text among all images, as ``ranks`` has them; n numbers the rows.

    Both come from one product. The best right similarities are taken first and stored beside the vectors. Then each
    task counts what is above them in the rows and in the columns of its products; of the columns
    it passes on those counts alone that are not 0, a chunk of texts at a time, and these are summed.
    """
    rows = pairs.select(F.col(label).cast("string").alias("label"), plain(pairs, image_vec).alias("image"), plain(pairs, text_vec).alias("text"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("image", "text")}
    ways = (("image", "text"), ("text", "image"))

    def best_ones(block: pa.Table, chunks: Callable[[], Iterator[pa.Table]]) -> Iterator[pa.Table]:
        codes = codes_of(block.column("label"))
        mine = codes(block)
        x, best = {c: units(block.column(c), mine) for c, _ in ways}, {c: np.full(len(block), -np.inf) for c, _ in ways}
        for it in chunks():
            theirs = codes(it)
            for c, other in ways:
                raise_best(best[c], x[c], mine, units(it.column(other), theirs), theirs)
        yield block.select(["n", "image", "text"]).append_column("i", pa.array(least_above(best["image"]))).append_column("t", pa.array(least_above(best["text"])))

    def counts(block: pa.Table, chunks: Callable[[], Iterator[pa.Table]]) -> Iterator[pa.Table]:
        x, above = units(block.column("image")), np.zeros(len(block), np.int64)
        i, t = (block.column(c).to_numpy() for c in "it")
        for it in chunks():
            least, over = it.column("t").to_numpy(), np.zeros(len(it), np.int64)
            for size, (k, ys, yf) in units(it.column("text")).items():
                j, xs, xf = x.get(size, ((), None, None))
                for at in range(0, len(j), PART):
                    p = slice(at, at + PART)
                    s = xf[p] @ yf.T
                    above[j[p]] += count_above(s, i[j[p]], xs[p], ys)
                    over[k] += count_above(s, least[k], xs[p], ys, columns=True)
            hit = np.flatnonzero(over)
            yield pa.table({"n": it.column("n").take(pa.array(hit)), "i2t": pa.nulls(len(hit), pa.int64()), "t2i": pa.array(over[hit])})
        yield pa.table({"n": block.column("n"), "i2t": pa.array(above + 1, mask=np.isposinf(i)), "t2i": pa.array(np.ones(len(t), np.int64), mask=np.isposinf(t))})

    numbered = rows.withColumn("n", F.monotonically_increasing_id())
    known = stored(scanned(numbered, rows.sortWithinPartitions("label"), best_ones, f"n long, image {kinds['image']}, text {kinds['text']}, i double, t double"), "both-ways")
    return scanned(known.select("n", "image", "i", "t"), known.select("n", "text", "t"), counts, "n long, i2t long, t2i long").groupBy("n").agg(F.sum("i2t").alias("i2t"), F.sum("t2i").alias("t2i"))


def retrieval_both_ways(pairs: DataFrame, order: str, text: str = "text", image_vec: str = "image", text_vec: str = "embedded") -> DataFrame:
    """One row: R@1, R@5, R@10, MRR and median rank from images to texts (i2t_) and back (t2i_); a hit is any row of the same text. ``order`` need not tell rows apart."""
    r = ranks_both_ways(pairs, text, image_vec, text_vec)
    return r.agg(*figures(F.col("i2t"), "i2t_"), *figures(F.col("t2i"), "t2i_"))


def of_classes(rows: DataFrame, classes: list, gt: str = "gt") -> DataFrame:
    """The rows whose true label is one of the classes, predictions beside it."""
    return rows.where(F.col(gt).isin(classes))


def embedded(rows: DataFrame, columns: dict[str, str], encode, schema: str) -> DataFrame:
    """``rows`` through a batched encoder: ``columns`` maps new array columns to the columns they are computed from.

    ``encode(name, values)`` gets the values of a batch as a list and returns a vector for
    each; it is made once a task by ``encode()`` without arguments if it is a class.
    For a bounded number of rows put ``first_rows`` before it.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encode() if isinstance(encode, type) else encode
        for batch in batches:
            new = [pa.array([list(map(float, v)) for v in model(name, batch.column(names.index(source)).to_pylist())], pa.list_(pa.float64())) for name, source in columns.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, *columns])

    return rows.mapInArrow(run, schema)


def metrics(*named: tuple[str, DataFrame]) -> DataFrame:
    """(section, name, value) of one-row tables of figures, in long form: what is written as the metrics table."""
    out = None
    for section, row in named:
        pairs = F.explode(F.array(*[F.struct(F.lit(section).alias("section"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in row.columns])).alias("m")
        part = row.select(pairs).select("m.*")
        out = part if out is None else out.unionByName(part)
    return out


def metrics_text(figures: DataFrame) -> str:
    """The report: sections in the order in which they come up in ``figures``, a line a figure with one decimal, "n/a" for null. Figures are a short table."""
    lines: list[str] = []
    section = None
    for r in figures.limit(MOST_FIGURES).collect():
        if r.section != section:
            section = r.section
            lines += ["", f"[{section}]", "-" * 40]
        lines.append(f"  {r['name']}: " + ("n/a" if r.value is None else f"{r.value:.1f}"))
    return "\n".join(["=" * 70, "Evaluation report", "=" * 70, *lines, "", "=" * 70])


def figures(rank: Column, prefix: str = "") -> list[Column]:
    hit = lambda k: (100 * F.avg(F.when(rank <= k, 1.0).otherwise(0.0))).alias(f"{prefix}r_at_{k}")
    return [hit(1), hit(5), hit(10), (100 * F.avg(F.coalesce(1 / rank, F.lit(0.0)))).alias(f"{prefix}mrr"), F.median(rank).alias(f"{prefix}median_rank")]


def retrieval(rank: DataFrame, prefix: str = "") -> DataFrame:
    """R@1, R@5, R@10 and MRR in per cent, and the median rank."""
    return rank.agg(*figures(F.col("rank"), prefix))


def class_report(df: DataFrame, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """(label, precision, recall, f1, support) of each true label; a zero denominator gives 0."""
    c = df.groupBy(gt, pred).agg(F.count("*").alias("n"))
    true = c.groupBy(F.col(gt).alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(gt) == F.col(pred), F.col("n")).otherwise(0)).alias("tp"))
    said = c.groupBy(F.col(pred).alias("label")).agg(F.sum("n").alias("predicted"))
    r = true.join(said, "label", "left").withColumn("predicted", F.coalesce("predicted", F.lit(0)))
    p, s = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    return r.select("label", p.alias("precision"), s.alias("recall"), F.coalesce(F.try_divide(2 * p * s, p + s), F.lit(0.0)).alias("f1"), "support")


def averages(report: DataFrame) -> DataFrame:
    """Macro and weighted averages, and accuracy (the weighted recall)."""
    out = []
    for m in ("precision", "recall", "f1"):
        out += [F.avg(m).alias(f"macro_{m}"), (F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"weighted_{m}")]
    return report.agg(*out, (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"), F.sum("support").alias("n"))


def confusion(df: DataFrame, labels: list, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """Counts of predicted labels (columns in the given order) per true label; labels that don't occur have rows of zeros."""
    rows = df.sparkSession.createDataFrame([(x,) for x in labels], df.select(gt).schema)
    return rows.join(df.groupBy(gt).pivot(pred, labels).count(), gt, "left").na.fill(0).orderBy(gt)


def effect(scored: DataFrame, value: str, order: str, k: int, high: bool = True) -> DataFrame:
    """Mean of the k best-scored rows against all, in population deviations, and whether the direction is right."""
    top = scored.where(F.col(value).isNotNull()).orderBy(F.desc("sim"), order).limit(k).agg(F.avg(value).alias("top_mean"))
    pop = scored.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    d = F.when(F.col("std") > 0, (F.col("top_mean") - F.col("mean")) / F.col("std")).otherwise(0.0)
    return top.crossJoin(pop).select("top_mean", "mean", "std", d.alias("effect_size"), ((d > 0) if high else (d < 0)).alias("correct_direction"))


def precision_at(scored: DataFrame, right: str, order: str, k: int) -> DataFrame:
    """Right ones among the k best, divided by k even if there are fewer rows."""
    return scored.orderBy(F.desc("sim"), order).limit(k).agg((F.count_if(F.col(right)) / F.lit(k)).alias("precision"))


def info_nce(views: DataFrame, order: str, batch: str, temperature: float = 0.07) -> DataFrame:
    """Per batch: n, the symmetric cross-entropy of its (image, text) vectors and the accuracies both ways; ties go to the smaller ``order``.

    A batch is small and stated, so each meets itself in one task. Rows without
    one of the vectors are in no batch.
    """
    rows = views.select(F.col(batch).cast("long").alias("batch"), F.col(order).alias("i"), normalised(F.col("image")).alias("u"), normalised(F.col("text")).alias("w"))

    def side(s: np.ndarray) -> tuple[float, float]:
        m = s.max(axis=1)
        return float((np.log(np.exp(s - m[:, None]).sum(axis=1)) + m - np.diag(s)).mean()), float((s.argmax(axis=1) == np.arange(len(s))).mean())

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        u, w = (np.array(t.column(c).to_pylist(), float) for c in ("u", "w"))
        s = u @ w.T / temperature
        (a, i2t), (b, t2i) = side(s), side(s.T)
        return pa.table({"batch": t.column("batch").slice(0, 1), "n": [len(s)], "loss": [(a + b) / 2], "i2t_acc": [i2t], "t2i_acc": [t2i]})

    return rows.where("u is not null and w is not null").groupBy("batch").applyInArrow(run, "batch long, n long, loss double, i2t_acc double, t2i_acc double")


def kl_term(mu: Column, logvar: Column, free_bits: float = 0.0) -> Column:
    """Mean over dimensions of -0.5 (1 + lv - mu^2 - e^lv), each at least ``free_bits``."""
    each = F.zip_with(mu, logvar, lambda m, v: F.greatest(F.lit(float(free_bits)), -0.5 * (1 + v - m * m - F.exp(v))) if free_bits else -0.5 * (1 + v - m * m - F.exp(v)))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(mu)


def cross_entropy(logits: Column, label: Column, ignored: int = -100) -> Column:
    """log(sum e^l) - l of the label's class (from 0), shifted by the largest logit; null for an ignored label."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.when(label != ignored, F.log(total) + top - F.get(logits, label))


def dice(pred: Column, true: Column, smooth: float = 1.0) -> Column:
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return (2 * dot(pred, true) + smooth) / (total(pred) + total(true) + smooth)


def huber(d: Column, delta: float = 1.0) -> Column:
    return F.when(F.abs(d) <= delta, 0.5 * d * d).otherwise(delta * (F.abs(d) - 0.5 * delta))
