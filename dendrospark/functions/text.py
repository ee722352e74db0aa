"""Text from metadata, labels from text, hashed text vectors; column expressions but for the last."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .digests import signed_places

# Priorities and patterns, in the order that decides.
CELL_TYPE_PRIORITY = ("basket", "chandelier", "martinotti", "bitufted", "bipolar", "multipolar", "stellate", "granule", "purkinje", "mitral", "medium spiny", "pyramidal", "interneuron", "parvalbumin", "somatostatin", "VIP", "principal cell")
GENERIC_TYPES = ("principal cell", "neuron")
UNSAID_SPECIES = ("unknown", "not reported", "")
PRIMARY_REGIONS = ("neocortex", "hippocampus", "cerebellum", "thalamus", "striatum", "amygdala", "olfactory bulb", "brainstem", "spinal cord", "retina")
TEXT_CELL_TYPES = ("basket", "chandelier", "martinotti", "stellate", "granule", "purkinje", "mitral", "pyramidal", "interneuron", "principal")
TEXT_REGIONS = ("neocortex", "hippocampus", "cerebellum", "thalamus", "striatum", "amygdala", "olfactory", "retina")
HEX = "0123456789abcdef"
LEVELS = (("broad", 0.1), ("standard", 0.3), ("detailed", 0.4), ("morphometric", 0.2))


def first_match(items: Column, patterns: tuple[str, ...], both_ways: bool = False) -> Column:
    """The first item holding the first pattern that any holds."""
    def hit(p: str) -> Column:
        ok = lambda t: F.contains(F.lower(t), F.lit(p)) | F.contains(F.lit(p), F.lower(t)) if both_ways else F.contains(F.lower(t), F.lit(p))
        return F.get(F.filter(items, ok), F.lit(0))

    return F.coalesce(*[hit(p) for p in patterns])


def primary_cell_type(types: Column) -> Column:
    """By priority, else the first that is not generic, else the first. ("VIP" meets lower-cased text, so it never matches.)"""
    special = F.get(F.filter(types, lambda t: ~F.lower(t).isin(*GENERIC_TYPES)), F.lit(0))
    return F.coalesce(first_match(types, CELL_TYPE_PRIORITY), special, F.get(types, F.lit(0)))


def primary_region(regions: Column) -> Column:
    """The region, as it stands, that holds or is part of the first primary region for which there is one, else the first region. An empty one is part of any."""
    return F.coalesce(first_match(regions, PRIMARY_REGIONS, both_ways=True), F.get(regions, F.lit(0)))


def layer(regions: Column) -> Column:
    found = F.filter(F.transform(regions, lambda r: F.regexp_extract(F.lower(r), r"layer\s*(\d+(?:[/-]\d+)?)", 1)), lambda x: x != "")
    return F.concat(F.lit("layer "), F.get(found, F.lit(0)))


def article(text: Column, fold: bool = True) -> Column:
    """``text`` after "a" or "an", by its first letter; ``fold`` counts capitals as vowels too."""
    first = F.left(text, F.lit(1))
    return F.concat(F.when((F.lower(first) if fold else first).rlike("[aeiou]"), "an ").otherwise("a "), text)


def neuron_suffix(kind: Column) -> Column:
    return F.when(F.lower(kind).rlike("cell|neuron"), kind).otherwise(F.concat(kind, F.lit(" neuron")))


@dataclass(frozen=True)
class Parts:
    """The columns of a description; an adapter makes them from its source's fields."""

    species: Column
    cell_type: Column
    region: Column
    layer: Column


def archive_parts(species: Column, cell_types: Column, regions: Column) -> Parts:
    """Metadata with lists of cell types and regions; types and regions are lower-cased, of the species only an unsaid one is left out."""
    kind = full(F.lower(primary_cell_type(cell_types)))
    return Parts(F.when(~F.lower(species).isin(*UNSAID_SPECIES), species), neuron_suffix(kind), full(F.lower(primary_region(regions))), layer(regions))


def full(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def specimen_parts(t_type: Column, dendrite: Column, structure: Column, species: Column) -> Parts:
    """Metadata with transcriptomic labels; the dendrite type goes before them, a missing (not an empty) species is mouse."""
    kind = F.coalesce(neuron_suffix(full(F.lower(dendrite))), full(F.lower(t_type)))
    return Parts(full(F.coalesce(species, F.lit("mouse"))), kind, full(F.lower(structure)), F.lit(None).cast("string"))


def generic_parts(species: Column, cell_type: Column, region: Column) -> Parts:
    """Metadata of which only "unknown" and empty values are left out."""
    said = lambda c: F.nullif(full(c), F.lit("unknown"))
    return Parts(said(species), said(cell_type), said(region), F.lit(None).cast("string"))


ADAPTERS = {"archive": archive_parts, "specimen": specimen_parts, "generic": generic_parts}


def archive_fields(neuron_id: Column, name: Column, cell_types: Column, regions: Column, species: Column) -> dict[str, Column]:
    """The plain fields of metadata with lists: an id or else a name, lists joined, "unknown" for what is missing."""
    joined = lambda a: F.when(F.size(a) > 0, F.array_join(a, " ")).otherwise("unknown")
    return {"neuron_id": F.coalesce(neuron_id, name, F.lit("")), "cell_type": joined(cell_types), "brain_region": joined(regions), "species": F.coalesce(species, F.lit("unknown"))}


def specimen_fields(specimen_id: Column, t_type: Column, met_type: Column, dendrite: Column, structure: Column, species: Column) -> dict[str, Column]:
    """The plain fields of metadata with transcriptomic labels: the first type that is given."""
    return {
        "neuron_id": F.coalesce(specimen_id, F.lit("")), "cell_type": F.coalesce(full(t_type), full(met_type), full(dendrite), F.lit("unknown")),
        "brain_region": F.coalesce(structure, F.lit("cortex")), "species": F.coalesce(species, F.lit("mouse")),
    }


def legacy_text(p: Parts) -> Column:
    """"a/an X from R layer L"."""
    kind = F.coalesce(p.cell_type, F.lit("neuron"))
    where = F.when(p.region.isNotNull(), F.concat_ws(" ", F.lit(" from"), p.region, p.layer))
    return F.concat(article(kind, False), F.coalesce(where, F.lit("")))


def specimen_text(dendrite: Column, structure: Column, t_type: Column) -> Column:
    """What is given of dendrite type, structure and type label, else "neuron"."""
    return F.coalesce(full(F.concat_ws(" ", *[full(c) for c in (dendrite, structure, t_type)])), F.lit("neuron"))


def template_text(template: str, fields: dict[str, Column]) -> Column:
    """``template`` with each {field} replaced by its column."""
    return reduce(lambda text, kv: F.replace(text, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1].cast("string"), F.lit(""))), fields.items(), F.lit(template))


def lot(*parts: Column) -> Column:
    """A hash of the parts, as hexadecimal digits that SQL elsewhere can replay."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))


def chance(*parts: Column) -> Column:
    """A number in [0, 1) drawn by the parts' hash."""
    return F.conv(F.left(lot(*parts), F.lit(8)), 16, 10).cast("bigint") / 2**32


def augmented(text: Column, key: Column, seed: int = 0) -> Column:
    """One of four phrasings, by hash."""
    forms = F.array(text, F.lower(text), F.concat(F.lit("a "), text), F.concat(F.lit("morphology of "), text))
    return F.element_at(forms, F.floor(chance(key, F.lit(seed)) * 4).cast("int") + 1)


def broad(p: Parts) -> Column:
    return F.when(F.length(p.species) > 0, article(F.concat(p.species, F.lit(" neuron")))).otherwise("a neuron")


def standard(p: Parts, adjectives: Column | None = None) -> Column:
    kind = F.coalesce(p.cell_type, F.lit("neuron"))
    words = [c for c in (adjectives, p.species, kind) if c is not None]
    where = F.when(p.region.isNotNull(), F.concat_ws(" ", F.lit(" from"), p.region, p.layer))
    return article(F.concat(F.concat_ws(" ", *words), F.coalesce(where, F.lit(""))))


def whole(v: Column) -> Column:
    """A number as text without decimals, ties to even."""
    return F.bround(v, 0).cast("bigint").cast("string")


def facts(length: Column, n_bifs: Column, n_stems: Column, width: Column, height: Column) -> Column:
    cut = lambda v: v.cast("bigint").cast("string")
    return F.array_compact(F.array(
        F.concat(whole(length), F.lit(" um total length")), F.concat(cut(n_bifs), F.lit(" bifurcations")), F.concat(cut(n_stems), F.lit(" stems")), F.concat(whole(width), F.lit(" x "), whole(height), F.lit(" um span")),
    ))


def some(items: Column, n: Column, key: Column) -> Column:
    """Up to ``n`` items in hash order; which ones depends on the key only."""
    ranked = F.array_sort(F.transform(items, lambda x: F.struct(lot(key, x).alias("h"), x.alias("x"))))
    return F.transform(F.slice(ranked, F.lit(1), F.least(n, F.size(items))), lambda r: r["x"])


def morphometric(p: Parts, fact_list: Column, key: Column) -> Column:
    n = F.floor(chance(key, F.lit("facts")) * 2).cast("int") + 2
    return F.concat_ws(", ", standard(p), F.nullif(F.array_join(some(fact_list, n, key), ", "), F.lit("")))


def detailed(p: Parts, adjectives: Column, key: Column) -> Column:
    n = F.floor(chance(key, F.lit("adjectives")) * 2).cast("int") + 1
    return standard(p, F.nullif(F.array_join(some(adjectives, n, key), ", "), F.lit("")))


def level(key: Column, seed: int = 0) -> Column:
    """A detail level by hash, with the levels' weights."""
    u = chance(key, F.lit(f"level{seed}"))
    out, at = None, 0.0
    for name, weight in LEVELS[:-1]:
        at += weight
        out = F.when(u < at, name) if out is None else out.when(u < at, name)
    return out.otherwise(LEVELS[-1][0])


def label_from_text(text: Column, patterns: tuple[str, ...]) -> Column:
    low = F.lower(text)
    out = F.when(F.contains(low, F.lit(patterns[0])), patterns[0])
    for p in patterns[1:]:
        out = out.when(F.contains(low, F.lit(p)), p)
    return out.otherwise("other")


def species_label(species: Column) -> Column:
    """The species as given, "other" where it is unsaid."""
    return F.when(F.lower(species).isin(*UNSAID_SPECIES) | species.isNull(), "other").otherwise(species)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def id_from_path(path: Column, least_digits: int = 1) -> Column:
    """The first run of digits of a file's stem, else the stem."""
    return F.coalesce(F.nullif(F.regexp_extract(stem(path), rf"(\d{{{least_digits},}})", 1), F.lit("")), stem(path))


def candidate_ids(name: Column) -> Column:
    """Ids a name may go by, in order: itself, without .CNG, what follows a numeric prefix, the prefix."""
    base = F.regexp_replace(name, r"\.CNG$", "")
    rest, prefix = F.nullif(F.regexp_extract(base, r"^\d+_(.+)$", 1), F.lit("")), F.nullif(F.regexp_extract(base, r"^(\d+)_.+$", 1), F.lit(""))
    return F.array_distinct(F.array_compact(F.array(name, base, rest, prefix)))


def safe_filename(s: Column) -> Column:
    return F.left(F.regexp_replace(F.trim(s), r"[^A-Za-z0-9._-]+", "_"), F.lit(240))


def clipped(s: Column, n: int = 50) -> Column:
    return F.when(F.length(s) > n, F.concat(F.left(s, F.lit(n)), F.lit("..."))).otherwise(s)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(text: Column, most: int = 3) -> Column:
    """Word n-grams of lower-cased text; text without words gives itself."""

    def of_size(words: Column, n: int) -> Column:
        joined = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
        return F.when(F.size(words) >= n, joined).otherwise(F.array().cast("array<string>"))

    split = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return let(split, lambda words: F.when(F.size(words) > 0, F.concat(*[of_size(words, n) for n in range(1, most + 1)])).otherwise(F.array(text)))


def md5_mod(s: Column, d: int) -> Column:
    """The 128-bit md5 of ``s`` modulo ``d``, from its hexadecimal digits in pieces that fit a long."""
    h = F.md5(s.cast("binary"))
    piece = lambda at, n: F.conv(F.substring(h, at, n), 16, 10).cast("bigint") % d
    return ((piece(1, 15) * pow(16, 17, d) + piece(16, 15) * pow(16, 2, d) + piece(31, 2)) % d).cast("int")


def sha1_sign(s: Column) -> Column:
    return F.when(F.right(F.sha1(s.cast("binary")), F.lit(1)).isin(*HEX[::2]), 1).otherwise(-1)


GRAM_BYTES, GRAM_ROWS = 4_000_000, 2048  # of texts whose grams are hashed together
SPACES = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))


def gram_sums(low: pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The signed counts of the texts' 1- to 3-grams by place, ``dim`` of them a text, and whether a text has words. Each different gram is hashed once."""
    whole = pa.concat_arrays(low.chunks).fill_null("").cast(pa.large_binary())
    rows = len(whole)
    edges = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + rows + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    sums, ink = np.zeros(rows * dim), np.concatenate([[False], ~SPACES[data], [False]])
    cut = np.zeros(len(data) + 1, bool)
    cut[edges] = True
    start, end = np.flatnonzero(ink[1:] & (~ink[:-1] | cut)), np.flatnonzero(ink[:-1] & (~ink[1:] | cut))
    row = np.searchsorted(edges, start, side="right") - 1
    if not len(start):
        return sums, np.zeros(rows, bool)
    # The words with one space after each, so that a gram is one piece.
    length = end - start
    to = np.r_[0, np.cumsum(length + 1)]
    words = np.full(to[-1], 32, np.uint8)
    at = np.flatnonzero(ink[1:-1])
    words[at + np.repeat(to[:-1] - start, length)] = data[at]
    held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(to), pa.py_buffer(words)]).dictionary_encode()
    word = held.indices.to_numpy().astype(np.int64)
    many, code = len(held.dictionary), word
    for n in range(1, 4):
        if n > 1:
            key = code[: len(start) - n + 1] * many + word[n - 1 :]
            code = pa.array(key).dictionary_encode().indices.to_numpy().astype(np.int64)
        here = np.flatnonzero(row[: len(code)] == row[n - 1 :])  # the others reach into the next text
        if not len(here):
            break
        own = np.full(code.max() + 1, -1)
        own[code[here]] = here
        met = np.flatnonzero(own >= 0)
        first = own[met]
        places, signs = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        places[met], signs[met] = signed_places(words, to[first], to[first + n] - 1 - to[first], dim)
        sums += np.bincount(row[here] * dim + places[code[here]], signs[code[here]], rows * dim)
    return sums, np.bincount(row, minlength=rows) > 0


def hash_vectors(texts: DataFrame, id_column: str, text: str = "text", dim: int = 384) -> DataFrame:
    """(id, slots): the non-zero places of signed n-gram counts, scaled to length 1. Rows of one id add up.

    Grams are cut, told apart and hashed in columns (``md5_mod``, ``sha1_sign`` say
    the same of one gram), some megabytes of texts at a time. A task passes on sums by
    place, which are moved once, by id. Null texts have no grams; ids whose counts are all 0 have no row.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                held.append(batch.slice(at, 256))
                size += held[-1].column(2).nbytes
                if size >= GRAM_BYTES or sum(b.num_rows for b in held) >= GRAM_ROWS:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in pieces(batches):
            sums, worded = gram_sums(t.column(2), dim)
            for row in np.flatnonzero(~worded & t.column(1).is_valid().to_numpy()).tolist():
                raw = np.frombuffer(t.column(1)[row].as_py().encode(), np.uint8)
                (place,), (sign,) = signed_places(raw, np.array([0]), np.array([len(raw)]), dim)
                sums[row * dim + place] = sign
            found = np.flatnonzero(sums)
            yield from pa.table({id_column: t.column(0).take(pa.array(found // dim)), "at": pa.array((found % dim).astype(np.int32)), "s": sums[found]}).combine_chunks().to_batches()

    kind = texts.schema[id_column].dataType.simpleString()
    # Hashing costs far more than moving a text does, and few files, or row groups, would leave it to few tasks.
    dealt = texts.select(id_column, F.col(text)).repartition(F.xxhash64(F.col(id_column), F.col(text))).withColumn("low", F.lower(text))
    parts = dealt.mapInArrow(run, f"{id_column} {kind}, at int, s double").repartition(id_column)
    sums = parts.groupBy(id_column, "at").agg(F.sum("s").alias("v"))
    per = sums.where("v <> 0").groupBy(id_column).agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("slots"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return per.select(id_column, F.transform("slots", lambda x: F.struct(x["at"].alias("at"), (x["v"] / F.col("norm")).alias("v"))).alias("slots"))


def dense(slots: Column, dim: int = 384) -> Column:
    by = F.map_from_entries(slots)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at(by, i.cast("int")), F.lit(0.0)))
